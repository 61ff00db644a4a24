"""Logs of drawings against a list that is worked through event by event."""

import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import drawing as D

EVENTS = "symbol string, bar_index long, seq int, kind string, id string, op string, y double, text string"


def played(events, limits):
    """What stands after the events, in plain Python."""
    stands = {}
    for symbol, _, _, kind, id, op, y, text in sorted(events, key=lambda e: (e[1], e[2])):
        mine = stands.setdefault((symbol, kind), {})
        if op == "new" and id not in mine:
            mine[id] = [None, None]
            while kind in limits and len(mine) > limits[kind]:
                del mine[next(iter(mine))]
        if op == "delete":
            mine.pop(id, None)
        elif id in mine:
            mine[id] = [mine[id][0] if y is None else None if y != y else y, mine[id][1] if text is None else text]
    return {(s, k, i, *v) for (s, k), mine in stands.items() for i, v in mine.items()}


def standing(spark, events, limits):
    got = D.state(spark.createDataFrame(events, EVENTS), "y", "text", limits=limits).select("symbol", "kind", "id", "y", "text").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_state_equals_a_list_worked_through(spark, seed):
    """Ids of limited kinds are made once, as handles are: a later event on one that has gone does nothing."""
    rng, events, made = random.Random(seed), [], {}
    for t in range(600):
        owner = (rng.choice(["a", "b", None]), rng.choice(["line", "box", "fill"]))
        ids = made.setdefault(owner, [])
        op = rng.choice(["new", "new", "set", "delete"])
        if op == "new":
            ids.append(f"{rng.randrange(5) if owner[1] == 'fill' else len(ids)}")
        elif not ids:
            continue
        id = ids[-1] if op == "new" else rng.choice(ids[-8:])
        y = rng.choice([None, float("nan"), float(t)]) if op != "delete" else None
        events.append((owner[0], t // 3, t % 3, owner[1], id, op, y, rng.choice([None, "x", "z"]) if op != "delete" else None))
    limits = {"line": 4, "box": 1}
    rng.shuffle(events)
    assert standing(spark, events, limits) == played(events, limits)


def test_one_that_has_gone_does_not_return_when_others_are_deleted(spark):
    log = [("a", t, 0, "line", i, op, None, None) for t, (i, op) in enumerate([("A", "new"), ("B", "new"), ("C", "new"), ("C", "delete"), ("A", "set")])]
    assert standing(spark, log, {"line": 2}) == {("a", "line", "B", None, None)}
    assert standing(spark, log, {}) == {("a", "line", i, None, None) for i in "AB"}
    assert standing(spark, [], {"line": 2}) == set()
    with pytest.raises(ValueError):
        standing(spark, log, {"line": 0})


def test_only_the_last_run_of_a_bar_stays(spark):
    rows = [("a", 1, 0, "line", "p", "new", 1.0, None, 0), ("a", 1, 0, "line", "q", "new", 2.0, None, 1), ("a", 2, 0, "line", "r", "new", 3.0, None, 0), ("a", 2, None, None, None, "run", None, None, 1), ("b", 1, 0, "line", "s", "new", 4.0, None, 0)]
    got = D.settled(spark.createDataFrame(rows, EVENTS + ", run int"))
    assert sorted(r.id for r in got.collect()) == ["q", "s"] and "run" not in got.columns


def test_prices_fills_and_cells(spark):
    one = spark.range(1)
    lit = F.lit

    def value(c):
        return one.select(c.alias("v")).first().v

    assert value(D.price_at(lit(15.0), lit(0.0), lit(1.0), lit(10.0), lit(3.0))) == 4.0
    assert value(D.price_at(lit(15.0), lit(5.0), lit(1.0), lit(5.0), lit(3.0))) == 1.0
    assert value(D.price_at(lit(15.0), lit(None).cast("double"), lit(1.0), lit(5.0), lit(3.0))) is None
    assert value(D.fill_id(lit("b"), lit("a"))) == value(D.fill_id(lit("a"), lit("b")))
    assert value(D.cell_ids(lit("t"), lit(0), lit(1), lit(1), lit(2))) == ["t|0|1", "t|0|2", "t|1|1", "t|1|2"]
    assert value(D.cell_ids(lit("t"), lit(2), lit(1))) == ["t|2|1"]
    assert value(D.cell_ids(lit("t"), lit(2), lit(1), lit(1), lit(1))) == value(D.cell_ids(lit("t"), lit(None), lit(1))) == []
    assert [tuple(r) for r in value(D.merged(lit("t"), lit(0), lit(0), lit(1), lit(0)))] == [("t|1|0", "t|0|0")]
