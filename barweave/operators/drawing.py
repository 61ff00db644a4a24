"""Drawings as an append-only log of events, and what stands on a chart as the log's last state.

An event is a row: symbol, bar_index, seq (its order within the bar), kind (line, box, label, polyline, linefill, cell, ...),
id (of the object, within symbol and kind), op (new, set, delete) and a column for each field. A field that is
NULL stays as it was; NaN sets a number to na, which the state shows as NULL. A new on an id that stands changes it and leaves its age (fills
between the same two lines); after a delete it is another object. A set or delete on an id that does not stand does nothing.

Kinds have limits: when an object is made and more than so many of its kind stand on a symbol, the oldest goes. So
an object has gone if at any time as many younger ones stood. Only the youngest ``limit`` objects that nobody deleted can
stand in the end, and each is asked for the most of younger ones that ever stood at once: a running count of the
births and deaths after its own, in one window a candidate. No fold, and no list longer than the limit.

Provisional bars are executed again: ``settled`` keeps of each bar the events of its last run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Objects of a kind that a symbol holds at most; kinds not named here have no limit.
LIMITS = {"line": 50, "box": 50, "label": 50, "polyline": 50}

OWNER = ("symbol", "kind")
WHEN = ("bar_index", "seq")


def settled(events: DataFrame) -> DataFrame:
    """events, which have a column run that counts a bar's executions, without those of runs that were repeated. A run that draws nothing
    is told by a row with op run; its other columns may be NULL."""
    last = F.max("run").over(Window.partitionBy("symbol", "bar_index"))
    return events.withColumn("_last", last).where("run = _last and op <> 'run'").drop("_last", "run")


def objects(events: DataFrame, *fields: str) -> DataFrame:
    """(symbol, kind, id, born, died, fields) of each object that was ever made; born and died are (bar_index, seq), died NULL if nobody deleted it."""
    order = Window.partitionBy(*OWNER, "id").orderBy(*WHEN)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*WHEN)
    # the ops that change whether an object stands are the last new or delete's opposite; a life begins with such a new
    stood = F.coalesce(F.last(F.when(F.col("op").isin("new", "delete"), F.col("op") == "new"), ignorenulls=True).over(before), F.lit(False))
    rows = events.withColumn("_stood", stood).where("_stood or op = 'new'")
    rows = rows.withColumn("_life", F.sum(F.expr("int(not _stood)")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = dict(events.dtypes)

    def final(f: str) -> Column:
        value = F.max_by(f, F.when(F.col(f).isNotNull(), at))
        return (F.nanvl(value, F.lit(None).cast(kinds[f])) if kinds[f] in ("double", "float") else value).alias(f)

    made = rows.groupBy(*OWNER, "id", "_life").agg(F.min(at).alias("born"), F.max(F.when(F.col("op") == "delete", at)).alias("died"), *[final(f) for f in fields])
    return made.drop("_life")


def state(events: DataFrame, *fields: str, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(symbol, kind, id, born, fields) of what stands after all events; for what stood at a bar, give the events up to it.
    Symbols that are NULL are one symbol. A limit is at least 1."""
    if any(n < 1 for n in limits.values()):
        raise ValueError("a kind's limit is at least 1")
    every = objects(events, *fields)
    standing = every.where("died is null").drop("died")
    if not limits:
        return standing
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("kind")]
    bound = F.col("kind").isin(*limits)
    free = standing.where(~F.coalesce(bound, F.lit(False)))
    young = standing.where(bound).withColumn("_age", F.row_number().over(Window.partitionBy(*OWNER).orderBy(F.desc("born"))))
    young = young.where(F.col("_age") <= max(limits.values())).where(F.col("_age") <= limit).drop("_age")
    return free.unionByName(_without_evicted(young, every.where(bound), limit))


def _without_evicted(young: DataFrame, every: DataFrame, limit: Column) -> DataFrame:
    asked = young.groupBy(*OWNER).agg(F.collect_list("born").alias("_asked"))  # at most the limit
    # without deletions the youngest are what stands; with them, more than the limit may have been younger
    known = every.select(*OWNER, "born", "died").alias("o")
    meets = [F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}")) for c in OWNER]
    younger = known.join(asked.alias("a"), meets).select("o.*", F.explode(F.filter("_asked", lambda c: c < F.col("born"))).alias("asked"))
    moves = younger.select(*OWNER, "asked", F.explode(F.array(F.struct(F.col("born").alias("at"), F.lit(1).alias("step")), F.struct(F.col("died").alias("at"), F.lit(-1).alias("step")))).alias("m")).where("m.at is not null")
    count = F.sum("m.step").over(Window.partitionBy(*OWNER, "asked").orderBy("m.at").rowsBetween(Window.unboundedPreceding, 0))
    gone = moves.withColumn("_n", count).groupBy(*OWNER, "asked").agg(F.max("_n").alias("_n")).where(F.col("_n") >= limit)
    same = [F.col(f"y.{c}").eqNullSafe(F.col(f"g.{c}")) for c in OWNER] + [F.col("y.born") == F.col("g.asked")]
    return young.alias("y").join(gone.alias("g"), same, "left_anti")


def price_at(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A line's price at bar x, on it or beyond its ends; that of its first end if it is upright."""
    return F.when(x1 == x2, y1).otherwise(y1 + F.try_divide(x - x1, x2 - x1) * (y2 - y1))


def fill_id(one: Column, other: Column) -> Column:
    """The id of the fill between two lines, whichever is named first."""
    return F.concat_ws("|", F.least(one, other), F.greatest(one, other))


def cell_id(table: Column, column: Column, row: Column) -> Column:
    return F.concat_ws("|", table, column.cast("int").cast("string"), row.cast("int").cast("string"))


def cell_ids(table: Column, left: Column, top: Column, right: Column | None = None, bottom: Column | None = None) -> Column:
    """The ids of a range of cells, to be exploded into events of kind cell: deletes clear them. One cell without right and bottom; none
    if an end lies before its begin or is na."""
    right, bottom = left if right is None else right, top if bottom is None else bottom

    def steps(a: Column, b: Column) -> Column:
        a, b = a.cast("int"), b.cast("int")
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(steps(left, right), lambda c: F.transform(steps(top, bottom), lambda r: cell_id(table, c, r))))


def merged(table: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """(id, into) of the cells that a merge joins to its first one, to be exploded into events that set into."""
    first = cell_id(table, left, top)
    return F.transform(F.filter(cell_ids(table, left, top, right, bottom), lambda i: i != first), lambda i: F.struct(i.alias("id"), first.alias("into")))
