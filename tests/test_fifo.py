"""FIFO pairing by ranges against a queue of lots."""

import datetime as dt
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from barweave.operators import account, broker, fifo

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, time timestamp_ntz, qty double, price double, commission double, n long"


def paired(fills):
    """Trades and open lots by a queue of lots, in order."""
    lots, trades, number = defaultdict(deque), [], defaultdict(int)
    for symbol, time, qty, price, commission, _ in fills:
        if not qty or price is None or symbol is None:
            continue
        rate, left, queue = (commission or 0) / abs(qty), qty, lots[symbol]
        while left and queue and (queue[0]["size"] > 0) != (left > 0):
            lot = queue[0]
            part = min(abs(lot["size"]), abs(left))
            sign = 1 if lot["size"] > 0 else -1
            trades.append((symbol, lot["time"], lot["price"], time, price, sign * part, part * (lot["rate"] + rate), sign * part * (price - lot["price"]) - part * (lot["rate"] + rate)))
            lot["size"] -= sign * part
            left += sign * part
            if not lot["size"]:
                queue.popleft()
        if left:
            number[symbol, left > 0] += 1
            queue.append({"size": left, "time": time, "price": price, "rate": rate})
    return trades, [(s, lot["time"], lot["price"], lot["size"]) for s, q in lots.items() for lot in q]


def random_fills(seed, count, symbols):
    rng = random.Random(seed)
    out = []
    for n in range(count):
        symbol = rng.choice(symbols)
        qty = rng.choice([-1.0, 1.0]) * rng.choice([0.25, 0.5, 1, 2, 7.75, 300 if rng.random() < 0.02 else 3])
        out.append((symbol, START + dt.timedelta(hours=7 * (n // 3)), qty, rng.choice([10.0, 11.5, 9.25, 12.0]), rng.choice([None, 0.0, 0.5]), n))
    return out


@pytest.mark.parametrize("width", [3, 2048])
def test_pairs_equal_a_queue_of_lots(spark, monkeypatch, width):
    monkeypatch.setattr(fifo, "WIDTH", width)
    fills = random_fills(width, 900, ["hot"] * 8 + ["a", "b"])
    fills += [("flat", START, 5.0, 1.0, 0.0, 1), ("flat", START, -5.0, 2.0, 0.0, 2), ("flat", START, -5.0, 2.0, 0.0, 3), ("turn", START, 2.0, 1.0, 1.0, 4), ("turn", START, -7.0, 3.0, 1.4, 5), ("turn", START, 5.0, 2.0, None, 6)]
    fills += [("a", START, None, 1.0, 0.0, 9000), ("a", START, 0.0, 1.0, 0.0, 9001), ("a", START, 1.0, None, 0.0, 9002), (None, START, 1.0, 1.0, 0.0, 9003)]
    df = spark.createDataFrame(random.Random(1).sample(fills, len(fills)), SCHEMA)
    trades, still = fifo.match(df, F.date_trunc("month", "time"), ("time", "n"))
    want, lots = paired(sorted(fills, key=lambda f: (f[1], f[5])))

    def rounded(rows):
        return sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)

    assert rounded(tuple(r)[:8] for r in trades.collect()) == rounded(want)
    assert rounded(tuple(r)[:4] for r in still.collect()) == rounded(lots)
    assert len(want) > 500 and any(r[0] == "turn" for r in want)


def test_quantities_keep_all_places(spark):
    tick = 1e-8
    fills = [("a", START, 3 * tick, 1.0, 0.0, 1), ("a", START, -1 * tick, 2.0, 0.0, 2), ("a", None, 2 * tick, 1.0, 0.0, 0), ("a", START, -6 * tick, 3.0, 0.0, 3), ("a", START, 1e9 + tick, 2.0, 0.0, 4)]
    trades, still = fifo.match(spark.createDataFrame(fills, SCHEMA), F.date_trunc("month", "time"), ("time", "n"))
    got = sorted((r.entry_no, r.exit_no, round(r.size / tick), r.exit_price) for r in trades.collect())
    assert got == [(1, 1, -2, 2.0), (1, 1, 1, 2.0), (1, 2, 1, 3.0), (2, 2, 3, 3.0)]
    assert [(r.entry_no, r.size) for r in still.collect()] == [(3, 999999999.99999999)]


def test_fills_move_once_and_are_read_once_a_round(spark, sf_dir):
    """The share of the plan that grew: six readings and eight exchanges of whole fills before."""
    from barweave.plans import queries_fifo

    plan = queries_fifo.Q["fifo_trades"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 4 and plan.count("Join ") <= 3, plan


def test_no_fills(spark):
    df = spark.createDataFrame([], SCHEMA)
    trades, still = fifo.match(df, F.date_trunc("month", "time"), ("time", "n"))
    assert trades.count() == still.count() == 0
    assert fifo.summary(trades).count() == 0


def test_days_of_loss_at_the_end(spark):
    day = [START + dt.timedelta(days=k) for k in range(5)]
    rows = [("a", d, 100.0, d, 100.0, 1.0, 0.0, p) for d, p in zip([day[0], day[1], day[2], day[2], day[3], day[4]], [5.0, -1.0, -9.0, 9.0, -1.0, -2.0], strict=True)]
    rows += [("b", d, 100.0, d, 100.0, 1.0, 0.0, -1.0) for d in day[:3]] + [("c", day[0], 100.0, day[0], 100.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, entry_time timestamp_ntz, entry_price double, exit_time timestamp_ntz, exit_price double, size double, commission double, profit double")
    got = {r.symbol: r for r in fifo.summary(df).collect()}
    assert {s: r.loss_days for s, r in got.items()} == {"a": 2, "b": 3, "c": 0}
    assert got["a"].profit_factor == 14 / 13 and got["b"].profit_factor == 0 and got["c"].profit_factor is None
    assert got["a"].closed_trades == 6 and got["c"].even_trades == 1


def test_running_sums_are_dealt_by_block(spark):
    df = spark.range(5000).select(F.lit("a").alias("symbol"), F.col("id").alias("n"), (F.col("id") % 7).alias("x"))
    got = fifo.running(df, ("symbol",), F.floor(F.col("n") / 100), ("n",), {"s": F.col("x")}, {"p": F.col("x")}).orderBy("n").collect()
    total = 0
    for i, r in enumerate(got):
        total += i % 7
        assert r.s == total and r.p == (None if i == 0 else (i - 1) % 7)


def marked(bars, fills, trades, capital):
    """The curve of one symbol's account, a bar at a time."""
    out, cash, size, won, lost, most, least = [], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    peak = trough = capital
    down = down_percent = up = up_percent = 0.0
    fills, trades, close = list(fills), list(trades), None
    for i, (time, high, low, c) in enumerate(bars):
        end, close = time + dt.timedelta(days=1), c if c is not None else close
        high, low = (close if x is None else x for x in (high, low))
        while fills and fills[0][1] < end:
            _, _, qty, price, fee, _ = fills.pop(0)
            size, cash = size + qty, cash - qty * price - (fee or 0)
            most, least = max(most, size), min(least, size)
        for t in [t for t in trades if t[3] < end]:
            trades.remove(t)
            won, lost = won + max(t[7], 0), lost + max(-t[7], 0)
        real, value = capital + won - lost, capital + cash + size * close
        peak, trough = max(peak, real), min(trough, real)
        worst, best = value + size * ((low if size > 0 else high) - close), value + size * ((high if size > 0 else low) - close)
        down, down_percent = max(down, peak - worst), max(down_percent, 100 * (peak - worst) / peak)
        up, up_percent = max(up, best - trough), max(up_percent, 100 * (best - trough) / best if best > 0 else 0)
        out.append((i, value, won - lost, value - real, won, lost, size, down, down_percent, up, up_percent, most, -least))
    return out


def test_the_curve_of_an_account_equals_one_kept_bar_by_bar(spark):
    """Fills on days without bars, before the first and after the last one too; bars without prices; symbols without fills, and without bars."""
    rng = random.Random(5)
    fills = random_fills(11, 200, ["a", "a", "b", "nowhere"])
    days = [START + dt.timedelta(days=d) for d in range(2, 15) if d not in (4, 5, 9)]
    bars = {s: [(day, c + 2, c - 3, c) for day, c in ((d, rng.choice([9.0, 10.0, 11.0, 14.0])) for d in days)] for s in ("a", "b", "idle")}
    bars["a"][4] = (bars["a"][4][0], None, None, None)
    frame = spark.createDataFrame([(s, t, i, h, lo, c) for s, rows in bars.items() for i, (t, h, lo, c) in enumerate(rows)], "symbol string, time timestamp_ntz, bar_index int, high double, low double, close double")
    df = spark.createDataFrame(fills, SCHEMA)
    order, block, day = ("time", "n"), F.date_trunc("month", "time"), lambda t: F.date_trunc("day", t).cast("timestamp_ntz")
    trades, _ = fifo.match(df, block, order)
    got = account.curve(frame, df, trades, day, block, order, broker.Config(initial_capital=1000.0))
    names = "bar_index equity net_profit open_profit gross_profit gross_loss position_size max_drawdown max_drawdown_percent max_runup max_runup_percent held_long held_short".split()
    seen = defaultdict(list)
    for r in got.orderBy("symbol", "bar_index").collect():
        seen[r.symbol].append(tuple(r[n] for n in names))
    ordered = sorted(fills, key=lambda f: (f[1], f[5]))
    assert set(seen) == set(bars)
    for s, rows in bars.items():
        own = [f for f in ordered if f[0] == s]
        want = marked(rows, own, [t for t in paired(own)[0]], 1000.0)
        assert len(want) == len(seen[s])
        for a, b in zip(seen[s], want, strict=True):
            assert a == pytest.approx(b, abs=1e-5)
    at = {t: i for i, (t, *_) in enumerate(bars["a"])}
    for r in account.placed(trades, frame, day).where("symbol = 'a'").collect():
        assert (r.entry_bar_index, r.exit_bar_index) == tuple(at.get(t.replace(hour=0)) for t in (r.entry_time, r.exit_time))
    month = {r.symbol: r for r in account.months(got, broker.Config(initial_capital=1000.0)).collect()}
    assert month["idle"].gain_percent == 0 and month["a"].equity == pytest.approx(seen["a"][-1][1]) and month["a"].bars == len(days)


def test_an_account_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    bars = spark.createDataFrame([], "symbol string, time timestamp_ntz, bar_index int, high double, low double, close double")
    one = spark.createDataFrame([("a", START, 0, None, None, None)], bars.schema)
    trades, _ = fifo.match(empty, F.col("time"), ("time", "n"))
    assert account.curve(bars, empty, trades, lambda t: t, F.col("time"), ("time", "n")).count() == 0
    (row,) = account.curve(one, empty, trades, lambda t: t, F.col("time"), ("time", "n")).collect()
    assert row.equity == 100_000 and row.close is None and row.max_drawdown == 0
