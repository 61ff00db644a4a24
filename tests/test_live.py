"""Live bars: provisional values leave no drift, a restart in the middle of a bar changes nothing, and a store that streams replace and append to."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import recursive as R
from barweave.streaming import live as L

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, time timestamp, price double, volume double"
MADE = (L.ema("ema", 3), L.rsi("rsi", 4), L.atr("atr", 3), L.macd(("line", "signal", "hist"), 2, 4, 3))


@pytest.fixture(scope="module")
def ticks():
    """Ticks of two symbols over some 60 minutes, some minutes empty for one of them."""
    rng, out, p = random.Random(9), [], 100.0
    for s in range(0, 3600, 9):
        p += rng.uniform(-1, 1)
        out.append(("A" if s % 2 else "B" if s % 600 < 400 else "A", T0 + dt.timedelta(seconds=s), round(p, 2), float(rng.randrange(3))))
    return out


def closed_bars(ticks, symbol):
    bars = {}
    for s, t, p, v in ticks:
        if s == symbol:
            b = bars.setdefault(t.replace(second=0), [p, p, p, p, 0.0])
            bars[t.replace(second=0)] = [b[0], max(b[1], p), min(b[2], p), p, b[4] + v]
    return [bars[k] for k in sorted(bars)][:-1]  # the last is open


def stream(spark, tmp_path, batches, name, stop_after=None):
    """Runs batches as micro-batches of one query, which is stopped and started again after stop_after of them."""
    at = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(at / f"d{k}"))
    (at / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKS)
    try:
        for part in (range(stop_after or len(batches)), range(stop_after or len(batches), len(batches))):
            for k in part:
                for f in (at / f"d{k}").glob("part-*"):
                    f.rename(at / "in" / f"{k:03}-{f.name}")
                read = spark.readStream.schema(SCHEMA).parquet(str(at / "in"))
                q = L.indicators(read, 60, *MADE).writeStream.foreachBatch(L.upsert(str(at / "out"))).option("checkpointLocation", str(at / "c")).trigger(availableNow=True).start()
                q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return at


def test_provisional_bars_and_restarts_leave_the_batch_result(spark, tmp_path, ticks):
    cuts = [0, 3, 4, 90, 93, 260, len(ticks)]  # every micro-batch is a run of its own from the checkpoint, most end within a bar
    at = stream(spark, tmp_path, [ticks[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [[("A", T0, 1.0, 1.0)]], "live")
    got = L.latest(spark, str(at / "out")).orderBy("symbol", "time").collect()
    for symbol in "AB":
        want = closed_bars(ticks, symbol)
        rows = [r for r in got if r.symbol == symbol and r.confirmed]
        assert [[r.open, r.high, r.low, r.close, r.volume] for r in rows] == want
        assert [r.bar_index for r in rows] == list(range(len(want)))
        _, h, low, c, _ = zip(*want, strict=True)
        series = {"ema": R.ema(c, 3), "rsi": R.rsi(c, 4), "atr": R.atr(h, low, c, 3)} | dict(zip(("line", "signal", "hist"), R.macd(c, 2, 4, 3), strict=True))
        for name, values in series.items():
            for r, w in zip(rows, values, strict=True):
                assert (r[name] is None) == math.isnan(w) and (r[name] is None or r[name] == pytest.approx(w)), (symbol, name)
        assert [r.confirmed for r in got if r.symbol == symbol][-1] is False  # the open bar stands beside them
    assert len(got) == len({(r.symbol, r.time) for r in got})


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    at = str(tmp_path / "store")
    bars = "symbol string, time timestamp, close double, confirmed boolean, ticks long"
    one = [("A", T0, 1.0, True, 3), ("A", T0 + dt.timedelta(minutes=1), 2.0, False, 1), ("B", T0, 5.0, False, 1), (None, T0, 9.0, True, 1)]
    two = [("A", T0 + dt.timedelta(minutes=1), 2.5, False, 4), ("A", T0 + dt.timedelta(minutes=1), 2.7, True, 2), ("A", T0 + dt.timedelta(minutes=2), 3.0, False, 1)]
    write = L.upsert(at)
    for number, rows in ((0, one), (1, two), (1, two), (0, one), (1, two)):
        write(spark.createDataFrame(rows, bars), number)
        if number:
            kept = {(r.symbol, r.time.minute): r.close for r in L.latest(spark, at).collect()}
            assert kept == {("A", 0): 1.0, ("A", 1): 2.7, ("A", 2): 3.0, ("B", 0): 5.0}
    before = sorted(map(tuple, L.latest(spark, at).collect()))
    L.compact(spark, at)
    assert [p.name for p in (tmp_path / "store").glob("batch=*")] == ["batch=1"]
    assert sorted(map(tuple, L.latest(spark, at).collect())) == before
    write(spark.createDataFrame([("B", T0, 6.0, True, 2)], bars), 2)
    assert {r.symbol: r.close for r in L.latest(spark, at).where("symbol = 'B'").collect()} == {"B": 6.0}


def test_indicators_are_pure():
    for m in MADE:
        s = list(m.start)
        for k in range(9):
            bar = (1.0 + k, 3.0 + k % 3, 0.5, 2.0 + k % 4, 1.0)
            kept = list(s)
            assert str(m.step(s, bar)) == str(m.step(s, bar)) and str(s) == str(kept)
            s = m.step(s, bar)[0]
            assert len(s) == len(m.start)
