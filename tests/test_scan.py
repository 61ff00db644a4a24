"""The chunked scans against the plain loops, over gaps, chunk borders, several symbols and late starts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barweave.operators import recursive as R
from barweave.operators import scan

NA = math.nan


def close():
    return F.col("close")


@pytest.fixture(scope="module")
def series():
    """Symbols with a walk, gaps of all lengths, a late start, values of one size, none at all, and a single bar."""
    rng = random.Random(4)
    out = {}
    for symbol, gap, late, bars in (("walk", 0, 0, 150), ("gaps", 0.3, 0, 130), ("late", 0.1, 57, 140), ("sparse", 0.93, 3, 200), ("flat", 0, 0, 40), ("none", 1, 0, 30), ("one", 0, 0, 1)):
        p, rows = 100.0, []
        for i in range(bars):
            p = p if symbol == "flat" else p + rng.uniform(-3, 3)
            h, low, c = p + (symbol != "flat") * rng.random(), p - (symbol != "flat") * rng.random(), p
            missing = [i < late or rng.random() < gap for _ in range(3)] if gap < 1 else [True] * 3
            rows.append([NA if m else v for m, v in zip(missing, (h, low, c), strict=True)])
        out[symbol] = rows
    return out


@pytest.fixture(scope="module")
def bars(spark, series):
    rows = [(s, i, *(None if math.isnan(v) else v for v in r)) for s, rs in series.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "symbol string, bar_index int, high double, low double, close double").repartition(3).cache()


def held(df, series, names, kernel, *args, columns=(2,)):
    got = {}
    for r in df.collect():
        got[r.symbol, r.bar_index] = [r[n] for n in names]
    assert len(got) == sum(map(len, series.values()))
    for symbol, rows in series.items():
        want = kernel(*[[r[k] for r in rows] for k in columns], *args)
        want = want if len(names) > 1 else (want,)
        for j, name in enumerate(names):
            for i, w in enumerate(want[j]):
                g = got[symbol, i][j]
                assert (g is None) == math.isnan(w), (symbol, i, name, g, w)
                assert g is None or g == pytest.approx(w, rel=1e-9, abs=1e-9), (symbol, i, name)


@pytest.mark.parametrize("chunk", [4, 7, 512])
def test_averages(bars, series, chunk):
    held(scan.ema(bars, "e", close(), 5, chunk), series, ["e"], R.ema, 5)
    held(scan.rma(bars, "e", close(), 9, chunk), series, ["e"], R.rma, 9)
    held(scan.ema(bars, "e", close(), 1, chunk), series, ["e"], R.ema, 1)
    both = scan.smooth(bars, scan.exponential("a", close(), 3, held=True), scan.exponential("b", close(), 1, held=True), scan.wilder("c", F.col("high"), 30), chunk=chunk)
    held(both, series, ["a"], R._held, 3)
    held(both, series, ["b"], R._held, 1)
    assert both.columns == [*bars.columns, "a", "b", "c"]


@pytest.mark.parametrize("chunk", [5, 512])
def test_operators(bars, series, chunk):
    held(scan.atr(bars, "v", 6, chunk=chunk), series, ["v"], R.atr, 6, columns=(0, 1, 2))
    held(scan.rsi(bars, "v", close(), 5, chunk), series, ["v"], R.rsi, 5)
    held(scan.macd(bars, ("m", "s", "h"), close(), 3, 7, 4, chunk), series, ["m", "s", "h"], R.macd, 3, 7, 4)
    held(scan.kc(bars, ("m", "u", "l"), close(), 4, 2.0, chunk=chunk), series, ["m", "u", "l"], R.kc, 4, 2.0, columns=(2, 0, 1, 2))
    held(scan.kc(bars, ("m", "u", "l"), close(), 4, 2.0, False, chunk), series, ["m", "u", "l"], R.kc, 4, 2.0, False, columns=(2, 0, 1, 2))
    held(scan.kcw(bars, "v", close(), 4, 2.0, chunk=chunk), series, ["v"], R.kcw, 4, 2.0, columns=(2, 0, 1, 2))
    held(scan.dmi(bars, ("p", "m", "a"), 4, 3, chunk), series, ["p", "m", "a"], R.dmi, 4, 3, columns=(0, 1, 2))
    held(scan.tsi(bars, "v", close(), 3, 6, chunk), series, ["v"], R.tsi, 3, 6)
    held(scan.atr(bars, "v", 1, chunk=chunk), series, ["v"], R.atr, 1, columns=(0, 1, 2))
    held(scan.rsi(bars, "v", close(), 1, chunk), series, ["v"], R.rsi, 1)
    held(scan.kc(bars, ("m", "u", "l"), close(), 1, 2.0, chunk=chunk), series, ["m", "u", "l"], R.kc, 1, 2.0, columns=(2, 0, 1, 2))


def test_previous_values(bars, series):
    got = {(r.symbol, r.bar_index): (r.a, r.b) for r in scan.previous(bars, 4, a=(close(), None), b=(close(), close().isNotNull())).collect()}
    for symbol, rows in series.items():
        last = None
        for i, r in enumerate(rows):
            before = None if i == 0 or math.isnan(rows[i - 1][2]) else rows[i - 1][2]
            assert got[symbol, i] == (before, last)
            last = last if math.isnan(r[2]) else r[2]


def test_a_symbol_runs_in_many_tasks(spark):
    """Rows are dealt by symbol and chunk, in one exchange for window, chunk sums and join; no Python, no window over all bars of a symbol."""
    df = spark.range(20_000).select(F.substring(F.concat(F.lit("a"), "id"), 1, 1).alias("symbol"), F.col("id").cast("int").alias("bar_index"), (F.col("id") % 97).cast("double").alias("close"))
    got = scan.ema(df, "e", close(), 14)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final  # rows move once, for the windows and for the sums of chunks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = got.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts == 4
    e = R.ema([float(i % 97) for i in range(20_000)], 14)
    last = got.where("bar_index = 19999").first().e
    assert last == pytest.approx(e[-1], rel=1e-12)


def test_bars_without_symbol_and_bad_weights(spark):
    df = spark.createDataFrame([(None, i, 1.0) for i in range(9)], "symbol string, bar_index int, close double")
    assert [r.e for r in scan.ema(df, "e", close(), 3).orderBy("bar_index").collect()] == [None, None, *[1.0] * 7]
    for v in (scan.Average("x", close(), 0, 0.5), scan.Average("x", close(), 3, 0.0), scan.Average("x", close(), 3, 1.5), scan.Average("x", close(), 3, 1.0), scan.Average("x", lambda b, p: b, 3, 0.1), scan.Average("x", close(), 3, 0.99)):
        with pytest.raises(ValueError, match="x"):
            scan.smooth(df, v)
    assert scan.ema(df.limit(0), "e", close(), 3).count() == 0
