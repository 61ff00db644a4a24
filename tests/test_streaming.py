"""A stream of ticks gives the bars of a batch run, and payloads become bars."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barweave.functions import matrices as Z
from barweave.functions import strings as S
from barweave.functions import times as T
from barweave.operators import recursive as R
from barweave.sources import feeds
from barweave.streaming import ticks as K

CLOSES = [50 + (7 * k * k) % 23 for k in range(15)]


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A" if i % 2 else "B", t0 + dt.timedelta(seconds=7 * i), 100.0 + (i * 37 % 11), float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp, price double, volume double")
    late = spark.createDataFrame([("A", t0 + dt.timedelta(days=1), 1.0, 0.0)], df.schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all bars
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = K.bars(stream).writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.table("made").collect()}
    finally:
        q.stop()
    assert got == {tuple(r) for r in K.bars(df).collect()}


def test_carried_average(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "symbol string, time timestamp, close double"
    for k in range(3):
        spark.createDataFrame([("A", t0 + dt.timedelta(minutes=i), float(CLOSES[i])) for i in range(5 * k, 5 * k + 5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = K.smoothed(stream, 4).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = [r.ema for r in spark.table("carried").orderBy("time").collect()]
    finally:
        q.stop()
    want = R.ema([float(c) for c in CLOSES], 4)
    assert got[:3] == [None] * 3 and got[3:] == pytest.approx(want[3:])


def test_messages(spark):
    df = spark.createDataFrame([('{"s":"X","p":"1.5","q":"2","T":1700000000000}',), ('{"symbol":"Y","price":3,"time":1700000001000}',), ("junk",)], "value string")
    assert [(r.symbol, r.price, r.volume) for r in K.parse(df).orderBy("symbol").collect()] == [("X", 1.5, 2.0), ("Y", 3.0, 0.0)]


def test_chart_payload_drops_missing_prices(spark):
    j = '{"chart":{"result":[{"timestamp":[1700000000,1700000060,1700000120],"indicators":{"quote":[{"open":[1,null,3],"high":[2,2,4],"low":[1,1,2],"close":[1.5,1,3.5],"volume":[10,null,null]}]}}]}}'
    got = feeds.chart_json(spark.createDataFrame([(j,)], "value string"), "X").orderBy("time").collect()
    assert [(r.bar_index, r.open, r.volume) for r in got] == [(0, 1.0, 10.0), (1, 3.0, 0.0)]


def test_store_prunes_and_finds_gaps(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 30)
    rows = [("X", t0 + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5, 10.0) for i in range(6)]
    bars = feeds.from_rows(spark, rows)
    feeds.write_bars(bars, str(tmp_path / "s"), "D")
    got = feeds.read_bars(spark, str(tmp_path / "s"), "X", "D", "2024-02-01", "2024-02-03")
    assert got.count() == 2
    assert "PartitionFilters: [isnotnull(" in got._jdf.queryExecution().executedPlan().toString()
    assert feeds.is_complete(bars, "D").first().complete
    assert not feeds.is_complete(bars.where("bar_index <> 3"), "D").first().complete
    assert feeds.alerts(bars, F.col("bar_index") >= 2, "m", once_per_bar=False).count() == 1


def test_timeframes():
    assert [T.in_seconds(x) for x in ("5", "30S", "D", "2W", "M")] == [300, 30, 86_400, 1_209_600, 2_592_000]
    assert [T.from_seconds(x) for x in (300, 30, 86_400, 604_800)] == ["5", "30S", "D", "W"]
    assert (T.source_grain("10"), T.source_grain("90", ("1", "15", "60")), T.source_grain("2W", ("60", "D"))) == ("5", "15", "D")


def test_text_formats(spark):
    df = spark.createDataFrame([(1234.5678, "a.b.c")], "x double, s string")
    x, s = F.col("x"), F.col("s")
    got = df.select(S.tostring(x, "#.##"), S.tostring(x, "0.000"), S.tostring(x, "percent"), S.tostring(F.lit(2.0), "#.##"), S.replace(s, ".", "-", 1), S.pos(s, "z"), S.format_("v={0,number,#.#}", x)).first()
    assert tuple(got) == ("1234.57", "1234.568", "123456.78%", "2", "a.b-c", None, "v=1234.6")


def test_matrix_predicates_and_eigen(spark):
    df = spark.createDataFrame([([[2.0, 1.0], [1.0, 2.0]],), ([[1.0, 0.0], [0.0, 1.0]],), ([[0.0, 1.0], [-1.0, 0.0]],)], "m array<array<double>>")
    m = F.col("m")
    got = df.select(Z.is_symmetric(m), Z.is_identity(m), Z.is_antisymmetric(m), Z.is_stochastic(m), Z.is_triangular(m)).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False, False), (True, True, False, True, True), (False, False, True, False, False)]
    rows = df.select("m", Z.eigenvalues(m).alias("l"), Z.eigenvectors(m).alias("v")).collect()
    assert rows[0].l == [3.0, 1.0] and rows[2].l is None and rows[2].v is None
    a, v = rows[0].m, [r[0] for r in rows[0].v]
    assert [sum(x * y for x, y in zip(r, v, strict=True)) for r in a] == pytest.approx([3 * z for z in v])
