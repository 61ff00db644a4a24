"""Exchange payloads as a data source: files are pruned by pushed filters, and a stream reads each once."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.functions import matrices as Z
from barweave.sources import exchange

T0 = dt.datetime(2024, 1, 1)
MS = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
DAY = 86_400_000


def put(folder, symbol, day, bad=()):
    first = MS + day * DAY
    rows = [[first + k * 3_600_000, "1.5", "2", "1", str(1 + k / 10), "3", 0, "0", 1, "0", "0", "0"] for k in range(24)]
    (folder / f"{symbol}-60-{first}-{first + 23 * 3_600_000}.json").write_text(json.dumps([*rows, *bad]))


@pytest.fixture
def folder(tmp_path):
    for day in range(4):
        put(tmp_path, "A", day, bad=[[None] * 12, [1], "x", [MS + day * DAY, None, 1, 1, 1, 1]] if day == 2 else ())
    put(tmp_path, "B", 1)
    (tmp_path / "readme.txt").write_text("none of its own")
    return tmp_path


def test_filters_go_to_the_source(spark, folder):
    exchange.register(spark)
    df = spark.read.format("klines").load(str(folder))
    assert df.count() == 120 and df.columns == [c.split(" ")[0] for c in exchange.SCHEMA.split(", ")]
    some = df.where((F.col("symbol") == "A") & (F.col("time") >= T0 + dt.timedelta(days=1, hours=20)) & (F.col("time") < T0 + dt.timedelta(days=2, hours=3)) & (F.col("close") > 1))
    rows = some.collect()
    assert sorted(r.time for r in rows) == [T0 + dt.timedelta(days=1, hours=h) for h in (20, 21, 22, 23, 25, 26)]  # the close of hour 24 is 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter", 1)[1].split("\n")[0]  # what Spark still has to look at
    assert "BatchScan klines" in plan and "(close#" in left and "> 1.0" in left and "symbol" not in left.replace("isnotnull(symbol", "") and ">=" not in left
    assert some.rdd.getNumPartitions() == 2  # of five files those two that may have such rows
    assert df.where(F.col("symbol").isin("B", "C")).count() == 24 and df.where("symbol = 'A' and symbol = 'B'").count() == 0
    assert df.where(F.col("time") <= T0).count() == 1 and df.where(F.col("time") > T0 + dt.timedelta(days=3)).count() == 23
    assert df.where(F.col("timeframe") == "5").count() == 0


def test_a_stream_reads_each_file_once(spark, folder, tmp_path_factory):
    exchange.register(spark)
    out, at = (str(tmp_path_factory.mktemp(n)) for n in ("out", "c"))

    def run():
        q = spark.readStream.format("klines").load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out).groupBy("symbol").count().orderBy("symbol").collect()

    assert [tuple(r) for r in run()] == [("A", 96), ("B", 24)]
    assert [tuple(r) for r in run()] == [("A", 96), ("B", 24)]
    put(folder, "A", 9)
    assert [tuple(r) for r in run()] == [("A", 120), ("B", 24)]


def test_matrices_in_columns_equal_numpy(spark):
    rng = np.random.default_rng(3)
    ms = [rng.normal(size=(n, n)).round(2) for n in (1, 2, 3, 4, 6) for _ in range(4)]
    ms += [np.array([[0.0, 1], [1, 0]]), np.array([[1.0, 2], [2, 4]]), np.zeros((3, 3)), np.eye(4)[[2, 0, 3, 1]], np.array([[0.0, 0, 1], [0, 2, 5], [3, 1, 1]])]
    odd = [np.arange(6.0).reshape(2, 3), np.arange(8.0).reshape(4, 2)]
    data = [(i, m.tolist()) for i, m in enumerate(ms + odd)] + [(90, None), (91, []), (92, [[1.0, None], [2.0, 3.0]]), (93, [[1.0], [2.0, 3.0]])]
    m = F.col("m")
    df = spark.createDataFrame(data, "i int, m array<array<double>>").select("i", Z.det(m).alias("det"), Z.inv(m).alias("inv"), Z.rank(m).alias("rank"), Z.pow_(m, 5).alias("five"), Z.pow_(m, 0).alias("none"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r for r in df.collect()}
    for i, x in enumerate(ms):
        assert got[i].det == pytest.approx(np.linalg.det(x), abs=1e-9) and got[i].rank == np.linalg.matrix_rank(x, 1e-10)
        assert np.allclose(got[i].five, np.linalg.matrix_power(x, 5)) and np.allclose(got[i].none, np.eye(len(x)))
        assert got[i].inv is None if abs(np.linalg.det(x)) < 1e-12 else np.allclose(got[i].inv, np.linalg.inv(x))
    for i, x in enumerate(odd, len(ms)):
        assert got[i].det is got[i].inv is got[i].five is None and got[i].rank == np.linalg.matrix_rank(x)
    for i in (90, 91, 92, 93):
        assert tuple(got[i])[1:] == (None,) * 5, i
