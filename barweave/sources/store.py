"""A store of bars in chunks that a manifest tells about, and a cache that fetches what the store does not have.

Bars lie in folders of at most ``chunk`` bars of one symbol and timeframe. The manifest has a row for each folder: symbol,
timeframe, first and last time, rows. A range is read from the folders whose times meet it and from no others; what folder is
read is decided by the manifest before any of them is opened. A folder counts once the manifest names it, so a write that is
lost half-way leaves nothing to be read, and a folder is taken out of the manifest before it is deleted.

The cache holds which ranges of time it covers, which is not what bars there are: a closed market has none. A request
less what is covered gives the ranges to fetch, each once; then they are covered. Ranges begin inside and end outside.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.resample import last_per_time
from ..plans.bars import number

MANIFEST = "folder string, symbol string, timeframe string, first timestamp_ntz, last timestamp_ntz, rows long, written long, gone boolean"
COVERED = "symbol string, timeframe string, start timestamp_ntz, end timestamp_ntz"
PRICES = "open double, high double, low double, close double, volume double"


def missing(requests: DataFrame, covered: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, start, end): the parts of requests that covered does not have, those that touch as one; both are (keys, start, end).

    Ends of ranges in order, with how many requests and covers are open after each: a sum for each place, no pairs of ranges.
    Ranges with a null or that end where they begin, or before, are none.
    """

    def ends(df: DataFrame, r: int, c: int) -> DataFrame:
        df = df.where(F.col("start") < F.col("end"))
        one = df.select(*keys, F.col("start").alias("at"), F.lit(r).alias("r"), F.lit(c).alias("c"))
        return one.unionAll(df.select(*keys, F.col("end").alias("at"), F.lit(-r).alias("r"), F.lit(-c).alias("c")))

    w = Window.partitionBy(*keys).orderBy("at")
    both = ends(requests, 1, 0).unionAll(ends(covered, 0, 1)).groupBy(*keys, "at").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    open_ = (F.sum("r").over(w) > 0) & (F.sum("c").over(w) == 0)
    parts = both.select(*keys, "at", F.lead("at").over(w).alias("end"), open_.alias("open")).withColumn("before", F.lag("open").over(w))
    parts = parts.where("open").withColumn("run", F.sum(F.when(F.coalesce("before", F.lit(False)), 0).otherwise(1)).over(w))
    return parts.groupBy(*keys, "run").agg(F.min("at").alias("start"), F.max("end").alias("end")).drop("run")


class Store:
    """Bars at path, read by range through the manifest; hits and misses are counted, and the folders used last are kept."""

    def __init__(self, spark: SparkSession, path: str, chunk: int = 64_000):
        self.spark, self.path, self.chunk = spark, path.rstrip("/"), chunk
        self.used: dict[str, int] = {}  # folder -> the read it was last part of
        self.hits = self.misses = self.evictions = self.reads = 0

    def _rows(self, name: str, schema: str) -> DataFrame:
        """A table of appended rows, empty before the first of them."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """The folders that count."""
        rows = self._rows("manifest", MANIFEST)
        gone = rows.where("gone").select("folder")
        return rows.where("not gone").join(gone, "folder", "left_anti").drop("gone")

    def put(self, bars: DataFrame, timeframe: str) -> None:
        """Adds bars (symbol, time, open, high, low, close, volume); where the store has a bar of that time, the later one counts."""
        batch, now = uuid.uuid4().hex, F.lit(self._next())
        place = F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1
        cut = bars.where("symbol is not null and time is not null").withColumn("part", F.floor(place / self.chunk))
        at = f"{self.path}/bars/{batch}"
        cut.select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume", F.col("symbol").alias("of"), "part").repartition("of", "part").write.partitionBy("of", "part").parquet(at)
        written = self.spark.read.parquet(at).withColumn("folder", F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1))
        rows = written.groupBy("folder", "symbol").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("rows"))
        rows.select("folder", "symbol", F.lit(timeframe).alias("timeframe"), "first", "last", "rows", now.cast("long").alias("written"), F.lit(False).alias("gone")).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _next(self) -> int:
        return 1 + (self._rows("manifest", MANIFEST).agg(F.max("written")).first()[0] or 0)

    def get(self, symbol: str, timeframe: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
        """The bars from start up to end, numbered."""
        a, b = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
        found = self.manifest().where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe) & (F.col("last") >= a) & (F.col("first") < b)).collect()
        self.reads += 1
        self.hits, self.misses = self.hits + len(found), self.misses + (not found)
        self.used |= {r.folder: self.reads for r in found}
        if not found:
            return number(self.spark.createDataFrame([], f"symbol string, time timestamp_ntz, {PRICES}"))
        kind = f"symbol string, time timestamp_ntz, {PRICES}"
        age = F.create_map(*[F.lit(x) for r in found for x in (r.folder, r.written)])
        rows = self.spark.read.schema(kind).parquet(*[r.folder for r in found]).where((F.col("time") >= a) & (F.col("time") < b))
        if len({r.written for r in found}) > 1:  # several writes may have a bar of one time
            rows = last_per_time(rows.withColumn("_age", age[F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1)]), F.col("_age")).drop("_age")
        return number(rows)

    def evict(self, most: int) -> int:
        """Deletes all but the most folders used last, of those not used at all the oldest first; how many went."""
        held = self.manifest().select("folder", "written", "symbol", "timeframe", "first", "last", "rows").collect()
        late = sorted(held, key=lambda r: (self.used.get(r.folder, 0), r.written, str(r.first)))[: max(0, len(held) - most)]
        if late:
            self.spark.createDataFrame([(r.folder, r.symbol, r.timeframe, r.first, r.last, r.rows, r.written, True) for r in late], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        for r in late:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(r.folder)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self.used.pop(r.folder, None)
        self.evictions += len(late)
        return len(late)

    def stats(self) -> DataFrame:
        """One row: folders, bars, hits, misses, evictions, and the share of hits."""
        held = self.manifest().agg(F.count("*").alias("folders"), F.coalesce(F.sum("rows"), F.lit(0)).alias("bars"))
        asked = self.hits + self.misses
        return held.select("*", *[F.lit(getattr(self, n)).alias(n) for n in ("hits", "misses", "evictions")], F.lit(self.hits / asked if asked else 0.0).alias("hit_rate"))


class Cache:
    """Ranges of bars from the store, and from fetch(spark, symbol, timeframe, start, end) where it does not cover them."""

    def __init__(self, store: Store, fetch: Callable[..., DataFrame]):
        self.store, self.fetch, self.spark = store, fetch, store.spark

    def covered(self) -> DataFrame:
        return self.store._rows("covered", COVERED)

    def get(self, symbol: str, timeframe: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
        if start >= end:
            return self.store.get(symbol, timeframe, start, start)
        self.fill([(symbol, timeframe, start, end)])
        return self.store.get(symbol, timeframe, start, end)

    def fill(self, requests: Iterable[tuple[str, str, dt.datetime, dt.datetime]]) -> int:
        """Fetches what requests need and the store does not cover, each range once; how many ranges that were."""
        keys = ("symbol", "timeframe")
        ranges = missing(self.spark.createDataFrame(list(requests), COVERED), self.covered(), keys).orderBy(*keys, "start").collect()
        for r in ranges:  # the caller's few requests
            self.store.put(self.fetch(self.spark, r.symbol, r.timeframe, r.start, r.end), r.timeframe)
            self.cover([(r.symbol, r.timeframe, r.start, r.end)])
        return len(ranges)

    def cover(self, ranges: list[tuple[str, str, dt.datetime, dt.datetime]]) -> None:
        """Counts ranges as there, such as those of bars that were put by hand."""
        self.spark.createDataFrame(ranges, COVERED).coalesce(1).write.mode("append").parquet(f"{self.store.path}/covered")
