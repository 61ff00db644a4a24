"""Bars from files, chart services' JSON and caller's rows; sinks for bars, trades and alerts.

Network services are reached through ``register`` and Spark's own readers; what is here turns their
payloads into bars, so the same code reads files in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import in_seconds
from ..plans.bars import clean, number

KLINE = "openTime long, open double, high double, low double, close double, volume double, closeTime long, quoteAssetVolume double, numberOfTrades long, takerBuyBaseAssetVolume double, takerBuyQuoteAssetVolume double, ignore string"
BARS = "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double"
TRADES_CSV = ("entry_id", "size", "entry_time", "entry_price", "exit_id", "exit_time", "exit_price", "profit", "commission", "max_runup", "max_drawdown")

_providers: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, read: Callable[..., DataFrame]) -> None:
    """read(spark, symbol, timeframe, start, end) -> bars."""
    _providers[name] = read


def provider(name: str) -> Callable[..., DataFrame]:
    return _providers[name]


def ms(column: str):
    return F.timestamp_millis(F.col(column)).cast("timestamp_ntz")


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Bars from a caller's tuples (symbol, time, open, high, low, close, volume)."""
    return number(spark.createDataFrame(rows, BARS))


def klines(spark: SparkSession, path: str, symbol: str, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Files of 12-field rows as JSON objects; limit counts from the first."""
    df = spark.read.schema(KLINE).json(path, multiLine=True).withColumn("symbol", F.lit(symbol)).withColumn("time", ms("openTime"))
    if start is not None:
        df = df.where(F.col("openTime") >= start)
    if end is not None:
        df = df.where(F.col("openTime") <= end)
    df = number(df.dropDuplicates(["openTime"]))
    return df if limit is None else df.where(F.col("bar_index") < limit)


def chart_json(raw: DataFrame, symbol: str, column: str = "value") -> DataFrame:
    """Bars from chart payloads with parallel arrays of times (seconds) and quotes; rows with a missing price go."""
    quote = "struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"
    kind = f"struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<{quote}>>>>>>"
    r = F.from_json(F.col(column), kind)["chart"]["result"][0]
    q = r["indicators"]["quote"][0]
    rows = raw.select(F.explode(F.arrays_zip(r["timestamp"].alias("t"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"))).alias("x"))
    made = rows.select(F.lit(symbol).alias("symbol"), F.timestamp_seconds("x.t").cast("timestamp_ntz").alias("time"), *[clean(F.col(f"x.{c}")).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("x.volume", F.lit(0.0)).alias("volume"))
    return number(made.dropna(subset=["open", "high", "low", "close"]))


def write_bars(bars: DataFrame, path: str, timeframe: str) -> None:
    """The persistent store: Parquet by symbol, timeframe and month, so that ranges prune folders and row groups."""
    df = bars.withColumn("timeframe", F.lit(timeframe)).withColumn("month", F.date_format("time", "yyyy-MM"))
    df.repartition("symbol", "month").sortWithinPartitions("time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe", "month").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A range of the store; start and end also prune months."""
    df = spark.read.option("basePath", path).parquet(path)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe)
    if start is not None:
        df = df.where((F.col("month").cast("string") >= start[:7]) & (F.col("time") >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        df = df.where((F.col("month").cast("string") <= end[:7]) & (F.col("time") < F.lit(end).cast("timestamp_ntz")))
    return number(df.drop("bar_index", "month"))


def is_complete(bars: DataFrame, timeframe: str) -> DataFrame:
    """(symbol, complete): whether no step is over one and a half bars."""
    w = Window.partitionBy("symbol").orderBy("time")
    step = F.unix_timestamp("time") - F.unix_timestamp(F.lag("time").over(w))
    return bars.select("symbol", step.alias("s")).groupBy("symbol").agg((F.coalesce(F.max("s"), F.lit(0)) <= 1.5 * in_seconds(timeframe)).alias("complete"))


def write_trades_csv(trades: DataFrame, path: str) -> None:
    """RFC 4180: quotes doubled, a header."""
    trades.select(*TRADES_CSV).write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def alerts(bars: DataFrame, condition, message: str, once_per_bar: bool = True) -> DataFrame:
    """(symbol, time, message) where the condition holds; at most one for each bar, or only where it begins to hold."""
    w = Window.partitionBy("symbol").orderBy("bar_index")
    df = bars.withColumn("_c", F.coalesce(condition, F.lit(False)))
    if not once_per_bar:
        df = df.withColumn("_c", F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False)))
    return df.where("_c").select("symbol", "time", F.lit(message).alias("message"))
