"""Bars from bars, and series across timeframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import align

MERGE = "first open, largest high, smallest low, last close, summed volume"


def _merge(bars: DataFrame, *keys: str) -> DataFrame:
    made = bars.groupBy("symbol", *keys).agg(F.min("time").alias("time"), F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"))
    w = Window.partitionBy("symbol").orderBy("time")
    return made.withColumn("bar_index", F.row_number().over(w) - 1).drop(*keys)


def by_calendar(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe; time is the bucket's open."""
    made = _merge(bars.withColumn("_b", align(F.col("time"), timeframe)), "_b")
    return made.withColumn("time", align(F.col("time"), timeframe))


def by_ratio(bars: DataFrame, k: int, gap: float = 1.5) -> DataFrame:
    """Groups of k bars on end. A step over gap times the least of the first 20 steps starts a new group."""
    w = Window.partitionBy("symbol").orderBy("time")
    step = F.unix_timestamp("time") - F.unix_timestamp(F.lag("time").over(w))
    df = bars.withColumn("_n", F.row_number().over(w)).withColumn("_s", step)
    ahead = w.rowsBetween(Window.unboundedPreceding, 19)  # on every bar these hold all of the first 20
    least = F.min(F.when(F.col("_n") <= 20, F.col("_s"))).over(ahead)
    start = F.when((F.col("_n") == 1) | (F.col("_s") > gap * least), F.col("_n"))
    df = df.withColumn("_start", start).withColumn("_island", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _merge(df.withColumn("_group", F.floor((F.col("_n") - F.col("_island")) / k)), "_island", "_group")


def gaps(bars: DataFrame, seconds: int, most: float = 1.5) -> DataFrame:
    """Where the next bar is more than most steps away: (symbol, time, next_time)."""
    nxt = F.lead("time").over(Window.partitionBy("symbol").orderBy("time"))
    return bars.withColumn("next_time", nxt).where(F.unix_timestamp("next_time") - F.unix_timestamp("time") > most * seconds).select("symbol", "time", "next_time")


def tail(bars: DataFrame, k: int) -> DataFrame:
    """Each symbol's last k bars."""
    w = Window.partitionBy("symbol").orderBy(F.desc("time"))
    return bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def last_per_time(rows: DataFrame, order: Column) -> DataFrame:
    """Of rows of one (symbol, time), the last by order."""
    w = Window.partitionBy("symbol", "time").orderBy(order.desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def security(bars: DataFrame, timeframe: str, value: Column, name: str = "value", lookahead: bool = False, gaps_on: bool = False) -> DataFrame:
    """bars with value, an expression over bars of a longer timeframe, as it is known on each bar.

    With lookahead the containing bucket's value; else that value only on the bucket's last bar, and
    before it the bucket's predecessor's: what is confirmed. With gaps the value stands on the first bar
    that maps to a new bucket and nowhere else. Bars of one symbol and bucket meet by equality: the
    longer bars are one row for each bucket, so the join never grows.
    """
    higher = by_calendar(bars.select("symbol", "time", "open", "high", "low", "close", "volume"), timeframe).withColumn(name, value)
    w = Window.partitionBy("symbol").orderBy("bar_index")
    higher = higher.select("symbol", F.col("time").alias("_b"), F.col("bar_index").alias("_i"), F.col(name).alias("_now"), F.lag(name).over(w).alias("_before"))
    df = bars.withColumn("_b", align(F.col("time"), timeframe))
    df = df.join(higher, ["symbol", "_b"], "left")
    ends = F.coalesce(F.lead("_b").over(w) != F.col("_b"), F.lit(True))
    known = F.when(F.lit(lookahead) | ends, F.col("_now")).otherwise(F.col("_before"))
    at = F.when(F.lit(lookahead) | ends, F.col("_i")).otherwise(F.col("_i") - 1)
    df = df.withColumn(name, known).withColumn("_at", at)
    if gaps_on:
        df = df.withColumn(name, F.when(F.col("_at") != F.lag("_at").over(w), F.col(name)))
    return df.drop("_b", "_i", "_now", "_before", "_at")


def lower(bars: DataFrame, timeframe: str, fine: DataFrame, value: Column, name: str = "values") -> DataFrame:
    """bars of timeframe with the array of value over the finer bars that open within each, in order."""
    inner = fine.select("symbol", align(F.col("time"), timeframe).alias("_b"), F.struct(F.col("time").alias("t"), value.alias("v")).alias("x"))
    lists = inner.groupBy("symbol", "_b").agg(F.sort_array(F.collect_list("x")).alias("_l"))
    df = bars.withColumn("_b", align(F.col("time"), timeframe)).join(lists, ["symbol", "_b"], "left")
    return df.withColumn(name, F.coalesce(F.transform("_l", lambda x: x["v"]), F.array().cast("array<double>"))).drop("_b", "_l")


def as_of(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """left (symbol, time, ...) with name from right (symbol, time, name): the last at or before each time.

    A union in time order and a running last value: linear, without a join over inequalities.
    """
    cols = [c for c in left.columns if c not in ("symbol", "time")]
    a = left.withColumn("_side", F.lit(1)).withColumn(name, F.lit(None).cast(right.schema[name].dataType))
    b = right.select("symbol", "time", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.lit(0).alias("_side"), name)
    w = Window.partitionBy("symbol").orderBy("time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(F.col(name).alias("v"))), ignorenulls=True).over(w)["v"]
    return a.select("symbol", "time", *cols, "_side", name).unionByName(b).withColumn(name, seen).where("_side = 1").drop("_side")


def security_lower(bars: DataFrame, timeframe: str, fine: DataFrame, value: Column) -> DataFrame:
    """bars of timeframe with the last and the first of value over the finer bars within each."""
    inner = fine.select("symbol", align(F.col("time"), timeframe).alias("_b"), F.col("time").alias("_t"), value.alias("_v"))
    ends = inner.groupBy("symbol", "_b").agg(F.max_by("_v", "_t").alias("last"), F.min_by("_v", "_t").alias("first"))
    return bars.withColumn("_b", align(F.col("time"), timeframe)).join(ends, ["symbol", "_b"], "left").drop("_b")


def other_symbol(bars: DataFrame, symbol: str, value: Column, name: str = "value") -> DataFrame:
    """bars with value over another symbol's bars of the same timeframe, by time."""
    theirs = bars.where(F.col("symbol") == symbol).select("time", value.alias(name))
    return bars.join(theirs, "time", "left")
