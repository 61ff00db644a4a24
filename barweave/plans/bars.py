"""Bars: one row for each symbol and time bucket, numbered from 0 within the symbol.

Columns symbol, time, bar_index, open, high, low, close, volume. A missing value is NULL, never NaN.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "volume")


def clean(x: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(x), x)


def number(bars: DataFrame) -> DataFrame:
    """bars with bar_index, by time within the symbol."""
    return bars.withColumn("bar_index", F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1)


def packed(*parts: tuple[Column, int]) -> Column:
    """Whole numbers >= 0 of so many decimal digits as one that sorts like them, 38 digits at most: an aggregation buffer holds it in place.

    A number that is below 0 or has more digits is an error: it would spill into its neighbour and change the order."""
    assert sum(n for _, n in parts) <= 38
    parts = tuple((F.when(x.cast("long").between(0, 10**n - 1 if n < 19 else 2**63 - 1) | x.isNull(), x).otherwise(F.raise_error(F.concat(F.lit(f"no order key of {n} digits: "), x.cast("string")))), n) for x, n in parts)
    longs: list[tuple[Column, int]] = []
    for x, n in parts:  # as many digits in a long as it holds, and the longs in a decimal
        x = x.cast("long")
        if longs and longs[-1][1] + n <= 18:
            longs[-1] = longs[-1][0] * F.lit(10**n) + x, longs[-1][1] + n
        else:
            longs.append((x, n))
    out, digits = longs[0][0].cast("decimal(19,0)"), longs[0][1]
    for x, n in longs[1:]:
        digits += n
        out = (out * F.lit(Decimal(10**n)) + x).cast(f"decimal({digits},0)")
    return out


def from_ticks(ticks: DataFrame, symbol: Column, ts: Column, key: Column, price: Column, size: Column, bucket: str) -> DataFrame:
    """Bars of width bucket (a date_trunc unit) from ticks in order of key, a number or a time that sorts them within a bar.

    Ticks are hashed where they lie (min_by and max_by over a key of fixed width need no sort) and meet by
    (symbol, time), so a symbol with a third of all ticks is spread over its buckets; only bars, far fewer, move
    on to be numbered within their symbol.
    """
    rows = ticks.select(symbol.alias("symbol"), F.date_trunc(bucket, ts).cast("timestamp_ntz").alias("time"), key.alias("at"), price.cast("double").alias("p"), size.cast("double").alias("v"))
    made = rows.groupBy("symbol", "time").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("v").alias("volume"))
    return number(made)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def event_bars(spark: SparkSession, sf_dir: str, bucket: str = "hour") -> DataFrame:
    wide = packed((_micros(F.col("ts")), 18), (F.col("event_id"), 19))
    return from_ticks(_table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"), wide, F.col("value"), F.lit(1), bucket)


def line_bars(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    day, cents, hundredths = F.datediff(F.col("l_shipdate"), F.lit("1900-01-01")), F.col("l_extendedprice") * 100, F.col("l_quantity") * 100
    wide = packed((day, 6), (F.col("l_orderkey"), 12), (F.col("l_linenumber"), 2), (F.round(cents), 11), (F.round(hundredths), 7))
    return from_ticks(_table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"), wide, price, F.col("l_quantity"), bucket)


def order_bars(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    wide = packed((_micros(F.col("o_orderdate")), 18), (F.col("o_orderkey"), 19))
    return from_ticks(_table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), wide, F.col("o_totalprice"), F.lit(1), bucket)


def sql_bars(kind: str = "events", bucket: str = "hour") -> str:
    """The same bars as a DuckDB subquery."""
    symbol, ts, key, price, size, table = {
        "events": ("event_type", "ts", "ts, event_id", "value", "1", "events"),
        "line": ("concat(l_returnflag, l_linestatus)", "l_shipdate", "l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity", "l_extendedprice / nullif(l_quantity, 0)", "l_quantity", "lineitem"),
        "orders": ("o_orderpriority", "o_orderdate", "o_orderdate, o_orderkey", "o_totalprice", "1", "orders"),
    }[kind]
    return f"""(SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS INTEGER) AS bar_index FROM (
  SELECT {symbol} AS symbol, CAST(date_trunc('{bucket}', {ts}) AS TIMESTAMP) AS time, first({price} ORDER BY {key}) AS open, max({price}) AS high,
         min({price}) AS low, last({price} ORDER BY {key}) AS close, CAST(sum({size}) AS DOUBLE) AS volume FROM {table} GROUP BY 1, 2))"""
