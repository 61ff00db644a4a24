"""Queries for casts, the state of bars and plots, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import casts, strings, times
from ..operators import barstate, plots, ta
from .bars import event_bars, sql_bars

Q: dict = {}
SQL: dict[str, str] = {}
NOW = dt.datetime(2024, 1, 20, 5, 30)


def _casts(spark, sf_dir: str) -> DataFrame:
    x = (F.col("close") - 50) / 10
    odd = F.when(F.col("bar_index") % 5 == 0, F.lit(float("nan"))).otherwise(x)
    currency = F.when(F.col("symbol") == "view", "EUR").when(F.col("symbol") != "click", "USD")
    made = event_bars(spark, sf_dir).select("symbol", "bar_index", casts.to_int(odd).alias("whole"), casts.to_bool(casts.to_int(odd)).alias("truth"), F.round(casts.to_float(odd), 6).alias("number"), casts.to_string(F.col("bar_index")).alias("word"), F.round(casts.to_account(x, currency), 6).alias("account"))
    return made


Q["core_casts"] = _casts
SQL["core_casts"] = f"""SELECT symbol, bar_index, CAST(trunc(o) AS BIGINT) AS whole, coalesce(trunc(o) <> 0, false) AS truth, round(o, 6) AS number, CAST(bar_index AS VARCHAR) AS word, CASE WHEN symbol <> 'view' THEN round(x, 6) END AS account
FROM (SELECT *, CASE WHEN bar_index % 5 <> 0 THEN x END AS o FROM (SELECT *, (close - 50) / 10 AS x FROM {sql_bars()}))"""

ZONE = "Asia/Tokyo"
Q["core_bar_states"] = lambda s, d: barstate.states(event_bars(s, d), "60", NOW, ZONE).select("symbol", "bar_index", *barstate.NAMES)
SQL["core_bar_states"] = f"""WITH b AS (SELECT *, max(bar_index) OVER (PARTITION BY symbol) AS last_bar_index, max(time) OVER (PARTITION BY symbol) AS last_bar_time, TIMESTAMP '{NOW}' AS timenow, coalesce(lead(time) OVER (PARTITION BY symbol ORDER BY time), time + INTERVAL 1 HOUR) AS closes FROM {sql_bars()})
SELECT symbol, bar_index, last_bar_index, last_bar_time, timenow, CAST(date_trunc('day', closes + INTERVAL 9 HOUR) AS TIMESTAMP) AS time_tradingday, bar_index = 0 AS isfirst, bar_index = last_bar_index AS islast, bar_index < last_bar_index AS ishistory, bar_index = last_bar_index AS isrealtime, true AS isnew, closes <= timenow AS isconfirmed,
CASE last_bar_index - bar_index WHEN 0 THEN last_bar_time + INTERVAL 1 HOUR <= timenow WHEN 1 THEN last_bar_time + INTERVAL 1 HOUR > timenow ELSE false END AS islastconfirmedhistory, true AS ismarket, false AS ispremarket, false AS ispostmarket FROM b"""


def _plots(spark, sf_dir: str) -> DataFrame:
    """A candle, a bar, an arrow by the change, a level, and the area between close and its average."""
    o, h, low, c = (F.col(k) for k in ("open", "high", "low", "close"))
    bars = event_bars(spark, sf_dir).withColumns({"d": ta.change(c), "m": ta.sma(c, 5)})
    tint = F.when(c >= o, "green").otherwise("red")
    made = plots.rows(bars, plots.candle("candles", o, h, low, c, tint), plots.bar("bars", o, h, low, c, tint), plots.arrow("moves", F.col("d"), F.lit("lime"), F.lit("maroon")), plots.level("half", 50.0, F.lit("gray")), plots.fill("gap", c, F.col("m"), F.lit("aqua")))
    return made.drop("time").withColumn("value", F.transform("value", lambda v: F.round(v, 6) + F.lit(0.0)))


Q["plots_rows"] = _plots
_tint = "CASE WHEN close >= open THEN 'green' ELSE 'red' END"
_four = "[round(open, 6), round(high, 6), round(low, 6), round(close, 6)]"
SQL["plots_rows"] = f"""WITH b AS MATERIALIZED (SELECT *, close - lag(close) OVER w AS d, CASE WHEN bar_index >= 4 THEN avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS m FROM {sql_bars()} WINDOW w AS (PARTITION BY symbol ORDER BY bar_index))
SELECT symbol, bar_index, 'candles' AS title, 'candle' AS style, {_four} AS value, {_tint} AS color, NULL AS shape, NULL AS location FROM b
UNION ALL SELECT symbol, bar_index, 'bars', 'bar', {_four}, {_tint}, NULL, NULL FROM b
UNION ALL SELECT symbol, bar_index, 'moves', 'shape', [round(d, 6) + 0.0], CASE WHEN d > 0 THEN 'lime' WHEN d < 0 THEN 'maroon' END, CASE WHEN d > 0 THEN 'shape_arrow_up' WHEN d < 0 THEN 'shape_arrow_down' END, CASE WHEN d > 0 THEN 'BelowBar' WHEN d < 0 THEN 'AboveBar' END FROM b
UNION ALL SELECT symbol, bar_index, 'half', 'hline', [50.0], 'gray', NULL, NULL FROM b
UNION ALL SELECT symbol, bar_index, 'gap', 'fill', CASE WHEN m IS NULL THEN [NULL, NULL] ELSE [round(least(close, m), 6), round(greatest(close, m), 6)] END, CASE WHEN m IS NOT NULL THEN 'aqua' END, NULL, NULL FROM b"""


_NY = "timezone('America/New_York', timezone('UTC', time))"
Q["time_format_zones"] = lambda s, d: event_bars(s, d).select("symbol", "bar_index", strings.format_time(F.col("time"), "yyyy-MM-dd'T'HH:mm:ssZ", "America/New_York").alias("ny"), strings.format_time(F.col("time"), "dd.MM.yy 'at' hh a Z", "UTC+5:30").alias("half"))
SQL["time_format_zones"] = f"""SELECT symbol, bar_index, strftime({_NY}, '%Y-%m-%dT%H:%M:%S') || printf('-%02d00', CAST(date_diff('hour', {_NY}, time) AS INTEGER)) AS ny,
strftime(time + INTERVAL 330 MINUTE, '%d.%m.%y at %I %p +0530') AS half FROM {sql_bars()}"""


def _timestamps(spark, sf_dir: str) -> DataFrame:
    """Order dates from their parts, with a month and an hour that roll over, and from texts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = F.col("o_orderdate").cast("timestamp_ntz")
    y, m, d = F.year(t), F.month(t), F.dayofmonth(t)
    return o.select("o_orderkey", times.timestamp(y, m + 2, d, F.col("o_orderkey") % 50, zone="Europe/Berlin").alias("rolled"), times.timestamp_of(F.date_format("o_orderdate", "yyyy-MM-dd"), "UTC-03:30").alias("dated"), times.timestamp_of(F.concat(F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" 06:30:00 +0200"))).alias("mail"))


Q["time_timestamps"] = _timestamps
SQL["time_timestamps"] = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders)
SELECT o_orderkey, timezone('UTC', timezone('Europe/Berlin', CAST(date_trunc('month', t) AS TIMESTAMP) + INTERVAL 2 MONTH + to_days(CAST(day(t) - 1 AS INTEGER)) + to_hours(o_orderkey % 50))) AS rolled,
CAST(CAST(t AS DATE) AS TIMESTAMP) + INTERVAL 210 MINUTE AS dated, CAST(CAST(t AS DATE) AS TIMESTAMP) + INTERVAL 270 MINUTE AS mail FROM o"""
