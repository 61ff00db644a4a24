"""Queries over ranges of time, pages of a table, history at a distance that varies, and sessions in a zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sessions
from ..operators import pages, ta
from ..sources import store
from .bars import event_bars, line_bars, sql_bars

Q: dict = {}
SQL: dict[str, str] = {}


def _orders(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _ranges(spark, sf_dir: str) -> DataFrame:
    """Each customer's weeks from an order on, less the days of orders that are filled."""
    o, day = _orders(spark, sf_dir), F.col("o_orderdate").cast("timestamp_ntz")

    def of(rows: DataFrame, days: int) -> DataFrame:
        return rows.select(F.col("o_custkey").alias("customer"), day.alias("start"), (day + F.make_dt_interval(F.lit(days))).alias("end"))

    return store.missing(of(o, 7), of(o.where("o_orderstatus = 'F'"), 2), ("customer",))


Q["ranges_missing"] = _ranges
SQL["ranges_missing"] = """WITH r AS (SELECT o_custkey AS customer, CAST(o_orderdate AS TIMESTAMP) AS a, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 7 DAY AS b FROM orders),
c AS (SELECT o_custkey AS customer, CAST(o_orderdate AS TIMESTAMP) AS a, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY AS b FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT DISTINCT customer, t FROM (SELECT customer, a AS t FROM r UNION ALL SELECT customer, b FROM r UNION ALL SELECT customer, a FROM c UNION ALL SELECT customer, b FROM c)),
s AS (SELECT customer, t AS a, lead(t) OVER (PARTITION BY customer ORDER BY t) AS b FROM e),
w AS (SELECT * FROM s WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.customer = s.customer AND r.a <= s.a AND r.b >= s.b) AND NOT EXISTS (SELECT 1 FROM c WHERE c.customer = s.customer AND c.a <= s.a AND c.b >= s.b)),
g AS (SELECT *, sum(n) OVER (PARTITION BY customer ORDER BY a) AS g FROM (SELECT *, CASE WHEN a = lag(b) OVER (PARTITION BY customer ORDER BY a) THEN 0 ELSE 1 END AS n FROM w))
SELECT customer, min(a) AS start, max(b) AS "end" FROM g GROUP BY customer, g"""

Q["pages_third"] = lambda s, d: pages.paged(_orders(s, d), F.date_trunc("month", "o_orderdate"), ("o_orderdate", "o_orderkey"), 100).where("page = 2").select("o_orderkey", "o_custkey", F.col("page").cast("int").alias("page"))
SQL["pages_third"] = "SELECT o_orderkey, o_custkey, 2 AS page FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 200"
Q["pages_sizes"] = lambda s, d: pages.paged(_orders(s, d), F.date_trunc("month", "o_orderdate"), ("o_orderdate", "o_orderkey"), 1000).groupBy(F.col("page").cast("int").alias("page")).agg(F.count("*").alias("n"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"))
SQL["pages_sizes"] = "SELECT CAST(p AS INTEGER) AS page, count(*) AS n, arg_min(o_orderkey, i) AS first_key FROM (SELECT *, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS i, i // 1000 AS p FROM orders) GROUP BY p"


def _far(spark, sf_dir: str) -> DataFrame:
    """As many bars back as the volume's last digit says."""
    bars = event_bars(spark, sf_dir)
    return ta.history(bars, "was", F.col("close"), F.col("volume") % 10).select("symbol", "bar_index", F.round("was", 6).alias("was"))


Q["core_history_varying"] = _far
SQL["core_history_varying"] = f"WITH b AS MATERIALIZED (SELECT * FROM {sql_bars()}) SELECT b.symbol, b.bar_index, round(p.close, 6) AS was FROM b LEFT JOIN b AS p ON p.symbol = b.symbol AND p.bar_index = b.bar_index - b.volume % 10"

SPEC, ZONE = "0930-1600:23456", "America/New_York"


def _session(spark, sf_dir: str) -> DataFrame:
    """Hourly bars in New York's weekday session."""
    made = sessions.placed(event_bars(spark, sf_dir), sessions.calendar(spark, SPEC, ZONE, "2023-12-31", "2024-02-01"), 3600)
    return sessions.opened(made, 1).select("symbol", "bar_index", "opens", "closes", "time_close", "session_bar", "is_first", "is_last", "session_open")


_PLACED = """c AS (SELECT d AS day, timezone('UTC', timezone('{zone}', d + INTERVAL {a} MINUTE)) AS opens, timezone('UTC', timezone('{zone}', d + INTERVAL {b} MINUTE)) AS closes FROM (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= {most})"""
Q["session_bars"] = _session
SQL["session_bars"] = f"""WITH b AS (SELECT * FROM {sql_bars()}), {_PLACED.format(zone=ZONE, a=570, b=960, first="2023-12-31", last="2024-02-01", most=5)},
m AS (SELECT symbol, bar_index, opens, closes, least(time + INTERVAL 1 HOUR, closes) AS time_close, row_number() OVER w - 1 AS session_bar, lag(time) OVER w IS NULL AS is_first, lead(time) OVER w IS NULL AS is_last FROM b JOIN c ON time >= opens AND time < closes WINDOW w AS (PARTITION BY symbol, opens ORDER BY time)),
o AS (SELECT symbol, opens, lag(opens) OVER (PARTITION BY symbol ORDER BY opens) AS session_open FROM (SELECT DISTINCT symbol, opens FROM m))
SELECT m.symbol, bar_index, m.opens, closes, time_close, CAST(session_bar AS INTEGER) AS session_bar, is_first, is_last, session_open FROM m JOIN o ON o.symbol = m.symbol AND o.opens = m.opens"""


def _nights(spark, sf_dir: str) -> DataFrame:
    """Daily bars of order lines over ten springs and autumns: Berlin's evening session that ends on the next day, and how many hours each lasts."""
    made = sessions.placed(line_bars(spark, sf_dir), sessions.calendar(spark, "2200-0400", "Europe/Berlin", "1994-12-31", "2002-12-31"), 86_400)
    hours = (F.unix_seconds(F.col("closes").cast("timestamp")) - F.unix_seconds(F.col("opens").cast("timestamp"))) / 3600
    return made.select("symbol", "bar_index", "opens", "closes", hours.cast("int").alias("hours"), "session_bar")


Q["session_over_clock_changes"] = _nights
SQL["session_over_clock_changes"] = f"""WITH b AS (SELECT * FROM {sql_bars("line", "day")}), {_PLACED.format(zone="Europe/Berlin", a=1320, b=1680, first="1994-12-31", last="2002-12-31", most=7)}
SELECT symbol, bar_index, opens, closes, CAST(date_diff('hour', opens, closes) AS INTEGER) AS hours, CAST(row_number() OVER (PARTITION BY symbol, opens ORDER BY time) - 1 AS INTEGER) AS session_bar FROM b JOIN c ON time >= opens AND time < closes"""
