"""Queries over logs of drawings that are made from bars: lines under a limit, their prices, provisional runs, cells of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import drawing, ta
from .bars import event_bars, sql_bars

Q: dict = {}
SQL: dict[str, str] = {}
LIMIT = 20


def line_events(bars: DataFrame) -> DataFrame:
    """Each bar makes a line at its close, level until the next bar sets its second end; two bars on, it is deleted if the close is higher by then and not
    on every seventh bar."""
    close, i = F.col("close"), F.col("bar_index").cast("long")
    rows = bars.withColumns({"_1": ta.lag(close), "_2": ta.lag(close, 2)})
    na = F.lit(None).cast("double")

    def event(seq: int, back: int, op: str, **fields: Column) -> Column:
        cells = {k: fields.get(k, na) for k in ("x1", "y1", "x2", "y2")}
        return F.struct(F.lit(seq).alias("seq"), (i - back).cast("string").alias("id"), F.lit(op).alias("op"), *[v.cast("double").alias(k) for k, v in cells.items()])

    each = F.array(
        event(0, 0, "new", x1=i, y1=close, x2=i + 1, y2=close),
        F.when(i > 0, event(1, 1, "set", x2=i + 0.5, y2=close)),
        F.when((i > 1) & (close > F.col("_2")) & (i % 7 != 0), event(2, 2, "delete")),
    )
    return rows.select("symbol", i.alias("bar_index"), F.lit("line").alias("kind"), F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("symbol", "bar_index", "kind", "e.*")


def _lines(spark, sf_dir: str) -> DataFrame:
    """The lines that stand after each symbol's last bar, at most LIMIT, and their price ten bars after their first end."""
    got = drawing.state(line_events(event_bars(spark, sf_dir)), "x1", "y1", "x2", "y2", limits={"line": LIMIT})
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return got.select("symbol", F.col("id").cast("long").alias("id"), F.round(x2, 6).alias("x2"), F.round(y2, 6).alias("y2"), F.round(drawing.price_at(x1 + 10, x1, y1, x2, y2), 5).alias("price"))


_LINES = f"""WITH b AS MATERIALIZED (SELECT symbol, bar_index, close, lead(close) OVER w AS c1, lead(close, 2) OVER w AS c2 FROM {sql_bars()} WINDOW w AS (PARTITION BY symbol ORDER BY bar_index)),
o AS MATERIALIZED (SELECT symbol, bar_index AS id, close AS y1, coalesce(c1, close) AS y2, bar_index + CASE WHEN c1 IS NULL THEN 1.0 ELSE 1.5 END AS x2, CASE WHEN c2 > close AND (bar_index + 2) % 7 <> 0 THEN bar_index + 2 END AS died FROM b),
k AS MATERIALIZED (SELECT * FROM o WHERE died IS NULL),
n AS (SELECT k.symbol, k.id, t.id AS at, count(*) AS n FROM k JOIN o AS t ON t.symbol = k.symbol AND t.id > k.id JOIN o AS y ON y.symbol = k.symbol AND y.id > k.id AND y.id <= t.id AND (y.died IS NULL OR y.died >= t.id) GROUP BY ALL),
g AS (SELECT DISTINCT symbol, id FROM n WHERE n >= {LIMIT})
"""
Q["drawing_lines"] = _lines
SQL["drawing_lines"] = _LINES + "SELECT symbol, CAST(id AS BIGINT) AS id, round(CAST(x2 AS DOUBLE), 6) AS x2, round(y2, 6) AS y2, round(y1 + 10 / (CAST(x2 AS DOUBLE) - id) * (y2 - y1), 5) AS price FROM k ANTI JOIN g USING (symbol, id)"


def _runs(spark, sf_dir: str) -> DataFrame:
    """Labels at closes that every tick of a bar draws anew: as many runs as the bar has ticks, of which the last stays."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = e.select(F.col("event_type").alias("symbol"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("bar_index"), F.struct("ts", "event_id").alias("run"), F.lit(0).alias("seq"), F.lit("label").alias("kind"), F.lit("new").alias("op"), F.col("value").alias("y"))
    log = ticks.withColumn("id", F.col("bar_index").cast("string"))
    return drawing.state(drawing.settled(log), "y", limits={"label": 50}).select("symbol", F.col("id").cast("long").alias("hour"), F.round("y", 6).alias("y"))


Q["drawing_rollback"] = _runs
SQL["drawing_rollback"] = "SELECT symbol, hour, round(y, 6) AS y FROM (SELECT event_type AS symbol, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS hour, last(value ORDER BY ts, event_id) AS y FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY hour DESC) <= 50"


def _cells(spark, sf_dir: str) -> DataFrame:
    """A table a symbol with a column a weekday and a row an hour: bars write their close into their cell, and Mondays' noon clears the afternoons of the first three columns."""
    bars = event_bars(spark, sf_dir).withColumns({"c": F.weekday("time"), "r": F.hour("time"), "i": F.col("bar_index").cast("long")})
    at, table = [F.col("i").alias("bar_index")], F.lit("week")
    written = bars.select("symbol", *at, F.lit(1).alias("seq"), F.lit("cell").alias("kind"), drawing.cell_id(table, F.col("c"), F.col("r")).alias("id"), F.lit("new").alias("op"), F.col("close").alias("value"))
    noon = bars.where("c = 0 and r = 12")
    cleared = noon.select("symbol", *at, F.lit(0).alias("seq"), F.lit("cell").alias("kind"), F.explode(drawing.cell_ids(table, F.lit(0), F.lit(12), F.lit(2), F.lit(23))).alias("id"), F.lit("delete").alias("op"), F.lit(None).cast("double").alias("value"))
    return drawing.state(written.unionByName(cleared), "value").select("symbol", "id", F.round("value", 6).alias("value"))


Q["drawing_cells"] = _cells
SQL["drawing_cells"] = f"""WITH b AS (SELECT *, isodow(time) - 1 AS c, hour(time) AS r FROM {sql_bars()}),
z AS (SELECT symbol, max(bar_index) AS z FROM b WHERE c = 0 AND r = 12 GROUP BY 1),
l AS (SELECT symbol, c, r, max(bar_index) AS i, last(close ORDER BY bar_index) AS value FROM b GROUP BY ALL)
SELECT symbol, concat('week|', c, '|', r) AS id, round(value, 6) AS value FROM l LEFT JOIN z USING (symbol) WHERE NOT (c <= 2 AND r >= 12 AND coalesce(i < z, false))"""
