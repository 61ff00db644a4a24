"""All queries by name, with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ta
from .plans import queries_chart, queries_core, queries_drawing, queries_fifo, queries_ranges, queries_strategy, queries_ta
from .plans.bars import event_bars

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (queries_ta, queries_core, queries_chart, queries_drawing, queries_fifo, queries_ranges, queries_strategy)


def queries() -> dict[str, Query]:
    return {k: v for part in PARTS for k, v in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with two averages and the bars where the faster crosses over the slower."""
    bars = event_bars(spark, sf_dir).withColumns({"fast": ta.sma(F.col("close"), 5), "slow": ta.sma(F.col("close"), 10)})
    return bars.withColumn("signal", ta.crossover(F.col("fast"), F.col("slow"))).where("signal").select("symbol", "time", "bar_index", "close", "fast", "slow")
