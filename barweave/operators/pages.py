"""Pages of a table in the order of a key: the n-th is read without those before it, or from the last key seen on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fifo import running


def paged(df: DataFrame, block: Column, order: tuple[str, ...], size: int) -> DataFrame:
    """df with page, from 0: size rows each by order, whose columns must tell rows apart. block must not fall as order rises;
    rows are numbered within their block, and one row a block says how many stand before it."""
    if size < 1:
        raise ValueError("a page holds a row at least")
    return running(df, (), block, order, {"page": F.lit(1)}).withColumn("page", F.floor((F.col("page") - 1) / size))


def write(df: DataFrame, path: str, block: Column, order: tuple[str, ...], size: int) -> None:
    """A folder for each page, its rows in order."""
    paged(df, block, order, size).repartition("page").sortWithinPartitions("page", *order).write.partitionBy("page").parquet(path)


def nth(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Page n: the folders of others are not listed among what is read."""
    return spark.read.parquet(path).where(F.col("page") == n)


def after(spark: SparkSession, path: str, order: tuple[str, ...], last: tuple, size: int) -> DataFrame:
    """The next size rows after the row whose order is last: files whose greatest key is smaller are skipped by their statistics."""
    seek = F.lit(False)
    for k in reversed(range(len(order))):  # (a, b) > (x, y), written so that a's bound is pushed to the files
        here = F.col(order[k])
        seek = (here > F.lit(last[k])) | ((here == F.lit(last[k])) & seek)
    rows = spark.read.parquet(path).where((F.col(order[0]) >= F.lit(last[0])) & seek)
    return rows.orderBy(*order).limit(size)
