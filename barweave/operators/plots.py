"""Plots as rows: what a chart is told at each bar, in long form, as one projection of the bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mark(title: str, style: str, values: list[Column], color: Column, shape: Column | None = None, location: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    cells = (none if x is None else x for x in (shape, location))
    return F.struct(F.lit(title).alias("title"), F.lit(style).alias("style"), F.array(*[v.cast("double") for v in values]).alias("value"), color.cast("string").alias("color"), *[x.alias(k) for k, x in zip(("shape", "location"), cells, strict=True)])


def arrow(title: str, x: Column, up: Column, down: Column) -> Column:
    """An arrow under the bar where x is over 0, above it where x is below; neither for 0 and na."""
    rises, falls = x > 0, x < 0
    return _mark(title, "shape", [x], F.when(rises, up).when(falls, down), F.when(rises, "shape_arrow_up").when(falls, "shape_arrow_down"), F.when(rises, "BelowBar").when(falls, "AboveBar"))


def bar(title: str, o: Column, h: Column, low: Column, c: Column, color: Column) -> Column:
    return _mark(title, "bar", [o, h, low, c], color)


def candle(title: str, o: Column, h: Column, low: Column, c: Column, color: Column) -> Column:
    return _mark(title, "candle", [o, h, low, c], color)


def level(title: str, price: float, color: Column) -> Column:
    return _mark(title, "hline", [F.lit(price)], color)


def fill(title: str, a: Column, b: Column, color: Column) -> Column:
    """The area between two series, the lower one first; nothing where one is na."""
    both = a.isNotNull() & b.isNotNull()
    return _mark(title, "fill", [F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))], F.when(both, color))


def rows(bars: DataFrame, *marks: Column) -> DataFrame:
    """(symbol, time, bar_index, title, style, value, color, shape, location), a row for each bar and mark; value's elements are na where a series is."""
    if not marks:
        raise ValueError("at least one mark")
    return bars.select("symbol", "time", "bar_index", F.explode(F.array(*marks)).alias("m")).select("symbol", "time", "bar_index", "m.*")
