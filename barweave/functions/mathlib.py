"""Scalar mathematics. NULL in, NULL out; comparisons treat numbers within EPS as equal."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-10
PHI = (1 + math.sqrt(5)) / 2

abs_, acos, asin, atan, ceil, cos, exp, floor = F.abs, F.acos, F.asin, F.atan, F.ceil, F.cos, F.exp, F.floor
ln = log = F.ln
log10, pow_, random, sign, sin, sqrt, tan, todegrees, toradians = F.log10, F.pow, F.rand, F.signum, F.sin, F.sqrt, F.tan, F.degrees, F.radians


def e() -> Column:
    return F.lit(math.e)


def pi() -> Column:
    return F.lit(math.pi)


def phi() -> Column:
    return F.lit(PHI)


def rphi() -> Column:
    return F.lit(1 / PHI)


def avg(*xs: Column) -> Column:
    return sum(xs[1:], xs[0]) / F.lit(float(len(xs)))


def _strict(pick, xs: tuple[Column, ...]) -> Column:
    some = xs[0].isNull()
    for x in xs[1:]:
        some = some | x.isNull()
    return F.when(~some, pick(*xs) if len(xs) > 1 else xs[0])


def max_(*xs: Column) -> Column:
    """na if any is."""
    return _strict(F.greatest, xs)


def min_(*xs: Column) -> Column:
    return _strict(F.least, xs)


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, digits)


def round_to_mintick(x: Column, tick: float) -> Column:
    return F.round(x / F.lit(tick)) * F.lit(tick)


def sum_(x: Column, n: int) -> Column:
    """Over the last n bars; na if any is or history is short."""
    w = Window.partitionBy("symbol").orderBy("bar_index").rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) == n, F.sum(x).over(w))


def eq(a: Column, b: Column) -> Column:
    return F.abs(a - b) < EPS


def neq(a: Column, b: Column) -> Column:
    return F.abs(a - b) >= EPS


def lt(a: Column, b: Column) -> Column:
    return (b - a) >= EPS


def le(a: Column, b: Column) -> Column:
    return (a - b) < EPS


def gt(a: Column, b: Column) -> Column:
    return (a - b) >= EPS


def ge(a: Column, b: Column) -> Column:
    return (b - a) < EPS


def idiv(a: Column, b: Column) -> Column:
    """Whole-number division, toward zero; na for a zero divisor."""
    q = F.try_divide(a, b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))
