"""Arrays as values: what changes an array returns the new one. Indexes count from 0, negative ones from the end."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F



def known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _let(v: Column, then) -> Column:
    return F.element_at(F.transform(F.array(v), lambda x: then(x)), 1)


def abs_(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x))


def sum_(a: Column) -> Column:
    return F.aggregate(known(a), F.lit(0.0), lambda s, x: s + x)


def avg(a: Column) -> Column:
    return F.try_divide(sum_(a), F.size(known(a)))


def variance(a: Column, biased: bool = True) -> Column:
    def of(k: Column) -> Column:
        n = F.size(k)
        mean = F.try_divide(F.aggregate(k, F.lit(0.0), lambda s, x: s + x), n)
        return _let(mean, lambda m: F.try_divide(F.aggregate(k, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), n if biased else n - 1))

    return _let(known(a), of)


def stdev(a: Column, biased: bool = True) -> Column:
    return F.sqrt(variance(a, biased))


def standardize(a: Column) -> Column:
    """z-scores; all 1 without spread."""
    return _let(F.struct(avg(a).alias("m"), stdev(a).alias("s")), lambda z: F.transform(a, lambda x: F.when(z["s"] == 0, 1.0).otherwise(F.try_divide(x - z["m"], z["s"]))))


def covariance(a: Column, b: Column, biased: bool = True) -> Column:
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def of(k: Column) -> Column:
        n = F.size(k)

        def mean(f: str) -> Column:
            return F.try_divide(F.aggregate(k, F.lit(0.0), lambda s, p: s + p[f]), n)

        return _let(F.struct(mean("x").alias("x"), mean("y").alias("y")), lambda m: F.try_divide(F.aggregate(k, F.lit(0.0), lambda s, p: s + (p["x"] - m["x"]) * (p["y"] - m["y"])), n if biased else n - 1))

    return _let(both, of)


def max_(a: Column, nth: int = 0) -> Column:
    return F.try_element_at(F.sort_array(known(a), False), F.lit(nth + 1))


def min_(a: Column, nth: int = 0) -> Column:
    return F.try_element_at(F.sort_array(known(a)), F.lit(nth + 1))


def range_(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def median(a: Column) -> Column:
    def of(s: Column) -> Column:
        n = F.size(s)
        low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
        return F.when(n > 0, (F.try_element_at(s, low) + F.try_element_at(s, high)) / 2)

    return _let(F.sort_array(known(a)), of)


def mode(a: Column) -> Column:
    """Most frequent, the smallest of ties."""

    def of(k: Column) -> Column:
        counts = F.transform(F.array_distinct(k), lambda x: F.struct((-F.size(F.filter(k, lambda y: y == x))).alias("n"), x.alias("x")))
        return F.array_min(counts)["x"]

    return _let(known(a), of)


def percentile_linear_interpolation(a: Column, p: float) -> Column:
    """At index p/100 n - 0.5 of the sorted values, clamped; na if any value is."""

    def of(s: Column) -> Column:
        n = F.size(s)
        at = F.least(F.greatest(F.lit(p / 100) * n - 0.5, F.lit(0.0)), (n - 1).cast("double"))
        k = F.floor(at).cast("int")
        low, high = F.try_element_at(s, k + 1), F.try_element_at(s, F.least(k + 2, n))
        return F.when((n > 0) & ~F.exists(s, lambda x: x.isNull()), low + (high - low) * (at - k))

    return _let(F.sort_array(a), of)


def percentile_nearest_rank(a: Column, p: float) -> Column:
    k = F.greatest(F.ceil(F.lit(p / 100) * F.size(a)).cast("int"), F.lit(1))
    return F.try_element_at(F.sort_array(known(a)), k)


def percentrank(a: Column, index: int) -> Column:
    """Share of the other elements strictly below a[index], in percent."""
    return _let(F.try_element_at(a, F.lit(index + 1)), lambda v: F.try_divide(100.0 * F.size(F.filter(a, lambda x: x < v)), F.size(a) - 1))


def get(a: Column, index: int) -> Column:
    """Raises beyond the ends."""
    return F.element_at(a, index + 1 if index >= 0 else index)


def _within(a: Column, index: int, then) -> Column:
    """then(place) for an index, from the end if negative; raises beyond the ends."""
    at = F.lit(index) if index >= 0 else F.size(a) + index
    return F.when((at < 0) | (at >= F.size(a)), F.raise_error(F.format_string("index %d is beyond an array of %d", F.lit(index), F.size(a)))).otherwise(then(at))


def set_(a: Column, index: int, value: Column) -> Column:
    """Raises beyond the ends."""
    return _within(a, index, lambda at: F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x)))


def first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def push(a: Column, value: Column) -> Column:
    return F.array_append(a, value)


def unshift(a: Column, value: Column) -> Column:
    return F.array_prepend(a, value)


def pop(a: Column) -> Column:
    """Without the last; last() gives what goes."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def insert(a: Column, index: int, value: Column) -> Column:
    return F.array_insert(a, index + 1, value)


def remove(a: Column, index: int) -> Column:
    """Raises beyond the ends."""
    return _within(a, index, lambda at: F.filter(a, lambda x, i: i != at))


def slice_(a: Column, start: int, end: int) -> Column:
    return F.slice(a, start + 1, max(end - start, 0))


def fill(a: Column, value: Column, start: int = 0, end: int | None = None) -> Column:
    stop = F.size(a) if end is None else F.lit(end)
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < stop), value).otherwise(x))


concat, copy, reverse, size, join = F.concat, lambda a: a, F.reverse, F.size, F.array_join
includes = F.array_contains


def indexof(a: Column, value: Column) -> Column:
    """-1 if absent; na matches na."""
    hits = F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(value), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(hits), F.lit(-1))


def lastindexof(a: Column, value: Column) -> Column:
    hits = F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(value), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(hits), F.lit(-1))


def every(a: Column) -> Column:
    return F.forall(a, lambda x: F.coalesce(x.cast("boolean"), F.lit(False)))


def some(a: Column) -> Column:
    return F.exists(a, lambda x: F.coalesce(x.cast("boolean"), F.lit(False)))


def sort(a: Column, ascending: bool = True) -> Column:
    """na counts as the largest."""
    up = F.concat(F.sort_array(known(a)), F.filter(a, lambda x: x.isNull()))
    return up if ascending else F.reverse(up)


def sort_indices(a: Column, ascending: bool = True) -> Column:
    pairs = F.transform(a, lambda x, i: F.struct(x.isNull().alias("na"), (x if ascending else -x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def binary_search(a: Column, value: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(a, value), F.lit(0)) - 1, F.lit(-1)).cast("int")


def binary_search_leftmost(a: Column, value: Column) -> Column:
    """Leftmost match, or the index before the place to insert."""
    below = F.size(F.filter(a, lambda x: x < value))
    return F.when(F.array_contains(a, value), below).otherwise(below - 1)


def binary_search_rightmost(a: Column, value: Column) -> Column:
    """Rightmost match, or the place to insert."""
    upto = F.size(F.filter(a, lambda x: x <= value))
    return F.when(F.array_contains(a, value), upto - 1).otherwise(upto)


def new(n: int, value: Column) -> Column:
    return F.array_repeat(value, n)


def new_float(n: int = 0) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), n)


def new_int(n: int = 0) -> Column:
    return F.array_repeat(F.lit(0), n)


def new_bool(n: int = 0) -> Column:
    return F.array_repeat(F.lit(False), n)


def new_string(n: int = 0) -> Column:
    return F.array_repeat(F.lit(""), n)


def new_color(n: int = 0) -> Column:
    return F.array_repeat(F.lit(None).cast("string"), n)


def from_(*xs: Column) -> Column:
    return F.array(*xs)


def clear(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.lit(0))


