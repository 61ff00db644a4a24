"""Matrices as arrays of rows, in Columns: elimination with pivots folds over a matrix's columns within its row of data.

Only pinv, whose steps nest deeper than Spark's analyser goes by default, and eigenvectors go to numpy, by Arrow batches. What an operator is not defined for, a matrix that is not square or whose rows
differ in length, or that holds na, is na; a singular one has the determinant 0 and no inverse."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A

KIND = "array<array<double>>"
TOLERANCE = 1e-10


def new(rows: int, cols: int, value: Column) -> Column:
    return F.array_repeat(F.array_repeat(value, cols), rows)


rows = F.size


def columns(m: Column) -> Column:
    return F.when(F.size(m) > 0, F.size(F.element_at(m, 1))).otherwise(0)


def elements_count(m: Column) -> Column:
    return rows(m) * columns(m)


def get(m: Column, r: int, c: int) -> Column:
    return F.element_at(F.element_at(m, r + 1), c + 1)


def set_(m: Column, r: int, c: int, value: Column) -> Column:
    return F.transform(m, lambda row, i: F.when(i == r, A.set_(row, c, value)).otherwise(row))


def row(m: Column, r: int) -> Column:
    return F.element_at(m, r + 1)


def col(m: Column, c: int) -> Column:
    return F.transform(m, lambda x: F.element_at(x, c + 1))


def add_row(m: Column, at: int, values: Column) -> Column:
    return F.array_insert(m, at + 1, values)


def add_col(m: Column, at: int, values: Column) -> Column:
    return F.zip_with(m, values, lambda r, v: F.array_insert(r, at + 1, v))


def remove_row(m: Column, at: int) -> Column:
    return A.remove(m, at)


def remove_col(m: Column, at: int) -> Column:
    return F.transform(m, lambda r: A.remove(r, at))


def swap_rows(m: Column, a: int, b: int) -> Column:
    return F.transform(m, lambda r, i: F.when(i == a, row(m, b)).when(i == b, row(m, a)).otherwise(r))


def swap_columns(m: Column, a: int, b: int) -> Column:
    return F.transform(m, lambda r: F.transform(r, lambda x, j: F.when(j == a, F.element_at(r, b + 1)).when(j == b, F.element_at(r, a + 1)).otherwise(x)))


def submatrix(m: Column, r0: int, r1: int, c0: int, c1: int) -> Column:
    """r1 and c1 exclusive."""
    return F.transform(A.slice_(m, r0, r1), lambda r: A.slice_(r, c0, c1))


concat, copy = F.concat, lambda m: m


def fill(m: Column, value: Column, r0: int, r1: int, c0: int, c1: int) -> Column:
    return F.transform(m, lambda r, i: F.when((i >= r0) & (i < r1), A.fill(r, value, c0, c1)).otherwise(r))


def reshape(m: Column, r: int, c: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda i: F.slice(F.flatten(m), i * c + 1, F.lit(c)))


def reverse(m: Column) -> Column:
    return F.transform(F.reverse(m), lambda r: F.reverse(r))


def sort(m: Column, column: int = 0, ascending: bool = True) -> Column:
    keyed = F.transform(m, lambda r, i: F.struct((F.element_at(r, column + 1) * (1 if ascending else -1)).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), columns(m)), lambda j: F.transform(m, lambda r: F.element_at(r, j)))


def _each(a: Column, b: Column | float, op: Callable) -> Column:
    if isinstance(b, (int, float)):
        return F.transform(a, lambda r: F.transform(r, lambda x: op(x, F.lit(float(b)))))
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: op(x, y)))


def sum_(a: Column, b: Column | float) -> Column:
    return _each(a, b, lambda x, y: x + y)


def diff(a: Column, b: Column | float) -> Column:
    return _each(a, b, lambda x, y: x - y)


def scale(a: Column, b: float) -> Column:
    return _each(a, b, lambda x, y: x * y)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def mult(a: Column, b: Column) -> Column:
    """Matrix times matrix."""
    return F.element_at(F.transform(F.array(transpose(b)), lambda t: F.transform(a, lambda r: F.transform(t, lambda c: _dot(r, c)))), 1)


def mult_vector(a: Column, v: Column) -> Column:
    return F.transform(a, lambda r: _dot(r, v))


def kron(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda r: F.transform(b, lambda s: F.flatten(F.transform(r, lambda x: F.transform(s, lambda y: x * y))))))


def avg(m: Column) -> Column:
    return A.avg(F.flatten(m))


def max_(m: Column) -> Column:
    return F.array_max(F.flatten(m))


def min_(m: Column) -> Column:
    return F.array_min(F.flatten(m))


def median(m: Column) -> Column:
    return A.median(F.flatten(m))


def mode(m: Column) -> Column:
    return A.mode(F.flatten(m))


def trace(m: Column) -> Column:
    return A.sum_(F.transform(m, lambda r, i: F.element_at(r, i + 1)))


def _cells(m: Column, ok: Callable) -> Column:
    return F.forall(F.transform(m, lambda r, i: F.forall(F.transform(r, lambda x, j: ok(x, i, j)), lambda b: b)), lambda b: b)


def is_square(m: Column) -> Column:
    return rows(m) == columns(m)


def is_zero(m: Column) -> Column:
    return _cells(m, lambda x, i, j: x == 0)


def is_binary(m: Column) -> Column:
    return _cells(m, lambda x, i, j: (x == 0) | (x == 1))


def is_identity(m: Column) -> Column:
    return is_square(m) & _cells(m, lambda x, i, j: x == F.when(i == j, 1.0).otherwise(0.0))


def is_diagonal(m: Column) -> Column:
    return is_square(m) & _cells(m, lambda x, i, j: (i == j) | (x == 0))


def is_antidiagonal(m: Column) -> Column:
    return is_square(m) & _cells(m, lambda x, i, j: (i + j == rows(m) - 1) | (x == 0))


def is_symmetric(m: Column) -> Column:
    return is_square(m) & (m == transpose(m))


def is_antisymmetric(m: Column) -> Column:
    return is_square(m) & (m == scale(transpose(m), -1.0))


def is_triangular(m: Column) -> Column:
    return is_square(m) & (_cells(m, lambda x, i, j: (i <= j) | (x == 0)) | _cells(m, lambda x, i, j: (i >= j) | (x == 0)))


def is_stochastic(m: Column) -> Column:
    return F.forall(m, lambda r: F.forall(r, lambda x: x >= 0) & (F.abs(A.sum_(r) - 1) <= TOLERANCE))


def _numpy(kind: str, of: Callable[[np.ndarray], object]):
    """of takes a stack of matrices of one shape: one call for each shape of an Arrow batch. What has no result is na."""

    @F.pandas_udf(kind)
    def run(ms: pd.Series) -> pd.Series:
        out: list = [None] * len(ms)
        shapes: dict[tuple[int, int], list[int]] = {}
        rows = [None if m is None else [np.asarray(r, np.float64) for r in m] for m in ms]
        for k, m in enumerate(rows):
            if m and len({len(r) for r in m}) == 1:
                shapes.setdefault((len(m), len(m[0])), []).append(k)
        for at in shapes.values():
            for k, v in zip(at, _each_of(of, np.stack([rows[k] for k in at])), strict=True):
                out[k] = v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v
        return pd.Series(out, dtype=object)

    return run


def _each_of(of: Callable[[np.ndarray], object], stack: np.ndarray):
    """of the stack; where one without a result spoils the call, of each half of it."""
    try:
        return of(stack)
    except (np.linalg.LinAlgError, ValueError):
        half = len(stack) // 2
        return [*_each_of(of, stack[:half]), *_each_of(of, stack[half:])] if half else [None]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _at(m: Column, i: Column, j: Column) -> Column:
    return F.element_at(F.element_at(m, i), j)


def _whole(m: Column) -> Column:
    """Rows of one length without na."""
    return F.forall(m, lambda r: (F.size(r) == columns(m)) & F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x)))


def _eliminated(m: Column, n: Column) -> Column:
    """Struct of a, m after Gauss and Jordan's elimination of its first n columns with the largest pivot of each, and det, 0 where a pivot is missing."""

    def step(s: Column, k: Column) -> Column:
        a = s["a"]
        best = F.array_max(F.transform(F.sequence(k, n), lambda i: F.struct(F.abs(_at(a, i, k)).alias("size"), (-i).alias("i"))))

        def by_pivot(b: Column) -> Column:
            p = -b["i"]
            pivot = _at(a, p, k)

            def by_row(row: Column) -> Column:
                def new(r: Column, i: Column) -> Column:
                    old = F.when(i + 1 == p, F.element_at(a, k)).otherwise(r)
                    return F.when(i + 1 == k, row).otherwise(_let(old, lambda o: F.zip_with(o, row, lambda x, y: x - F.element_at(o, k) * y)))

                turned = F.struct(F.transform(a, new).alias("a"), (s["det"] * pivot * F.when(p == k, 1.0).otherwise(-1.0)).alias("det"))
                return F.when((b["size"] > 0) & (s["det"] != 0), turned).otherwise(F.struct(a.alias("a"), F.lit(0.0).alias("det")))

            return _let(F.transform(F.element_at(a, p), lambda x: F.try_divide(x, pivot)), by_row)

        return _let(best, by_pivot)

    return F.aggregate(F.sequence(F.lit(1), n), F.struct(m.alias("a"), F.lit(1.0).alias("det")), step)


def det(m: Column) -> Column:
    return F.when((rows(m) > 0) & (rows(m) == columns(m)) & _whole(m), _eliminated(m, rows(m))["det"])


def _inverse(m: Column) -> Column:
    """Of a square matrix without na: what elimination makes of the identity beside it."""
    n = rows(m)
    beside = F.transform(m, lambda r, i: F.concat(r, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(i == j, 1.0).otherwise(0.0))))
    return _let(_eliminated(beside, n), lambda s: F.when(s["det"] != 0, F.transform(s["a"], lambda r: F.slice(r, n + 1, n))))


def inv(m: Column) -> Column:
    return F.when((rows(m) > 0) & (rows(m) == columns(m)) & _whole(m), _inverse(m))


def pinv(m: Column) -> Column:
    """By the normal equations: of full rank only."""

    def of(x: np.ndarray):
        t = x.swapaxes(1, 2)
        return np.linalg.inv(t @ x) @ t if x.shape[1] >= x.shape[2] else t @ np.linalg.inv(x @ t)

    return _numpy(KIND, of)(m)


def rank(m: Column) -> Column:
    """How many pivots over the tolerance elimination finds, column by column."""

    def step(s: Column, k: Column) -> Column:
        a, top = s["a"], s["rank"] + 1
        best = F.array_max(F.transform(F.sequence(top, rows(a)), lambda i: F.struct(F.abs(_at(a, i, k)).alias("size"), (-i).alias("i"))))

        def by_pivot(b: Column) -> Column:
            p = -b["i"]

            def new(r: Column, i: Column) -> Column:
                old = F.when(i + 1 == p, F.element_at(a, top)).otherwise(r)
                low = _let(old, lambda o: F.zip_with(o, F.element_at(a, p), lambda x, y: x - F.try_divide(F.element_at(o, k), _at(a, p, k)) * y))
                return F.when(i + 1 < top, r).when(i + 1 == top, F.element_at(a, p)).otherwise(low)

            return F.when(b["size"] > TOLERANCE, F.struct(F.transform(a, new).alias("a"), top.alias("rank"))).otherwise(s)

        return F.when(top > rows(a), s).otherwise(_let(best, by_pivot))

    found = F.aggregate(F.sequence(F.lit(1), columns(m)), F.struct(m.alias("a"), F.lit(0).alias("rank")), step, lambda s: s["rank"])
    return F.when((rows(m) > 0) & (columns(m) > 0) & _whole(m), found)


def pow_(m: Column, power: int) -> Column:
    """By repeated squaring; powers below 0 are those of the inverse."""
    if power < 0:
        return pow_(inv(m), -power)
    bits = F.array(*[F.lit(power >> k & 1) for k in range(max(1, power.bit_length()))])
    one = F.transform(m, lambda r, i: F.transform(r, lambda _, j: F.when(i == j, 1.0).otherwise(0.0)))

    def step(s: Column, bit: Column) -> Column:
        return F.struct(F.when(bit == 1, mult(s["out"], s["square"])).otherwise(s["out"]).alias("out"), mult(s["square"], s["square"]).alias("square"))

    made = F.aggregate(bits, F.struct(one.alias("out"), m.alias("square")), step, lambda s: s["out"])
    return F.when((rows(m) > 0) & (rows(m) == columns(m)) & _whole(m), made)


def eigenvalues(m: Column) -> Column:
    """Of 2 x 2 matrices, the larger first; na for other sizes and complex ones."""
    a, b, c, d = (F.try_element_at(F.try_element_at(m, F.lit(i)), F.lit(j)) for i in (1, 2) for j in (1, 2))
    half, square = (a + d) / 2, ((a - d) / 2) * ((a - d) / 2) + b * c
    return F.when((rows(m) == 2) & (columns(m) == 2) & (square >= 0), F.array(half + F.sqrt(square), half - F.sqrt(square)))


def eigenvectors(m: Column) -> Column:
    """Columns are unit eigenvectors, for real eigenvalues from the largest."""

    def of(x: np.ndarray):
        value, vector = np.linalg.eig(x)
        real = (np.imag(value) == 0).all(axis=1)
        order = np.argsort(-np.real(value), axis=1)
        vector = np.take_along_axis(np.real(vector), order[:, None, :], axis=2)
        return [v if ok else None for v, ok in zip(vector, real, strict=True)]

    return _numpy(KIND, of)(m)
