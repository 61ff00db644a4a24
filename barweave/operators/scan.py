"""Recurrences as parallel prefixes: a symbol's history is cut into chunks that many tasks work through at once.

A seeded average v <- a x + (1 - a) v is an affine map of v for each value, and a chunk's maps compose to one
map again. So three steps give what a fold from the first bar to the last gives:

1. Within each chunk (symbol, bar_index // ``CHUNK``) one window sums what the average would be from 0 on, and
   how many values there are.
2. Each chunk sends one row. In a window over a symbol's chunks, fewer by the chunk's size, each is told what
   stands before it: the number of values, the average's state, and what the seed adds. States further back
   than ``1 - a`` to a power that a double can tell from 0 are no part of the frame, so it is bounded by the period.
3. The rows of step 1 meet these carries where they lie: window and join ask for one partitioning.

The seed is the mean of the first n values. It comes in as a difference: v = u + q^(k - n) (seed - u_n) for the
k-th value, where u starts from 0 and q = 1 - a.

Operators with previous values take them the same way: the last one in the chunk, or the carry. Nothing here
needs a Python worker, an ordering of a whole symbol's bars, or a collected history. Bars must be numbered from 0 in
bar_index within each symbol; those without a symbol are one series. NULL is na. Columns that begin with ``_scan`` are the scan's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars of a chunk. Weights 1 - a as low as 1/3 to this power are in a double's range.
CHUNK = 512
#: q^REACH of the smallest weight that is kept, as a power of e: about the smallest double.
REACH = 745.0


@dataclass(frozen=True)
class Average:
    """The mean of the first n values of x that are there, then a x + (1 - a) times itself; held: a bar without x has the last value, not na.

    x is a Column, or a function of this bar and the last one before it (see smooth's ``bar``), the latter null on the first."""

    name: str
    x: Column | Callable[[Column, Column], Column]
    n: int
    a: float
    held: bool = False


def exponential(name: str, x: Column | Callable, n: int, held: bool = False) -> Average:
    return Average(name, x, n, 2 / (n + 1), held)


def wilder(name: str, x: Column | Callable, n: int) -> Average:
    return Average(name, x, n, 1 / n)


KEYS = ("_scan_symbol", "_scan_chunk")


#: In SQL: what rows are dealt by, and all chunks before this one.
DEAL = ", ".join(KEYS)
BEFORE = f"PARTITION BY {KEYS[0]} ORDER BY {KEYS[1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _dealt(bars: DataFrame, chunk: int) -> DataFrame:
    """bars dealt by chunk. The symbol goes into a struct, which is never null, as the chunk is: bars without a symbol
    meet too, and as no filter or column sets them apart, both readers of the dealt bars share one exchange."""
    return bars.withColumns({KEYS[0]: F.struct("symbol"), KEYS[1]: F.coalesce(F.floor(F.col("bar_index") / chunk), F.lit(0))}).drop("symbol").repartition(*KEYS)


def _whole(rows: DataFrame, bars: DataFrame, *more: tuple[str, Column]) -> DataFrame:
    """rows with the columns of bars first, then what was made of them that is no column of the scan, and more."""
    made = [c for c in rows.columns if c not in bars.columns and not c.startswith("_scan")]
    return rows.select(*[F.col(KEYS[0])["symbol"].alias("symbol") if c == "symbol" else c for c in bars.columns], *made, *[x.alias(name) for name, x in more])


def _within():
    return Window.partitionBy(*KEYS).orderBy("bar_index")


def _chunks():
    return Window.partitionBy(KEYS[0]).orderBy(KEYS[1])


def previous(bars: DataFrame, chunk: int = CHUNK, **named: tuple[Column, Column | None]) -> DataFrame:
    """bars with columns of the value that each (x, valid) has at the last bar before this one where valid holds; without valid, at the bar before."""
    return _whole(_previous(_dealt(bars, chunk), **named), bars)


def smooth(bars: DataFrame, *averages: Average, bar: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """bars with a column for each average; bar is a struct of what functions read of this bar and the last one before, null where a bar is passed over."""
    return _whole(_smooth(_dealt(bars, chunk), chunk, *averages, bar=bar), bars)


def _previous(bars: DataFrame, **named: tuple[Column, Column | None]) -> DataFrame:
    rows = bars.withColumns({f"_scan_{k}": F.struct(x.alias("x")) if ok is None else F.when(ok, F.struct(x.alias("x"))) for k, (x, ok) in named.items()})
    ends = rows.groupBy(*KEYS).agg(*[F.max_by(f"_scan_{k}", F.when(F.col(f"_scan_{k}").isNotNull(), F.col("bar_index"))).alias(f"_scan_c{k}") for k in named])
    before = _chunks().rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*KEYS, *[F.last(f"_scan_c{k}", ignorenulls=True).over(before).alias(f"_scan_c{k}") for k in named])
    earlier = _within().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_scan_{k}": F.last(f"_scan_{k}", ignorenulls=True).over(earlier) for k in named})
    got = rows.join(carry, [*KEYS])
    return got.select(*bars.columns, *[F.coalesce(f"_scan_{k}", f"_scan_c{k}")["x"].alias(k) for k in named])


def _smooth(bars: DataFrame, chunk: int, *averages: Average, bar: Column | None = None) -> DataFrame:
    for v in averages:
        if not 0 < v.a <= 1 or v.n < 1 or v.a == 1 < v.n:
            raise ValueError(f"{v.name}: a period of at least 1 and a weight over 0 and up to 1, which goes with a period of 1 alone")
        if v.a < 1 and -math.log(1 - v.a) * chunk > 690:
            raise ValueError(f"{v.name}: a weight of {v.a} over chunks of {chunk} bars overflows a double; take shorter chunks")
        if callable(v.x) and bar is None:
            raise ValueError(f"{v.name}: a function of bars needs the bar it reads")
    kept, many, rows = bars.columns, range(len(averages)), bars
    if bar is not None:
        rows = bars.withColumns({"_scan_bar": bar, "_scan_last": F.last(bar, ignorenulls=True).over(_within().rowsBetween(Window.unboundedPreceding, -1))})
    now, last = F.col("_scan_bar"), F.col("_scan_last")
    # what a chunk's first bar makes of the bar before is known to no one yet: its value, an edge, comes in with the carry
    rows = rows.withColumns({f"_scan_x{i}": F.when(now.isNotNull() & last.isNotNull(), v.x(now, last)) if callable(v.x) else v.x for i, v in enumerate(averages)})
    rows = rows.selectExpr("*", *[f"count(_scan_x{i}) OVER (PARTITION BY {DEAL} ORDER BY bar_index) AS _scan_k{i}" for i in many])
    rows = rows.selectExpr("*", *[f"{_sum(i, v)} OVER (PARTITION BY {DEAL} ORDER BY bar_index) AS _scan_s{i}" for i, v in enumerate(averages)])
    parts = []
    for i, v in enumerate(averages):
        head = f"transform(array_sort(collect_list(struct(_scan_k{i} AS k, _scan_x{i} AS x)) FILTER (WHERE _scan_x{i} IS NOT NULL AND _scan_k{i} <= {v.n})), h -> h.x)"
        parts += [F.expr(x) for x in (f"max(_scan_k{i}) AS _scan_k{i}", f"max_by(_scan_s{i}, bar_index) AS _scan_s{i}", f"{head} AS _scan_h{i}")]
    if bar is not None:
        parts += [F.expr(f"{f}(_scan_bar, bar_index) FILTER (WHERE _scan_bar IS NOT NULL) AS {name}") for f, name in (("min_by", "_scan_bar"), ("max_by", "_scan_end"))]
    chunks = rows.groupBy(*KEYS).agg(*parts)
    if bar is not None:
        chunks = chunks.selectExpr("*", f"last(_scan_end, true) OVER ({BEFORE}) AS _scan_last")
    carry = rows.join(_carries(chunks, averages, chunk), [*KEYS])
    return carry.select(*kept, *[_value(i, v).alias(v.name) for i, v in enumerate(averages)])


def _sum(i: int, v: Average) -> str:
    """What the average would be from 0 on, brought to the chunk's begin; a weight of 1 keeps nothing of what was: the last value stands for the sum."""
    return f"last(_scan_x{i}, true)" if v.a == 1 else f"sum(_scan_x{i} * {v.a!r}D * pow({1 - v.a!r}D, -_scan_k{i}))"


def _carries(chunks: DataFrame, averages: tuple[Average, ...], chunk: int) -> DataFrame:
    """For each chunk and average g (the edge), b (values before this chunk), u (the average from 0 on before it) and d (seed less that average at the n-th value)."""
    now, last = F.col("_scan_bar"), F.col("_scan_last")
    edges = {f"_scan_g{i}": F.when(now.isNotNull(), v.x(now, last)) if callable(v.x) else F.lit(None).cast("double") for i, v in enumerate(averages)}
    chunks = chunks.withColumns(edges)
    made = []
    for i, v in enumerate(averages):
        k, s, h, g = (f"_scan_{c}{i}" for c in "kshg")
        more = f"{k} + int({g} IS NOT NULL)"
        made += [f"{more} AS _scan_m{i}", f"{_ahead(i, v, f'{g} IS NOT NULL')} AS _scan_t{i}", f"if({g} IS NULL, {h}, concat(array({g}), {h})) AS _scan_f{i}", f"coalesce(sum({more}) OVER ({BEFORE}), 0) AS _scan_b{i}"]
    chunks = chunks.selectExpr("*", *made)
    chunks = chunks.selectExpr("*", *[f"{_near(i, v, chunk)} AS _scan_l{i}" for i, v in enumerate(averages) if v.a < 1])
    return chunks.selectExpr(*KEYS, *[c for i, v in enumerate(averages) for c in (f"_scan_g{i}", f"_scan_b{i}", *_states(i, v))])


def _ahead(i: int, v: Average, edge: str) -> str:
    """The sum s with the edge as its first value, where it has one."""
    s, g = f"_scan_s{i}", f"_scan_g{i}"
    return f"if({edge}, {f'coalesce({s}, {g})' if v.a == 1 else f'(coalesce({s}, 0D) + {v.a!r}D * {g}) / {1 - v.a!r}D'}, {s})"


def _near(i: int, v: Average, chunk: int) -> str:
    """The sums of the chunks so near that a double can tell them from 0, each brought to its end, with where it ends in the count of values."""
    end = f"struct(_scan_b{i} + _scan_m{i} AS at, _scan_t{i} * pow({1 - v.a!r}D, _scan_m{i}) AS u)"
    reach = math.ceil(REACH / -math.log(1 - v.a)) + chunk
    return f"collect_list(if(_scan_m{i} > 0, {end}, NULL)) OVER (PARTITION BY {KEYS[0]} ORDER BY _scan_b{i} RANGE BETWEEN {reach} PRECEDING AND CURRENT ROW)"


def _states(i: int, v: Average) -> tuple[str, str]:
    """The average from 0 on before a chunk, and what the seed adds to it at the n-th value."""
    b, q = f"_scan_b{i}", f"{1 - v.a!r}D"
    if v.a == 1:
        return f"last(_scan_t{i}, true) OVER ({BEFORE}) AS _scan_u{i}", f"0D AS _scan_d{i}"
    u = f"aggregate(filter(_scan_l{i}, e -> e.at <= {b}), 0D, (acc, e) -> acc + e.u * pow({q}, {b} - e.at))"
    here = f"slice(_scan_f{i}, 1, int(greatest(0, {v.n} - {b})))"  # of the first n values those that stand here
    gap = f"aggregate({here}, struct(0D AS p, 0D AS u), (acc, x) -> struct(acc.p + x AS p, acc.u * {q} + x * {v.a!r}D AS u), f -> f.p / {v.n} - f.u * pow({q}, {v.n} - {b} - size({here})))"
    return f"{u} AS _scan_u{i}", f"sum(if(size({here}) > 0, {gap}, NULL)) OVER (PARTITION BY {KEYS[0]}) AS _scan_d{i}"


def _value(i: int, v: Average) -> Column:
    x, k, s, g, b, u, d = (f"_scan_{c}{i}" for c in "xksgbud")
    there, q = f"{x} IS NOT NULL", f"{1 - v.a!r}D"
    if callable(v.x):  # from the chunk's first bar on its edge counts, as its first value
        inside = f"({g} IS NOT NULL AND (_scan_bar IS NOT NULL OR _scan_last IS NOT NULL))"
        there = f"({there} OR {g} IS NOT NULL AND _scan_bar IS NOT NULL AND _scan_last IS NULL)"
        k, s = f"({k} + int({inside}))", _ahead(i, v, inside)
    value = f"coalesce({s}, {u})" if v.a == 1 else f"pow({q}, {k}) * (coalesce({s}, 0D) + {u}) + pow({q}, {b} + {k} - {v.n}) * {d}"
    return F.expr(f"if({b} + {k} >= {v.n}{'' if v.held else f' AND {there}'}, {value}, NULL)")


# --- operators ----------------------------------------------------------------------------------------


def _all(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])


def ema(bars: DataFrame, name: str, x: Column, n: int, chunk: int = CHUNK) -> DataFrame:
    """Passes over na."""
    return smooth(bars, exponential(name, x, n), chunk=chunk)


def rma(bars: DataFrame, name: str, x: Column, n: int, chunk: int = CHUNK) -> DataFrame:
    """na counts as 0."""
    return smooth(bars, wilder(name, F.coalesce(x, F.lit(0.0)), n), chunk=chunk)


def _true_range(h: Column, low: Column, p: Column) -> Column:
    """p: a close before, na on the first bar; na if the bar is."""
    return F.when(_all(h, low), F.greatest(h - low, F.abs(h - p), F.abs(low - p)))


def atr(bars: DataFrame, name: str, n: int, h: Column | None = None, low: Column | None = None, c: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """Passes over bars with an na."""
    return smooth(bars, wilder(name, lambda b, p: _true_range(b["h"], b["l"], p["c"]), n), bar=_bar(h, low, c), chunk=chunk)


def _bar(*given: Column | None) -> Column:
    """High, low and close where none is na."""
    prices = [F.col(name) if x is None else x for name, x in zip(("high", "low", "close"), given, strict=True)]
    return F.when(_all(*prices), F.struct(*[x.alias(k) for k, x in zip("hlc", prices, strict=True)]))


def _one(x: Column) -> Column:
    return F.when(x.isNotNull(), F.struct(x.alias("x")))


def rsi(bars: DataFrame, name: str, x: Column, n: int, chunk: int = CHUNK) -> DataFrame:
    def rise(b: Column, p: Column) -> Column:
        return F.when(p.isNotNull(), F.greatest(b["x"] - p["x"], F.lit(0.0)))

    rows = _smooth(_dealt(bars, chunk), chunk, wilder("_scan_up", rise, n), wilder("_scan_down", lambda b, p: F.when(p.isNotNull(), F.greatest(p["x"] - b["x"], F.lit(0.0))), n), bar=_one(x))
    up, down = F.col("_scan_up"), F.col("_scan_down")
    value = F.when(up.isNotNull(), F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down))))
    return _whole(rows, bars, (name, value))


def macd(bars: DataFrame, names: tuple[str, str, str], x: Column, fast: int, slow: int, signal: int, chunk: int = CHUNK) -> DataFrame:
    """line, signal, histogram."""
    line, sig, hist = names
    rows = _smooth(_dealt(bars, chunk), chunk, exponential("_scan_fast", x, fast), exponential("_scan_slow", x, slow))
    rows = _smooth(rows.withColumn(line, F.col("_scan_fast") - F.col("_scan_slow")), chunk, exponential(sig, F.col(line), signal))
    return _whole(rows, bars, (hist, F.col(line) - F.col(sig)))


def kc(bars: DataFrame, names: tuple[str, str, str], x: Column, n: int, mult: float, use_tr: bool = True, chunk: int = CHUNK) -> DataFrame:
    """basis, upper, lower; an na is passed over and leaves the last value; the true range is na on the first bar."""
    h, low, c = (F.col(p) for p in ("high", "low", "close"))
    width = (lambda b, p: F.when(p["c"].isNotNull(), _true_range(b["h"], b["l"], p["c"]))) if use_tr else h - low
    rows = _smooth(_dealt(bars, chunk), chunk, exponential("_scan_mid", x, n, held=True), exponential("_scan_width", width, n, held=True), bar=F.struct(h.alias("h"), low.alias("l"), c.alias("c")) if use_tr else None)
    mid, half = F.col("_scan_mid"), F.lit(mult) * F.col("_scan_width")
    return _whole(rows, bars, *zip(names, (mid, mid + half, mid - half), strict=True))


def kcw(bars: DataFrame, name: str, x: Column, n: int, mult: float, use_tr: bool = True, chunk: int = CHUNK) -> DataFrame:
    own = [f"{name}_{c}" for c in ("basis", "upper", "lower")]
    basis, upper, lower = map(F.col, own)
    return kc(bars, tuple(own), x, n, mult, use_tr, chunk).withColumn(name, F.try_divide(upper - lower, basis)).drop(*own)


def dmi(bars: DataFrame, names: tuple[str, str, str], n: int, smoothing: int, chunk: int = CHUNK) -> DataFrame:
    """+DI, -DI, ADX; bars with an na are passed over."""

    def moved(up: bool):
        def value(b: Column, p: Column) -> Column:
            rise, fall = b["h"] - p["h"], p["l"] - b["l"]
            a, other = (rise, fall) if up else (fall, rise)
            return F.when(p.isNotNull(), F.when((a > other) & (a > 0), a).otherwise(0.0))

        return value

    width = wilder("_scan_tr", lambda b, p: F.when(p.isNotNull(), _true_range(b["h"], b["l"], p["c"])), n)
    rows = _smooth(_dealt(bars, chunk), chunk, width, wilder("_scan_plus", moved(True), n), wilder("_scan_minus", moved(False), n), bar=_bar(None, None, None))
    tr = F.col("_scan_tr")
    plus, minus = (F.when(tr.isNotNull(), F.when(tr == 0, 0.0).otherwise(F.try_divide(100 * F.col(f"_scan_{s}"), tr))) for s in ("plus", "minus"))
    rows = rows.withColumns({names[0]: plus, names[1]: minus})
    a, b = F.col(names[0]), F.col(names[1])
    dx = F.when(a.isNotNull(), F.coalesce(F.try_divide(100 * F.abs(a - b), a + b), F.lit(0.0)))
    return _whole(_smooth(rows, chunk, wilder(names[2], dx, smoothing)), bars)


def tsi(bars: DataFrame, name: str, x: Column, short: int, long: int, chunk: int = CHUNK) -> DataFrame:
    rows = _smooth(_dealt(bars, chunk), chunk, exponential("_scan_a", lambda b, p: b["x"] - p["x"], long), exponential("_scan_b", lambda b, p: F.abs(b["x"] - p["x"]), long), bar=_one(x))
    rows = _smooth(rows, chunk, exponential("_scan_c", F.col("_scan_a"), short), exponential("_scan_d", F.col("_scan_b"), short))
    top, low = F.col("_scan_c"), F.col("_scan_d")
    return _whole(rows, bars, (name, F.when(top.isNotNull(), F.when(low == 0, 0.0).otherwise(F.try_divide(top, low)))))
