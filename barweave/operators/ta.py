"""Technical-analysis operators that a window can express: Columns over bars of one symbol.

Every function takes Columns and returns a Column over a symbol's bars in order; windows don't nest, so a series made by
one operator becomes a column before the next reads it. All operators over one window share one exchange
and one sort; windows of the last values that are not na (``valid``) need a sort more, no exchange. NULL is na; a full window is needed before a value appears, except where said otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def bars_in_order():
    """The window of all operators: a symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("bar_index")


def so_far():
    return bars_in_order().rowsBetween(Window.unboundedPreceding, 0)


def price(name: str) -> Column:
    return F.col(name)


def frame(n: int, back: int = 0):
    """The last n bars, up to back bars ago."""
    return bars_in_order().rowsBetween(-(n - 1) - back, -back)


def lag(x: Column, n: int = 1) -> Column:
    if n < 0:
        raise ValueError("a series is read backwards only")
    return F.lag(x, n).over(bars_in_order()) if n else x


def history(bars: DataFrame, name: str, x: Column, n: Column) -> DataFrame:
    """bars with x as it was n bars before, n a series: an equality join of a bar's number less n with the number of the bar it
    names, so no frame grows with the history. na where n is na, below 0 or before the first bar."""
    key = F.when(n >= 0, F.col("bar_index") - n).cast("long")
    then = bars.select(F.col("symbol").alias("_of"), F.col("bar_index").cast("long").alias("_at"), x.alias(name))
    rows = bars.withColumn("_then", key)
    return rows.join(then, (F.col("symbol") == F.col("_of")) & (F.col("_then") == F.col("_at")), "left").select(*bars.columns, name)


def _full(x: Column, n: int, value: Column) -> Column:
    """value where the last n bars all have x."""
    return F.when(F.count(x).over(frame(n)) == n, value)


def valid(n: int, *xs: Column) -> tuple[Column, WindowSpec]:
    """Whether none of xs is na, and the frame of the last n such bars: a gap is passed over, and na itself."""
    ok = xs[0].isNotNull()
    for x in xs[1:]:
        ok = ok & x.isNotNull()
    return ok, Window.partitionBy("symbol", ok).orderBy("bar_index").rowsBetween(-(n - 1), 0)


def _kept(ok: Column, w: WindowSpec, n: int, value: Column) -> Column:
    return F.when(ok & (F.count(F.lit(1)).over(w) == n), value)


def _age(n: int, value: Column) -> Column:
    """value from the n-th bar on, whatever is na within."""
    return F.when(F.row_number().over(bars_in_order()) >= n, value)


def _sum(x: Column, n: int) -> Column:
    return F.sum(x).over(frame(n))


def _weighted(x: Column, weights: list[float]) -> Column:
    """weights from the latest bar backwards; na if any is."""
    total = None
    for k, w in enumerate(weights):
        part = lag(x, k) * F.lit(float(w))
        total = part if total is None else total + part
    return total


# --- averages ---


def sma(x: Column, n: int) -> Column:
    return _full(x, n, F.avg(x).over(frame(n)))


def wma(x: Column, n: int) -> Column:
    """Weights n for the latest bar down to 1: in closed form from two sums, whatever n is."""
    i = F.col("bar_index").cast("double")
    return _full(x, n, (_sum(x * i, n) - (i - F.lit(float(n))) * _sum(x, n)) / F.lit(n * (n + 1) / 2))


def vwma(x: Column, n: int, volume: Column) -> Column:
    return _full(x * volume, n, F.try_divide(_sum(x * volume, n), _sum(volume, n)))


def swma(x: Column) -> Column:
    return _weighted(x, [1, 2, 2, 1]) / F.lit(6.0)


def hma_core(x: Column, n: int) -> Column:
    """2 wma(n/2) - wma(n): hma is the wma of this over floor(sqrt(n)) bars, in a second step."""
    return 2 * wma(x, n // 2) - wma(x, n)


def alma(x: Column, n: int, offset: float = 0.85, sigma: float = 6.0) -> Column:
    m, s = offset * (n - 1), n / sigma
    w = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]  # i = 0 is the oldest bar
    return _weighted(x, [v / sum(w) for v in reversed(w)])


def linreg(x: Column, n: int, offset: int = 0) -> Column:
    """Least squares over n bars (0 oldest), read at n - 1 - offset; in closed form from two sums."""
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    i = F.col("bar_index").cast("double")
    sy, siy, first = _sum(x, n), _sum(x * i, n), i - F.lit(float(n - 1))
    sxy = siy - first * sy
    den = n * sxx - sx * sx
    slope = (n * sxy - sx * sy) / F.lit(den) if den else F.lit(0.0)
    return _full(x, n, (sy - slope * sx) / n + slope * F.lit(float(n - 1 - offset)))


# --- spread ---


def stdev(x: Column, n: int, biased: bool = True) -> Column:
    """Over the last n values that are not na."""
    ok, w = valid(n, x)
    return _kept(ok, w, n, (F.stddev_pop if biased else F.stddev_samp)(x).over(w))


def variance(x: Column, n: int, biased: bool = True) -> Column:
    return _full(x, n, (F.var_pop if biased else F.var_samp)(x).over(frame(n)))


def dev(x: Column, n: int) -> Column:
    """Mean distance from the window's mean; na counts as 0."""
    z = F.coalesce(x, F.lit(0.0))
    values, mean = F.collect_list(z).over(frame(n)), F.avg(z).over(frame(n))
    return _age(n, F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / F.lit(float(n)))


def median(x: Column, n: int) -> Column:
    return _full(x, n, F.percentile(x, F.lit(0.5)).over(frame(n)))


def mode(x: Column, n: int) -> Column:
    return _full(x, n, F.mode(x, True).over(frame(n)))


def highest(x: Column, n: int = 14) -> Column:
    return _age(n, F.max(x).over(frame(n)))


def lowest(x: Column, n: int = 14) -> Column:
    return _age(n, F.min(x).over(frame(n)))


def range_(x: Column, n: int) -> Column:
    return highest(x, n) - lowest(x, n)


def _offset(x: Column, n: int, largest: bool) -> Column:
    i = F.col("bar_index")
    at = F.when(x.isNotNull(), F.struct(x.alias("x"), (i if largest else -i).alias("i")))
    best = (F.max(at) if largest else F.min(at)).over(frame(n))
    return _age(n, (best["i"] if largest else -best["i"]) - i)


def highestbars(x: Column, n: int) -> Column:
    return _offset(x, n, True)


def lowestbars(x: Column, n: int) -> Column:
    return _offset(x, n, False)


def max_(x: Column) -> Column:
    return F.max(x).over(so_far())


def min_(x: Column) -> Column:
    return F.min(x).over(so_far())


def cum(x: Column) -> Column:
    return F.coalesce(F.sum(x).over(so_far()), F.lit(0.0))


# --- change ---


def change(x: Column, n: int = 1) -> Column:
    return x - lag(x, n)


mom = change


def roc(x: Column, n: int) -> Column:
    return 100 * F.try_divide(x - lag(x, n), lag(x, n))


def _all_true(cond: Column, n: int) -> Column:
    return F.coalesce(_age(n + 1, F.min(F.coalesce(cond, F.lit(False)).cast("int")).over(frame(n)) == 1), F.lit(False))


def rising_step(x: Column) -> Column:
    return x > lag(x)


def falling_step(x: Column) -> Column:
    return x < lag(x)


def run_of(step: Column, n: int) -> Column:
    """rising or falling over n bars, from a column of rising_step or falling_step."""
    return _all_true(step, n)


def crossover(a: Column, b: Column) -> Column:
    return F.coalesce((lag(a) <= lag(b)) & (a > b), F.lit(False))


def crossunder(a: Column, b: Column) -> Column:
    return F.coalesce((lag(a) >= lag(b)) & (a < b), F.lit(False))


def cross(a: Column, b: Column) -> Column:
    return crossover(a, b) | crossunder(a, b)


def barssince(cond: Column) -> Column:
    i = F.col("bar_index")
    return i - F.last(F.when(cond, i), ignorenulls=True).over(so_far())


def hit(cond: Column, x: Column, occurrence: int = 0) -> Column:
    """At a bar where cond is true, x as it was that many hits before; for valuewhen. Hits alone are in the window: the state is a lag."""
    ok = F.coalesce(cond, F.lit(False))
    at = Window.partitionBy("symbol", ok).orderBy("bar_index")
    return F.when(ok, F.struct((F.lag(x, occurrence).over(at) if occurrence else x).alias("x")))


def valuewhen(hit_: Column) -> Column:
    """What the last hit so far says, from a column of hit; na as long as there were too few."""
    return F.last(hit_, ignorenulls=True).over(so_far())["x"]


def tr(handle_na: bool = True) -> Column:
    p = lag(price("close"))
    full = F.greatest(price("high") - price("low"), F.abs(price("high") - p), F.abs(price("low") - p))
    return F.when(p.isNotNull(), full).otherwise(price("high") - price("low") if handle_na else F.lit(None).cast("double"))


# --- bands and oscillators ---


def bb(x: Column, n: int, mult: float) -> Column:
    """Over the last n values that are not na."""
    ok, w = valid(n, x)
    mid, s = _kept(ok, w, n, F.avg(x).over(w)), stdev(x, n)
    return F.struct(mid.alias("middle"), (mid + mult * s).alias("upper"), (mid - mult * s).alias("lower"))


def bbw(x: Column, n: int, mult: float) -> Column:
    ok, w = valid(n, x)
    mid = _kept(ok, w, n, F.avg(x).over(w))
    return F.when(mid == 0, 0.0).otherwise(F.try_divide(100 * (2 * mult * stdev(x, n)), mid))


def cci(x: Column, n: int) -> Column:
    """Over the last n values that are not na."""
    ok, w = valid(n, x)
    values, mean = F.collect_list(x).over(w), F.avg(x).over(w)
    d = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / F.lit(float(n))
    return _kept(ok, w, n, F.when(d == 0, 0.0).otherwise(F.try_divide(x - mean, 0.015 * d)))


def cmo(change_: Column, n: int) -> Column:
    """change_: a column of change(x), of which the last n that are not na count."""
    ok, w = valid(n, change_)
    up, down = F.sum(F.greatest(change_, F.lit(0.0))).over(w), F.sum(F.greatest(-change_, F.lit(0.0))).over(w)
    return _kept(ok, w, n, F.when(up + down == 0, 0.0).otherwise(F.try_divide(100 * (up - down), up + down)))


def cog(x: Column, n: int) -> Column:
    return -F.try_divide(_weighted(x, [k + 1 for k in range(n)]), _sum(x, n))


def correlation(a: Column, b: Column, n: int) -> Column:
    """Pearson over pairs without na; explicit sums, because corr divides by zero on short frames."""
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    k = F.count(x).over(frame(n)).cast("double")
    sxy = _sum(x * y, n) - _sum(x, n) * _sum(y, n) / k
    sxx, syy = _sum(x * x, n) - _sum(x, n) * _sum(x, n) / k, _sum(y * y, n) - _sum(y, n) * _sum(y, n) / k
    flat = (F.max(x).over(frame(n)) == F.min(x).over(frame(n))) | (F.max(y).over(frame(n)) == F.min(y).over(frame(n)))
    return _age(n, F.when(k >= 2, F.when(flat, 0.0).otherwise(F.try_divide(sxy, F.sqrt(F.greatest(sxx, F.lit(0.0)) * F.greatest(syy, F.lit(0.0)))))))


def stoch(x: Column, high: Column, low: Column, n: int) -> Column:
    """Over the last n bars where neither price is na."""
    ok, w = valid(n, x, high, low)
    lo, hi = F.min(low).over(w), F.max(high).over(w)
    return _kept(ok, w, n, 100 * F.try_divide(x - lo, hi - lo))


def wpr(n: int) -> Column:
    """Over the last n bars where no price is na."""
    close, high, low = price("close"), price("high"), price("low")
    ok, w = valid(n, close, high, low)
    lo, hi = F.min(low).over(w), F.max(high).over(w)
    return _kept(ok, w, n, F.when(hi == lo, 0.0).otherwise(-100 * F.try_divide(hi - close, hi - lo)))


def mfi(x: Column, change_: Column, n: int, volume: Column) -> Column:
    """change_: a column of change(x); a bar without one counts on both sides. Over the last n bars where x and volume are not na."""
    ok, w = valid(n, x, volume)
    flow = x * volume
    up = F.sum(F.when(change_.isNull() | (change_ > 0), flow).otherwise(0.0)).over(w)
    down = F.sum(F.when(change_.isNull() | (change_ < 0), flow).otherwise(0.0)).over(w)
    return _kept(ok, w, n, F.when(down == 0, 100.0).when(up == 0, 0.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, down))))


# --- volume ---


def vwap(x: Column, volume: Column, zone: str = "UTC") -> Column:
    """Cumulated within the calendar day of the zone."""
    day = F.to_date(F.from_utc_timestamp(F.col("time").cast("timestamp"), zone))
    w = Window.partitionBy("symbol", day).orderBy("bar_index").rowsBetween(Window.unboundedPreceding, 0)
    return F.try_divide(F.sum(x * volume).over(w), F.sum(volume).over(w))


def obv_step() -> Column:
    return F.coalesce(F.signum(price("close") - lag(price("close"))) * price("volume"), F.lit(0.0))


def pvt_step() -> Column:
    return F.coalesce(F.when(lag(price("close")) != 0, (price("close") - lag(price("close"))) / lag(price("close")) * price("volume")), F.lit(0.0))


def accdist_step() -> Column:
    return F.coalesce(F.when(price("high") != price("low"), ((price("close") - price("low")) - (price("high") - price("close"))) / (price("high") - price("low")) * price("volume")), F.lit(0.0))


def wad_step() -> Column:
    p = lag(price("close"))
    return F.coalesce(F.when(price("close") > p, price("close") - F.least(price("low"), p)).when(price("close") < p, price("close") - F.greatest(price("high"), p)), F.lit(0.0))


def index_step(falls: bool) -> Column:
    """1 + relative change where volume falls (nvi) or rises (pvi), else 1; na counts as 0, a zero price is skipped."""
    c, p, v, u = (F.coalesce(z, F.lit(0.0)) for z in (price("close"), lag(price("close")), price("volume"), lag(price("volume"))))
    moved = (v < u) if falls else (v > u)
    return F.when((F.row_number().over(bars_in_order()) > 1) & moved & (c != 0) & (p != 0), 1 + (c - p) / p).otherwise(1.0)


def total(step: Column) -> Column:
    """obv, pvt, accdist and wad from columns of their steps."""
    return F.sum(step).over(so_far())


def compounded(step: Column) -> Column:
    """nvi and pvi from columns of index_step."""
    return F.product(step).over(so_far())


def iii() -> Column:
    den = (price("high") - price("low")) * price("volume")
    return F.when(den == 0, 0.0).otherwise(F.try_divide(2 * price("close") - price("high") - price("low"), den))


def wvad() -> Column:
    return F.try_divide(price("close") - price("open"), price("high") - price("low")) * price("volume")


# --- ranks ---


def percentile_linear_interpolation(x: Column, n: int, p: float) -> Column:
    s = F.sort_array(F.collect_list(x).over(frame(n)))
    at = min(max(p / 100 * n - 0.5, 0.0), n - 1.0)
    k = int(math.floor(at))
    low, high = F.try_element_at(s, F.lit(k + 1)), F.try_element_at(s, F.lit(min(k + 2, n)))
    return _full(x, n, low + (high - low) * F.lit(at - k))


def percentile_nearest_rank(x: Column, n: int, p: float) -> Column:
    s = F.sort_array(F.collect_list(x).over(frame(n)))
    k = F.greatest(F.ceil(F.lit(p / 100) * F.size(s)).cast("int"), F.lit(1))
    return _age(n, F.try_element_at(s, k))


def percentrank(x: Column, n: int) -> Column:
    before = F.collect_list(x).over(bars_in_order().rowsBetween(-n, -1))
    return F.when((F.col("bar_index") >= n) & x.isNotNull(), 100.0 * F.try_divide(F.size(F.filter(before, lambda v: v <= x)), F.size(before)))


def _pivot(x: Column, left: int, right: int, largest: bool) -> Column:
    mid, best = lag(x, right), F.max if largest else F.min
    a = best(x).over(bars_in_order().rowsBetween(-(left + right), -(right + 1)))
    b = best(x).over(bars_in_order().rowsBetween(-(right - 1), 0))
    ok = (mid > a) & (mid > b) if largest else (mid < a) & (mid < b)
    return F.when((F.count(x).over(frame(left + right + 1)) == left + right + 1) & ok, mid)


def pivothigh(x: Column, left: int = 2, right: int = 2) -> Column:
    return _pivot(x, left, right, True)


def pivotlow(x: Column, left: int = 2, right: int = 2) -> Column:
    return _pivot(x, left, right, False)


# --- na ---


def nz(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(value))


def fixnan(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())
