"""Technical-analysis operators whose output depends on their own previous output.

Each is an ordered pass over one symbol's bars. ``fold`` runs any number of them in one pass, one Arrow
batch a symbol, so ten averages cost one exchange. NULL is na and comes in as NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

NA = math.nan
Series = list[float]


class Smooth:
    """The mean of the first n values, then a * x + (1 - a) * previous; na until the n-th value."""

    def __init__(self, n: int, a: float):
        self.n, self.a, self.seen, self.sum, self.value = n, a, 0, 0.0, NA

    def add(self, x: float) -> float:
        self.seen += 1
        if self.seen < self.n:
            self.sum += x
        elif self.seen == self.n:
            self.value = (self.sum + x) / self.n
        else:
            self.value = self.a * x + (1 - self.a) * self.value
        return self.value


def exponential(n: int) -> Smooth:
    return Smooth(n, 2 / (n + 1))


def wilder(n: int) -> Smooth:
    return Smooth(n, 1 / n)


def true_range(h: float, low: float, p: float) -> float:
    """p: the previous close, na on the first bar."""
    return h - low if math.isnan(p) else max(h - low, abs(h - p), abs(low - p))


def ema(x: Series, n: int) -> Series:
    s = exponential(n)
    return [NA if math.isnan(v) else s.add(v) for v in x]


def rma(x: Series, n: int) -> Series:
    """na counts as 0."""
    s = wilder(n)
    return [s.add(0.0 if math.isnan(v) else v) for v in x]


def _valid(*bars: Series):
    """Bars without na, by place; for the others None."""
    return [None if any(map(math.isnan, b)) else b for b in zip(*bars, strict=True)]


def atr(h: Series, low: Series, c: Series, n: int) -> Series:
    s, p, out = wilder(n), NA, []
    for b in _valid(h, low, c):
        if b is None:
            out.append(NA)
            continue
        out.append(s.add(true_range(b[0], b[1], p)))
        p = b[2]
    return out


def rsi(x: Series, n: int) -> Series:
    up, down, p, out = wilder(n), wilder(n), NA, []
    for v in x:
        if math.isnan(v):
            out.append(NA)
            continue
        r = NA
        if not math.isnan(p):
            g, ls = up.add(max(v - p, 0.0)), down.add(max(p - v, 0.0))
            r = NA if math.isnan(g) else 100.0 if ls == 0 else 100 - 100 / (1 + g / ls)
        p = v
        out.append(r)
    return out


def macd(x: Series, fast: int, slow: int, signal: int) -> tuple[Series, Series, Series]:
    line = [a - b for a, b in zip(ema(x, fast), ema(x, slow), strict=True)]
    sig = ema(line, signal)
    return line, sig, [a - b for a, b in zip(line, sig, strict=True)]


def _held(x: Series, n: int) -> Series:
    """ema that gives its last value for an na."""
    s = exponential(n)
    return [s.value if math.isnan(v) else s.add(v) for v in x]


def kc(x: Series, h: Series, low: Series, c: Series, n: int, mult: float, use_tr: bool = True) -> tuple[Series, Series, Series]:
    """basis, upper, lower; the true range is na on the first bar."""
    p = [NA, *c[:-1]]
    width = [max(a - b, abs(a - q), abs(b - q)) if not math.isnan(q) else NA for a, b, q in zip(h, low, p, strict=True)] if use_tr else [a - b for a, b in zip(h, low, strict=True)]
    mid, r = _held(x, n), _held(width, n)
    return mid, [m + mult * w for m, w in zip(mid, r, strict=True)], [m - mult * w for m, w in zip(mid, r, strict=True)]


def kcw(x: Series, h: Series, low: Series, c: Series, n: int, mult: float, use_tr: bool = True) -> Series:
    mid, up, down = kc(x, h, low, c, n, mult, use_tr)
    return [(u - d) / m if m else NA for m, u, d in zip(mid, up, down, strict=True)]


def dmi(h: Series, low: Series, c: Series, n: int, smooth: int) -> tuple[Series, Series, Series]:
    """+DI, -DI, ADX."""
    t, plus, minus, adx = wilder(n), wilder(n), wilder(n), wilder(smooth)
    prev, out = None, []
    for b in _valid(h, low, c):
        if b is None or prev is None:
            prev = b or prev
            out.append((NA, NA, NA))
            continue
        up, down = b[0] - prev[0], prev[1] - b[1]
        r = t.add(true_range(b[0], b[1], prev[2]))
        p = plus.add(up if up > down and up > 0 else 0.0)
        m = minus.add(down if down > up and down > 0 else 0.0)
        prev = b
        if math.isnan(r):
            out.append((NA, NA, NA))
            continue
        p, m = (100 * p / r, 100 * m / r) if r else (0.0, 0.0)
        out.append((p, m, adx.add(100 * abs(p - m) / (p + m) if p + m else 0.0)))
    return tuple(list(z) for z in zip(*out, strict=True)) if out else ([], [], [])


def tsi(x: Series, short: int, long: int) -> Series:
    a, b, c, d = exponential(long), exponential(long), exponential(short), exponential(short)
    p, out = NA, []
    for v in x:
        r = NA
        if not math.isnan(v):
            if not math.isnan(p):
                one, two = a.add(v - p), b.add(abs(v - p))
                if not math.isnan(one):
                    top, low = c.add(one), d.add(two)
                    r = NA if math.isnan(top) else top / low if low else 0.0
            p = v
        out.append(r)
    return out


def supertrend(h: Series, low: Series, c: Series, factor: float, n: int) -> tuple[Series, Series]:
    """line, direction (-1 up, 1 down)."""
    width = atr(h, low, c, n)
    up = down = line = p = NA
    direction, out = NA, []
    for (hi, lo, close), w in zip(zip(h, low, c, strict=True), width, strict=True):
        if any(map(math.isnan, (hi, lo, close))):
            out.append((NA, NA))
            continue
        if math.isnan(w):
            out.append((NA, NA))
            p = close
            continue
        mid = (hi + lo) / 2
        new_up, new_down = mid + factor * w, mid - factor * w
        first = math.isnan(up)
        was = up
        if not first:
            new_down = new_down if new_down > down or p < down else down
            new_up = new_up if new_up < up or p > up else up
        if first:
            direction = 1.0
        elif line == was:
            direction = -1.0 if close > new_up else 1.0
        else:
            direction = 1.0 if close < new_down else -1.0
        up, down, p = new_up, new_down, close
        line = down if direction < 0 else up
        out.append((line, direction))
    return tuple(list(z) for z in zip(*out, strict=True)) if out else ([], [])


def sar(h: Series, low: Series, c: Series, start: float, inc: float, most: float) -> Series:
    out: Series = []
    seen: list[tuple[float, float, float]] = []
    rising, s, best, speed = True, NA, NA, start
    for b in _valid(h, low, c):
        if b is None:
            out.append(NA)
            continue
        hi, lo, close = b
        if not seen:
            out.append(NA)
        else:
            h1, l1, c1 = seen[-1]
            fresh = False
            if len(seen) == 1:
                rising = close > c1
                best, s, speed, fresh = (hi, l1, start, True) if rising else (lo, h1, start, True)
            s = s + speed * (best - s)
            if rising and s > lo:
                rising, s, best, speed, fresh = False, max(hi, best), lo, start, True
            elif not rising and s < hi:
                rising, s, best, speed, fresh = True, min(lo, best), hi, start, True
            if not fresh:
                if rising and hi > best or not rising and lo < best:
                    best, speed = hi if rising else lo, min(speed + inc, most)
            before = seen[-2:]
            s = min(s, *(x[1] for x in before)) if rising else max(s, *(x[0] for x in before))
            out.append(s)
        seen = [*seen[-1:], b]
    return out


@dataclass(frozen=True)
class Step:
    """names: output columns; inputs: bars' columns the kernel reads; args: its other arguments."""

    names: tuple[str, ...]
    kernel: Callable
    inputs: tuple[str, ...]
    args: tuple = ()


def fold(bars: DataFrame, *steps: Step) -> DataFrame:
    """bars with each step's columns."""
    ship(bars.sparkSession)
    new = [n for s in steps for n in s.names]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bar_index")
        got: dict[str, list[float]] = {}
        columns = {c: t.column(c).cast(pa.float64()).fill_null(NA).to_numpy().tolist() for c in {c for s in steps for c in s.inputs} - set(new)}  # others are made by earlier steps
        for s in steps:
            made = s.kernel(*(columns[c] for c in s.inputs), *s.args)
            for name, values in zip(s.names, made if len(s.names) > 1 else (made,), strict=True):
                got[name] = columns[name] = values
        for name in new:
            v = np.array(got[name], np.float64)
            t = t.append_column(name, pa.array(v, mask=np.isnan(v)))
        return t

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema), *(f"`{n}` double" for n in new)])
    return bars.groupBy("symbol").applyInArrow(run, schema)
