"""Queries for the window and recursive operators over hourly bars of events, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import recursive as R
from ..operators import scan, ta
from .bars import event_bars, sql_bars

N = 14
Q: dict = {}
SQL: dict[str, str] = {}
KEYS = ("symbol", "bar_index")


def tidy(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The keys and the named columns, doubles to so many places."""
    kinds = dict(df.dtypes)
    return df.select(*KEYS, *[(F.round(n, digits) + F.lit(0.0)).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


def windows(n: int = N) -> str:
    by = "PARTITION BY symbol ORDER BY bar_index"
    return f"WINDOW w AS ({by}), f AS ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), c AS ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def r6(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


def add(name: str, make, sql: dict[str, str] | str | None, pre: str = "", n: int = N, source: str = "b", exact: tuple[str, ...] = (), digits: int = 6) -> None:
    """make: of bars, a Column (named value), a dict of them, or bars with more columns; sql: an expression for each output."""

    def run(spark, sf_dir: str) -> DataFrame:
        bars = event_bars(spark, sf_dir)
        made = make(bars)
        if not isinstance(made, DataFrame):
            made = bars.withColumns({"value": made} if isinstance(made, Column) else made)
        names = [c for c in made.columns if c not in bars.columns and not c.startswith("_")]
        return tidy(made, *names, digits=digits)

    Q[f"ta_{name}"] = run
    if sql is not None:
        out = {"value": sql} if isinstance(sql, str) else sql
        cells = ", ".join(f"{v if k in exact else r6(v, digits)} AS {k}" for k, v in out.items())
        SQL[f"ta_{name}"] = f"WITH RECURSIVE b AS MATERIALIZED (SELECT * FROM {sql_bars()}){pre}\nSELECT symbol, bar_index, {cells} FROM {source} {windows(n)}"


def full(x: str, value: str, n: int = N) -> str:
    return f"CASE WHEN count({x}) OVER f = {n} THEN {value} END"


def aged(value: str, n: int = N) -> str:
    return f"CASE WHEN bar_index >= {n - 1} THEN {value} END"


def weighted(x: str, weights: list[float]) -> str:
    return " + ".join(f"lag({x}, {k}) OVER w * CAST({w!r} AS DOUBLE)" for k, w in enumerate(weights))


def step(expression: str, name: str = "s", source: str = "b", alias: str = "d") -> str:
    return f", {alias} AS MATERIALIZED (SELECT *, {expression} AS {name} FROM {source} {windows()})"


def smooth(name: str, source: str, x: str, first: int, n: int, a: float) -> str:
    """CTEs for a seeded recursive average of x from bar first on; columns symbol, bar_index, e."""
    return f""", {name} AS (
  SELECT symbol, CAST({first + n - 1} AS BIGINT) AS bar_index, CAST(avg({x}) AS DOUBLE) AS e FROM {source} WHERE bar_index BETWEEN {first} AND {first + n - 1} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT s.symbol, CAST(s.bar_index AS BIGINT), CAST({a!r} AS DOUBLE) * s.{x} + (1 - CAST({a!r} AS DOUBLE)) * {name}.e
  FROM {name} JOIN {source} s ON s.symbol = {name}.symbol AND s.bar_index = {name}.bar_index + 1)"""


def joined(alias: str, base: str, **parts: str) -> str:
    """base with the e of each smooth as a column of its name."""
    cols = ", ".join(f"{p}.e AS {k}" for k, p in parts.items())
    return f", {alias} AS MATERIALIZED (SELECT {base}.*, {cols} FROM {base} " + " ".join(f"LEFT JOIN {p} ON {p}.symbol = {base}.symbol AND {p}.bar_index = {base}.bar_index" for p in parts.values()) + ")"




class _Prices:
    """Columns by their usual letters, made when a query runs."""

    names = {"C": "close", "H": "high", "L": "low", "O": "open", "V": "volume"}

    def __getattr__(self, letter: str) -> Column:
        return F.col(self.names[letter])


P = _Prices()
TR = "CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"

# averages
add("sma", lambda b: ta.sma(P.C, N), full("close", "avg(close) OVER f"))
add("wma", lambda b: ta.wma(P.C, N), f"({weighted('close', [float(N - k) for k in range(N)])}) / {N * (N + 1) / 2}")
add("vwma", lambda b: ta.vwma(P.C, N, P.V), full("close * volume", "sum(close * volume) OVER f / sum(volume) OVER f"))
add("swma", lambda b: ta.swma(P.C), f"({weighted('close', [1.0, 2.0, 2.0, 1.0])}) / 6")
_h = N // 2
_core = f"2 * ({weighted('close', [float(_h - k) for k in range(_h)])}) / {_h * (_h + 1) / 2} - ({weighted('close', [float(N - k) for k in range(N)])}) / {N * (N + 1) / 2}"
add("hma", lambda b: b.withColumn("_s", ta.hma_core(P.C, N)).withColumn("value", ta.wma(F.col("_s"), int(math.sqrt(N)))), f"({weighted('s', [3.0, 2.0, 1.0])}) / 6", step(_core), source="d")
_m, _s = 0.85 * (N - 1), N / 6.0
_w = [math.exp(-((i - _m) ** 2) / (2 * _s * _s)) for i in range(N)]
add("alma", lambda b: ta.alma(P.C, N), weighted("close", [v / sum(_w) for v in reversed(_w)]))
add("linreg", lambda b: ta.linreg(P.C, N, 1), full("close", f"regr_intercept(close, bar_index) OVER f + regr_slope(close, bar_index) OVER f * (bar_index - 1)"))
# spread
add("stdev", lambda b: ta.stdev(P.C, N), full("close", "stddev_pop(close) OVER f"))
add("variance", lambda b: ta.variance(P.C, N), full("close", "var_pop(close) OVER f"))
_lists = ", l AS MATERIALIZED (SELECT *, list(close) OVER f AS x, avg(close) OVER f AS m FROM b " + windows() + "), d AS MATERIALIZED (SELECT *, list_avg(list_transform(x, lambda v: abs(v - m))) AS s FROM l)"
add("dev", lambda b: ta.dev(P.C, N), aged("s"), _lists, source="d")
add("median", lambda b: ta.median(P.C, N), full("close", "quantile_cont(close, 0.5) OVER f"))
add("mode", lambda b: ta.mode(F.floor(P.C).cast("double"), N), full("close", "s"), ", l AS MATERIALIZED (SELECT *, list(floor(close)) OVER f AS x FROM b " + windows() + "), u AS (SELECT symbol, bar_index, unnest(x) AS v FROM l), g AS (SELECT symbol, bar_index, v, count(*) AS k FROM u GROUP BY ALL), m AS (SELECT symbol, bar_index, first(v ORDER BY k DESC, v) AS s FROM g GROUP BY ALL), d AS MATERIALIZED (SELECT b.*, m.s FROM b JOIN m USING (symbol, bar_index))", source="d")
add("highest", lambda b: ta.highest(P.H, N), aged("max(high) OVER f"))
add("lowest", lambda b: ta.lowest(P.L, N), aged("min(low) OVER f"))
add("range", lambda b: ta.range_(P.C, N), aged("max(close) OVER f - min(close) OVER f"))
add("highestbars", lambda b: ta.highestbars(P.H, N).cast("int"), aged("CAST(arg_max(bar_index, high * 1000000 + bar_index / 1000.0) OVER f - bar_index AS INTEGER)"), exact=("value",))
add("lowestbars", lambda b: ta.lowestbars(P.L, N).cast("int"), aged("CAST(arg_min(bar_index, low * 1000000 - bar_index / 1000.0) OVER f - bar_index AS INTEGER)"), exact=("value",))
add("max", lambda b: ta.max_(P.C), "max(close) OVER c")
add("min", lambda b: ta.min_(P.C), "min(close) OVER c")
add("cum", lambda b: ta.cum(P.C), "sum(close) OVER c")
# change
add("change", lambda b: ta.change(P.C, 3), "close - lag(close, 3) OVER w")
add("mom", lambda b: ta.mom(P.C, 10), "close - lag(close, 10) OVER w")
add("roc", lambda b: ta.roc(P.C, 5), "100 * (close - lag(close, 5) OVER w) / nullif(lag(close, 5) OVER w, 0)")
for _name, _fn, _op in (("rising", ta.rising_step, ">"), ("falling", ta.falling_step, "<")):
    add(_name, lambda b, f=_fn: b.withColumn("_s", f(P.C)).withColumn("value", ta.run_of(F.col("_s"), 2)), "bar_index >= 2 AND coalesce(min(CAST(coalesce(s, false) AS INTEGER)) OVER f = 1, false)", step(f"close {_op} lag(close) OVER w"), n=2, source="d", exact=("value",))
_pair = step("avg(close) OVER f", "m")
add("crossover", lambda b: b.withColumn("_m", F.avg(P.C).over(ta.frame(N))).withColumn("value", ta.crossover(P.C, F.col("_m"))), "coalesce(lag(close) OVER w <= lag(m) OVER w AND close > m, false)", _pair, source="d", exact=("value",))
add("crossunder", lambda b: b.withColumn("_m", F.avg(P.C).over(ta.frame(N))).withColumn("value", ta.crossunder(P.C, F.col("_m"))), "coalesce(lag(close) OVER w >= lag(m) OVER w AND close < m, false)", _pair, source="d", exact=("value",))
add("cross", lambda b: b.withColumn("_m", F.avg(P.C).over(ta.frame(N))).withColumn("value", ta.cross(P.C, F.col("_m"))), "coalesce(lag(close) OVER w <= lag(m) OVER w AND close > m, false) OR coalesce(lag(close) OVER w >= lag(m) OVER w AND close < m, false)", _pair, source="d", exact=("value",))
add("barssince", lambda b: ta.barssince(P.C > 50).cast("int"), "CAST(bar_index - max(CASE WHEN close > 50 THEN bar_index END) OVER c AS INTEGER)", exact=("value",))
add("valuewhen", lambda b: b.withColumns({"_h": ta.hit(P.C > 50, P.O), "_h1": ta.hit(P.C > 50, P.O, 1)}).withColumns({"value": ta.valuewhen(F.col("_h")), "second": ta.valuewhen(F.col("_h1"))}), {"value": "x[-1]", "second": "x[-2]"}, ", d AS MATERIALIZED (SELECT *, list(open) FILTER (close > 50) OVER c AS x FROM b " + windows() + ")", source="d")
add("tr", lambda b: {"value": ta.tr(), "strict": ta.tr(False)}, {"value": TR, "strict": f"CASE WHEN lag(close) OVER w IS NOT NULL THEN {TR} END"})
# bands and oscillators
add("bb", lambda b: b.withColumn("_b", ta.bb(P.C, N, 2.0)).select("*", "_b.*"), {"middle": full("close", "avg(close) OVER f"), "upper": full("close", "avg(close) OVER f + 2 * stddev_pop(close) OVER f"), "lower": full("close", "avg(close) OVER f - 2 * stddev_pop(close) OVER f")})
add("bbw", lambda b: ta.bbw(P.C, N, 2.0), full("close", "100 * 4 * stddev_pop(close) OVER f / avg(close) OVER f"))
add("cci", lambda b: ta.cci(P.C, N), full("close", "CASE WHEN s = 0 THEN 0 ELSE (close - m) / (0.015 * s) END"), _lists, source="d")
_chg = step("close - lag(close) OVER w")
add("cmo", lambda b: b.withColumn("_s", ta.change(P.C)).withColumn("value", ta.cmo(F.col("_s"), N)), full("s", "coalesce(100 * sum(s) OVER f / nullif(sum(abs(s)) OVER f, 0), 0)"), _chg, source="d")
add("cog", lambda b: ta.cog(P.C, N), f"-({weighted('close', [k + 1.0 for k in range(N)])}) / sum(close) OVER f")
add("correlation", lambda b: ta.correlation(P.C, P.V, N), aged("CASE WHEN max(close) OVER f = min(close) OVER f OR max(volume) OVER f = min(volume) OVER f THEN 0 ELSE corr(close, volume) OVER f END"))
add("stoch", lambda b: ta.stoch(P.C, P.H, P.L, N), aged("100 * (close - min(low) OVER f) / nullif(max(high) OVER f - min(low) OVER f, 0)"))
add("wpr", lambda b: ta.wpr(N), aged("coalesce(-100 * (max(high) OVER f - close) / nullif(max(high) OVER f - min(low) OVER f, 0), 0)"))
_up, _down = ("sum(CASE WHEN s IS NULL OR s %s 0 THEN close * volume ELSE 0 END) OVER f" % o for o in (">", "<"))
add("mfi", lambda b: b.withColumn("_s", ta.change(P.C)).withColumn("value", ta.mfi(P.C, F.col("_s"), N, P.V)), full("close", f"CASE WHEN {_down} = 0 THEN 100 WHEN {_up} = 0 THEN 0 ELSE 100 - 100 / (1 + {_up} / {_down}) END"), _chg, source="d")
# volume
add("vwap", lambda b: ta.vwap(P.C, P.V), "sum(close * volume) OVER day / sum(volume) OVER day", source="b", digits=9)
SQL["ta_vwap"] += ", day AS (PARTITION BY symbol, CAST(time AS DATE) ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
for _name, _fn, _sql in (
    ("obv", ta.obv_step, "coalesce(sign(close - lag(close) OVER w) * volume, 0)"),
    ("pvt", ta.pvt_step, "coalesce((close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * volume, 0)"),
    ("accdist", ta.accdist_step, "coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0)"),
    ("wad", ta.wad_step, "coalesce(CASE WHEN close > lag(close) OVER w THEN close - least(low, lag(close) OVER w) WHEN close < lag(close) OVER w THEN close - greatest(high, lag(close) OVER w) END, 0)"),
):
    add(_name, lambda b, f=_fn: b.withColumn("_s", f()).withColumn("value", ta.total(F.col("_s"))), "sum(s) OVER c", step(_sql), source="d", digits=4)
for _name, _falls, _op in (("nvi", True, "<"), ("pvi", False, ">")):
    _sql = f"CASE WHEN volume {_op} lag(volume) OVER w AND close <> 0 AND lag(close) OVER w <> 0 THEN close / lag(close) OVER w ELSE 1.0 END"
    # compounded prices grow without bound; compare their logarithm
    add(_name, lambda b, f=_falls: b.withColumn("_s", ta.index_step(f)).withColumn("_v", ta.compounded(F.col("_s"))).withColumn("value", F.ln("_v")), "sum(ln(s)) OVER c", step(_sql), source="d")
add("iii", lambda b: ta.iii(), "coalesce((2 * close - high - low) / nullif((high - low) * volume, 0), 0)")
add("wvad", lambda b: ta.wvad(), "(close - open) / nullif(high - low, 0) * volume")
# ranks
_x = ", d AS MATERIALIZED (SELECT *, list_sort(list(close) OVER f) AS x, list(close) OVER p AS before FROM b " + windows() + f", p AS (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING))"
_at = 40 / 100 * N - 0.5
add("percentile_linear_interpolation", lambda b: ta.percentile_linear_interpolation(P.C, N, 40), full("close", f"x[{int(_at) + 1}] + (x[{int(_at) + 2}] - x[{int(_at) + 1}]) * {_at - int(_at)!r}"), _x, source="d")
add("percentile_nearest_rank", lambda b: ta.percentile_nearest_rank(P.C, N, 40), aged(f"x[{math.ceil(0.4 * N)}]"), _x, source="d")
add("percentrank", lambda b: ta.percentrank(P.C, N), f"CASE WHEN bar_index >= {N} THEN 100.0 * len(list_filter(before, lambda v: v <= close)) / len(before) END", _x, source="d")
_five = "count(*) OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5"
add("pivothigh", lambda b: ta.pivothigh(P.H, 2, 2), f"CASE WHEN {_five} AND lag(high, 2) OVER w > greatest(lag(high, 4) OVER w, lag(high, 3) OVER w, lag(high) OVER w, high) THEN lag(high, 2) OVER w END")
add("pivotlow", lambda b: ta.pivotlow(P.L, 2, 2), f"CASE WHEN {_five} AND lag(low, 2) OVER w < least(lag(low, 4) OVER w, lag(low, 3) OVER w, lag(low) OVER w, low) THEN lag(low, 2) OVER w END")


# recursive
def rec(name: str, make, sql=None, pre: str = "", source: str = "j") -> None:
    add(name, make, sql, pre, source=source)


_src = step(TR, "tr")
rec("ema", lambda b: scan.ema(b, "value", P.C, N), sql="e", pre=smooth("k", "b", "close", 0, N, 2 / (N + 1)) + joined("j", "b", e="k"))
rec("rma", lambda b: scan.rma(b, "value", P.C, N), sql="e", pre=smooth("k", "b", "close", 0, N, 1 / N) + joined("j", "b", e="k"))
rec("atr", lambda b: scan.atr(b, "value", N), sql="e", pre=_src + smooth("k", "d", "tr", 0, N, 1 / N) + joined("j", "d", e="k"))
_gl = ", d AS MATERIALIZED (SELECT *, greatest(close - lag(close) OVER w, 0) AS g, greatest(lag(close) OVER w - close, 0) AS l FROM b " + windows() + ")"
rec("rsi", lambda b: scan.rsi(b, "value", P.C, N), sql="CASE WHEN l1 = 0 THEN 100 ELSE 100 - 100 / (1 + g1 / l1) END", pre=_gl + smooth("kg", "d", "g", 1, N, 1 / N) + smooth("kl", "d", "l", 1, N, 1 / N) + joined("j", "d", g1="kg", l1="kl"))
_two = smooth("kf", "b", "close", 0, 12, 2 / 13) + smooth("ks", "b", "close", 0, 26, 2 / 27) + joined("j0", "b", f1="kf", s1="ks") + ", j1 AS MATERIALIZED (SELECT *, f1 - s1 AS m FROM j0)"
rec("macd", lambda b: scan.macd(b, ("macd", "signal", "hist"), P.C, 12, 26, 9), sql={"macd": "m", "signal": "sg", "hist": "m - sg"}, pre=_two + smooth("kq", "j1", "m", 25, 9, 0.2) + joined("j", "j1", sg="kq"))
_kc = _src + smooth("km", "d", "close", 0, N, 2 / (N + 1)) + smooth("kr", "d", "tr", 1, N, 2 / (N + 1)) + joined("j", "d", m="km", r="kr")
rec("kc", lambda b: scan.kc(b, ("basis", "upper", "lower"), P.C, N, 2.0), sql={"basis": "m", "upper": "m + 2 * r", "lower": "m - 2 * r"}, pre=_kc)
rec("kcw", lambda b: scan.kcw(b, "value", P.C, N, 2.0), sql="4 * r / m", pre=_kc)
_dm = ", d AS MATERIALIZED (SELECT *, " + TR + " AS tr, CASE WHEN high - lag(high) OVER w > greatest(lag(low) OVER w - low, 0) THEN high - lag(high) OVER w ELSE 0 END AS p, CASE WHEN lag(low) OVER w - low > greatest(high - lag(high) OVER w, 0) THEN lag(low) OVER w - low ELSE 0 END AS q FROM b " + windows() + ")"
_dm += smooth("kt", "d", "tr", 1, N, 1 / N) + smooth("kp", "d", "p", 1, N, 1 / N) + smooth("kq", "d", "q", 1, N, 1 / N) + joined("j0", "d", t1="kt", p1="kp", q1="kq")
_dm += ", j1 AS MATERIALIZED (SELECT *, 100 * p1 / t1 AS plus, 100 * q1 / t1 AS minus, CASE WHEN p1 + q1 = 0 THEN 0 ELSE 100 * abs(p1 - q1) / (p1 + q1) END AS dx FROM j0)"
rec("dmi", lambda b: scan.dmi(b, ("plus", "minus", "adx"), N, N), sql={"plus": "plus", "minus": "minus", "adx": "a1"}, pre=_dm + smooth("ka", "j1", "dx", N, N, 1 / N) + joined("j", "j1", a1="ka"))
_ts = ", d AS MATERIALIZED (SELECT *, close - lag(close) OVER w AS p, abs(close - lag(close) OVER w) AS q FROM b " + windows() + ")" + smooth("k1", "d", "p", 1, 25, 2 / 26) + smooth("k2", "d", "q", 1, 25, 2 / 26) + joined("j0", "d", p1="k1", q1="k2")
rec("tsi", lambda b: scan.tsi(b, "value", P.C, 13, 25), sql="CASE WHEN q2 = 0 THEN 0 ELSE p2 / q2 END", pre=_ts + smooth("k3", "j0", "p1", 25, 13, 2 / 14) + smooth("k4", "j0", "q1", 25, 13, 2 / 14) + joined("j", "j0", p2="k3", q2="k4"))
_trend = _src + smooth("k", "d", "tr", 0, 10, 0.1) + joined("j0", "d", w="k") + """, j1 AS MATERIALIZED (SELECT *, (high + low) / 2 + 3 * w AS nu, (high + low) / 2 - 3 * w AS nd FROM j0), t AS (
  SELECT symbol, CAST(bar_index AS BIGINT) AS bar_index, nu AS up, nd AS down, nu AS line, CAST(1 AS DOUBLE) AS direction, close AS p FROM j1 WHERE bar_index = 9
  UNION ALL SELECT symbol, bar_index, up, down, CASE WHEN direction < 0 THEN down ELSE up END, direction, p FROM (
    SELECT *, CAST(CASE WHEN above THEN CASE WHEN p > up THEN -1 ELSE 1 END WHEN p < down THEN 1 ELSE -1 END AS DOUBLE) AS direction FROM (
      SELECT j1.symbol, CAST(j1.bar_index AS BIGINT) AS bar_index, CASE WHEN nu < t.up OR t.p > t.up THEN nu ELSE t.up END AS up, CASE WHEN nd > t.down OR t.p < t.down THEN nd ELSE t.down END AS down, t.line = t.up AS above, j1.close AS p
      FROM t JOIN j1 ON j1.symbol = t.symbol AND j1.bar_index = t.bar_index + 1)))
, j AS MATERIALIZED (SELECT b.symbol, b.bar_index, line, direction FROM b LEFT JOIN t ON t.symbol = b.symbol AND t.bar_index = b.bar_index)"""
rec("supertrend", lambda b: R.fold(b, R.Step(("line", "direction"), R.supertrend, ("high", "low", "close"), (3.0, 10))), sql={"line": "line", "direction": "direction"}, pre=_trend)
_turns = """, t AS (
  SELECT symbol, CAST(bar_index AS BIGINT) AS bar_index, high, low, close, CAST(NULL AS DOUBLE) AS h1, CAST(NULL AS DOUBLE) AS l1, CAST(NULL AS BOOLEAN) AS rising, CAST(NULL AS DOUBLE) AS best, CAST(0.02 AS DOUBLE) AS speed, CAST(NULL AS DOUBLE) AS s FROM b WHERE bar_index = 0
  UNION ALL SELECT symbol, bar_index, high, low, close, h1, l1, rising,
    CASE WHEN further THEN CASE WHEN rising THEN high ELSE low END ELSE best END, CASE WHEN further THEN least(speed + 0.02, 0.2) ELSE speed END,
    CASE WHEN rising THEN least(s, l1, l2) ELSE greatest(s, h1, h2) END
  FROM (SELECT *, NOT fresh AND CASE WHEN rising THEN high > best ELSE low < best END AS further FROM (
    SELECT symbol, bar_index, high, low, close, h1, l1, h2, l2, rising <> turns AS rising, begins OR turns AS fresh, CASE WHEN turns THEN CASE WHEN rising THEN low ELSE high END ELSE best END AS best,
      CASE WHEN turns THEN 0.02 ELSE speed END AS speed, CASE WHEN turns THEN CASE WHEN rising THEN greatest(high, best) ELSE least(low, best) END ELSE s END AS s
    FROM (SELECT *, CASE WHEN rising THEN s > low ELSE s < high END AS turns FROM (SELECT * REPLACE (s + speed * (best - s) AS s) FROM (
      SELECT b.symbol, CAST(b.bar_index AS BIGINT) AS bar_index, b.high, b.low, b.close, t.high AS h1, t.low AS l1, t.h1 AS h2, t.l1 AS l2, t.bar_index = 0 AS begins, coalesce(t.rising, b.close > t.close) AS rising,
        coalesce(t.best, CASE WHEN b.close > t.close THEN b.high ELSE b.low END) AS best, t.speed, coalesce(t.s, CASE WHEN b.close > t.close THEN t.low ELSE t.high END) AS s
      FROM t JOIN b ON b.symbol = t.symbol AND b.bar_index = t.bar_index + 1))))))
, j AS MATERIALIZED (SELECT b.symbol, b.bar_index, t.s FROM b LEFT JOIN t ON t.symbol = b.symbol AND t.bar_index = b.bar_index)"""
rec("sar", lambda b: R.fold(b, R.Step(("value",), R.sar, ("high", "low", "close"), (0.02, 0.02, 0.2))), sql="s", pre=_turns)


# the same where values are missing: each seventh bar has none
def _gaps(b: DataFrame) -> DataFrame:
    hole = F.col("bar_index") % 7 == 3
    return b.withColumns({c: F.when(~hole, F.col(c)) for c in ("close", "high", "low")})


def gap(name: str, make, sql: dict[str, str] | str, pre: str = "", kept: str = "close IS NOT NULL", n: int = N) -> None:
    """sql: over the bars kept alone, numbered anew as i; elsewhere na."""
    Q[f"ta_gaps_{name}"] = lambda spark, sf_dir: _gap_run(make, spark, sf_dir)
    out = {"value": sql} if isinstance(sql, str) else sql
    cells = ", ".join(f"{r6(f'CASE WHEN i >= {n - 1} THEN {v} END')} AS {k}" for k, v in out.items())
    by = "PARTITION BY symbol ORDER BY bar_index"
    SQL[f"ta_gaps_{name}"] = f"""WITH g AS MATERIALIZED (SELECT symbol, bar_index, volume, CASE WHEN bar_index % 7 <> 3 THEN close END AS close, CASE WHEN bar_index % 7 <> 3 THEN high END AS high, CASE WHEN bar_index % 7 <> 3 THEN low END AS low FROM {sql_bars()}),
c AS MATERIALIZED (SELECT *, close - lag(close) OVER ({by}) AS s FROM g),
b AS MATERIALIZED (SELECT *, row_number() OVER ({by}) - 1 AS i FROM c WHERE {kept}){pre},
v AS (SELECT symbol, bar_index, {cells} FROM {"l" if pre else "b"} WINDOW f AS ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))
SELECT g.symbol, g.bar_index, {", ".join(f"v.{k}" for k in out)} FROM g LEFT JOIN v ON v.symbol = g.symbol AND v.bar_index = g.bar_index"""


def _gap_run(make, spark, sf_dir: str) -> DataFrame:
    bars = _gaps(event_bars(spark, sf_dir))
    made = make(bars)
    if not isinstance(made, DataFrame):
        made = bars.withColumn("value", made)
    return tidy(made, *[c for c in made.columns if c not in bars.columns and not c.startswith("_")])


_far = ", l0 AS (SELECT *, list(close) OVER f AS x, avg(close) OVER f AS m FROM b WINDOW f AS (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)), l AS MATERIALIZED (SELECT *, list_avg(list_transform(x, lambda v: abs(v - m))) AS d FROM l0)"
gap("stdev", lambda b: ta.stdev(P.C, N), "stddev_pop(close) OVER f")
gap("bb", lambda b: b.withColumn("_b", ta.bb(P.C, N, 2.0)).select("*", "_b.*"), {"middle": "avg(close) OVER f", "upper": "avg(close) OVER f + 2 * stddev_pop(close) OVER f", "lower": "avg(close) OVER f - 2 * stddev_pop(close) OVER f"})
gap("bbw", lambda b: ta.bbw(P.C, N, 2.0), "100 * 4 * stddev_pop(close) OVER f / avg(close) OVER f")
gap("cci", lambda b: ta.cci(P.C, N), "CASE WHEN d = 0 THEN 0 ELSE (close - m) / (0.015 * d) END", _far)
gap("cmo", lambda b: b.withColumn("_s", ta.change(P.C)).withColumn("value", ta.cmo(F.col("_s"), N)), "coalesce(100 * sum(s) OVER f / nullif(sum(abs(s)) OVER f, 0), 0)", kept="s IS NOT NULL")
gap("stoch", lambda b: ta.stoch(P.C, P.H, P.L, N), "100 * (close - min(low) OVER f) / nullif(max(high) OVER f - min(low) OVER f, 0)")
gap("wpr", lambda b: ta.wpr(N), "coalesce(-100 * (max(high) OVER f - close) / nullif(max(high) OVER f - min(low) OVER f, 0), 0)")
gap("mfi", lambda b: b.withColumn("_s", ta.change(P.C)).withColumn("value", ta.mfi(P.C, F.col("_s"), N, P.V)), f"CASE WHEN {_down} = 0 THEN 100 WHEN {_up} = 0 THEN 0 ELSE 100 - 100 / (1 + {_up} / {_down}) END")
Q["ta_gaps_percentrank"] = lambda spark, sf_dir: _gap_run(lambda b: ta.percentrank(P.C, N), spark, sf_dir)
SQL["ta_gaps_percentrank"] = f"""WITH g AS MATERIALIZED (SELECT symbol, bar_index, CASE WHEN bar_index % 7 <> 3 THEN close END AS close FROM {sql_bars()})
SELECT symbol, bar_index, {r6(f"CASE WHEN bar_index >= {N} AND close IS NOT NULL THEN 100.0 * len(list_filter(x, lambda v: v <= close)) / len(list_filter(x, lambda v: v IS NOT NULL)) END")} AS value
FROM (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING) AS x FROM g)"""
