"""Queries for bars, resampling, joins across timeframes and the scalar libraries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import maps as M
from ..functions import mathlib as X
from ..functions import matrices as Z
from ..functions import params as I
from ..functions import strings as S
from ..functions import times as T
from ..operators import resample as R
from . import bars as B

Q: dict = {}
SQL: dict[str, str] = {}
BAR = ("symbol", "time", "bar_index", "open", "high", "low", "close", "volume")


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(f"`{c}`", digits) + F.lit(0.0)).alias(c) if t == "double" else F.transform(f"`{c}`", lambda x: F.round(x, 6) + F.lit(0.0)).alias(c) if t == "array<double>" else F.transform(f"`{c}`", lambda r: F.transform(r, lambda x: F.round(x, 6) + F.lit(0.0))).alias(c) if t == "array<array<double>>" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, make, sql: str | None = None) -> None:
    Q[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


# --- bars ---

_cells = ", ".join(f"{r6(c)} AS {c}" for c in BAR[3:])
for _kind, _make, _bucket in (("events", B.event_bars, "hour"), ("line", B.line_bars, "day"), ("orders", B.order_bars, "day")):
    Q[f"bars_{_kind}"] = lambda s, d, f=_make: rounded(f(s, d).select(*BAR), 9)  # prices by the piece end on a half of the sixth place
    SQL[f"bars_{_kind}"] = f"SELECT symbol, time, bar_index, {', '.join(f'round(CAST({c} AS DOUBLE), 9) + 0.0 AS {c}' for c in BAR[3:])} FROM {B.sql_bars(_kind, _bucket)}"

_HOURLY = B.sql_bars()


def _resampled(bucket: str, source: str = "b") -> str:
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS INTEGER) AS bar_index FROM (SELECT symbol, {bucket} AS time, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close, sum(volume) AS volume FROM {source} GROUP BY 1, 2))"


for _name, _frame, _expr in (("4h", "240", "time_bucket(INTERVAL 4 HOUR, time)"), ("day", "D", "CAST(date_trunc('day', time) AS TIMESTAMP)"), ("week", "W", "CAST(date_trunc('week', time) AS TIMESTAMP)"), ("month", "M", "CAST(date_trunc('month', time) AS TIMESTAMP)")):
    query(f"bars_resample_{_name}", lambda s, d, f=_frame: R.by_calendar(B.event_bars(s, d), f).select(*BAR), f"WITH b AS (SELECT * FROM {_HOURLY}) SELECT symbol, time, bar_index, {_cells} FROM {_resampled(_expr)}")
_ratio = f"""WITH b AS (SELECT * FROM {_HOURLY}),
s AS (SELECT *, row_number() OVER w AS n, epoch(time) - epoch(lag(time) OVER w) AS step FROM b WINDOW w AS (PARTITION BY symbol ORDER BY time)),
l AS (SELECT *, coalesce(CAST(step > 1.5 * min(CASE WHEN n <= 20 THEN step END) OVER (PARTITION BY symbol) AS INTEGER), 0) AS brk FROM s),
i AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY time) AS island FROM l),
g AS (SELECT *, floor((row_number() OVER (PARTITION BY symbol, island ORDER BY time) - 1) / 3) AS grp FROM i),
m AS (SELECT symbol, min(time) AS time, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close, sum(volume) AS volume FROM g GROUP BY symbol, island, grp)
SELECT symbol, time, CAST(row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS INTEGER) AS bar_index, {_cells} FROM m"""
query("bars_resample_ratio", lambda s, d: R.by_ratio(B.event_bars(s, d), 3).select(*BAR), _ratio)
query("bars_gaps", lambda s, d: R.gaps(B.event_bars(s, d), 3600), f"SELECT symbol, time, next_time FROM (SELECT symbol, time, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS next_time FROM {_HOURLY}) WHERE epoch(next_time) - epoch(time) > 5400")
query("bars_tail", lambda s, d: R.tail(B.event_bars(s, d), 10).select(*BAR), f"SELECT symbol, time, bar_index, {_cells} FROM {_HOURLY} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 10")
query("bars_last_per_time", lambda s, d: R.last_per_time(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"), "event_id", "value"), F.col("event_id")), "SELECT event_type AS symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, event_id, round(value, 6) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY 1, 2 ORDER BY event_id DESC) = 1".replace("PARTITION BY 1, 2", "PARTITION BY event_type, date_trunc('day', ts)"))
query("bars_tick_coalesce", lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("symbol"), F.window(F.col("ts").cast("timestamp"), "10 minutes")["start"].cast("timestamp_ntz").alias("time")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"), F.count("*").alias("n")), "SELECT event_type AS symbol, time_bucket(INTERVAL 10 MINUTE, ts) AS time, round(last(value ORDER BY ts, event_id), 6) + 0.0 AS price, count(*) AS n FROM events GROUP BY 1, 2")
query("bars_builtin_series", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", ((F.col("high") + F.col("low")) / 2).alias("hl2"), ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("hlc3"), ((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4).alias("ohlc4"), ((F.col("high") + F.col("low") + 2 * F.col("close")) / 4).alias("hlcc4"), T.close_time("60").alias("close_time")), f"SELECT symbol, bar_index, {r6('(high + low) / 2')} AS hl2, {r6('(high + low + close) / 3')} AS hlc3, {r6('(open + high + low + close) / 4')} AS ohlc4, {r6('(high + low + 2 * close) / 4')} AS hlcc4, coalesce(lead(time) OVER (PARTITION BY symbol ORDER BY bar_index), time + INTERVAL 1 HOUR) AS close_time FROM {_HOURLY}")

# --- across timeframes ---

_sec = f"""WITH b AS (SELECT *, CAST(date_trunc('day', time) AS TIMESTAMP) AS day FROM {_HOURLY}),
h AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_index) AS before FROM {_resampled("CAST(date_trunc('day', time) AS TIMESTAMP)")}),
j AS (SELECT b.symbol, b.bar_index, b.day, h.bar_index AS i, h.close AS cur, h.before, coalesce(lead(b.day) OVER (PARTITION BY b.symbol ORDER BY b.bar_index) <> b.day, true) AS ends FROM b LEFT JOIN h ON h.symbol = b.symbol AND h.time = b.day),
k AS (SELECT *, CASE WHEN ends THEN cur ELSE before END AS confirmed, CASE WHEN ends THEN i ELSE i - 1 END AS place FROM j)
"""
for _name, _look, _gaps, _v in (("confirmed", False, False, "confirmed"), ("lookahead", True, False, "cur"), ("gaps", False, True, "CASE WHEN place <> lag(place) OVER (PARTITION BY symbol ORDER BY bar_index) THEN confirmed END")):
    query(f"join_asof_{_name}", lambda s, d, a=_look, g=_gaps: R.security(B.event_bars(s, d), "D", F.col("close"), "value", a, g).select("symbol", "bar_index", "value"), _sec + f"SELECT symbol, bar_index, {r6(_v)} AS value FROM k")
query("join_lower_tf", lambda s, d: R.lower(R.by_calendar(B.event_bars(s, d), "D"), "D", B.event_bars(s, d), F.col("close")).select("symbol", "bar_index", "values"), f"WITH b AS (SELECT * FROM {_HOURLY}) SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS INTEGER) AS bar_index, x AS values FROM (SELECT symbol, date_trunc('day', time) AS day, list(round(close, 6) + 0.0 ORDER BY time) AS x FROM b GROUP BY 1, 2)")
query("join_asof_ticks", lambda s, d: R.as_of(B.event_bars(s, d, "day").select("symbol", "time", "bar_index"), B.event_bars(s, d).where("close > 60").select("symbol", "time", F.col("close").alias("value")), "value"), f"SELECT l.symbol, l.time, l.bar_index, {r6('r.close')} AS value FROM {B.sql_bars('events', 'day')} l ASOF LEFT JOIN (SELECT * FROM {_HOURLY} WHERE close > 60) r ON l.symbol = r.symbol AND l.time >= r.time")

# --- na, state, metadata ---

_w = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_index), c AS (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _na(s, d) -> DataFrame:
    from ..operators import ta

    b = B.event_bars(s, d).withColumn("x", F.when(F.col("close") > 50, F.col("close")))
    return b.select("symbol", "bar_index", F.col("x").isNull().alias("na"), ta.nz(F.col("x")).alias("nz"), ta.fixnan(F.col("x")).alias("fixnan"), ta.lag(F.col("close"), 3).alias("history"), (F.col("bar_index") == 0).alias("isfirst"), (F.col("bar_index") == F.max("bar_index").over(ta.Window.partitionBy("symbol"))).alias("islast"))


query("core_na_and_history", _na, f"SELECT symbol, bar_index, x IS NULL AS na, {r6('coalesce(x, 0)')} AS nz, {r6('last_value(x IGNORE NULLS) OVER c')} AS fixnan, {r6('lag(close, 3) OVER w')} AS history, bar_index = 0 AS isfirst, bar_index = max(bar_index) OVER (PARTITION BY symbol) AS islast FROM (SELECT *, CASE WHEN close > 50 THEN close END AS x FROM {_HOURLY}) {_w}")

# --- math ---

_math: dict[str, tuple] = {
    "abs": (lambda x, y: X.abs_(x - 50), "abs(close - 50)"), "acos": (lambda x, y: X.acos(x / 1000), "acos(close / 1000)"), "asin": (lambda x, y: X.asin(x / 1000), "asin(close / 1000)"), "atan": (lambda x, y: X.atan(x), "atan(close)"),
    "avg": (lambda x, y: X.avg(x, y, x * y), "(close + open + close * open) / 3"), "ceil": (lambda x, y: X.ceil(x).cast("double"), "ceil(close)"), "cos": (lambda x, y: X.cos(x), "cos(close)"), "exp": (lambda x, y: X.exp(x / 100), "exp(close / 100)"),
    "floor": (lambda x, y: X.floor(x).cast("double"), "floor(close)"), "ln": (lambda x, y: X.ln(x + 1), "ln(close + 1)"), "log": (lambda x, y: X.log(x + 1), "ln(close + 1)"), "log10": (lambda x, y: X.log10(x + 1), "log10(close + 1)"), "max": (lambda x, y: X.max_(x, y), "greatest(close, open)"),
    "min": (lambda x, y: X.min_(x, y), "least(close, open)"), "pow": (lambda x, y: X.pow_(x, F.lit(1.5)), "pow(close, 1.5)"), "round": (lambda x, y: X.round_(x / 7, 2), "round(close / 7, 2)"), "round_to_mintick": (lambda x, y: X.round_to_mintick(x, 0.25), "round(close / 0.25) * 0.25"),
    "sign": (lambda x, y: X.sign(x - y), "sign(close - open)"), "sin": (lambda x, y: X.sin(x), "sin(close)"), "sqrt": (lambda x, y: X.sqrt(x), "sqrt(close)"), "tan": (lambda x, y: X.tan(x / 1000), "tan(close / 1000)"), "todegrees": (lambda x, y: X.todegrees(x), "degrees(close)"),
    "toradians": (lambda x, y: X.toradians(x), "radians(close)"), "e": (lambda x, y: X.e(), "exp(1)"), "pi": (lambda x, y: X.pi(), "pi()"), "phi": (lambda x, y: X.phi(), "(1 + sqrt(5)) / 2"), "rphi": (lambda x, y: X.rphi(), "2 / (1 + sqrt(5))"),
    "sum": (lambda x, y: X.sum_(x, 5), "CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN sum(close) OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END"),
    "idiv": (lambda x, y: X.idiv(x - 50, F.lit(7)).cast("double"), "trunc((close - 50) / 7)"),
}
for _name, (_f, _s) in _math.items():
    query(f"math_{_name}", lambda s, d, f=_f: B.event_bars(s, d).select("symbol", "bar_index", f(F.col("close"), F.col("open")).alias("value")), f"SELECT symbol, bar_index, {r6(_s)} AS value FROM {_HOURLY}")
query("math_random", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", ((X.random() >= 0) & (X.random() < 1)).alias("value")), f"SELECT symbol, bar_index, true AS value FROM {_HOURLY}")
query("math_compare", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", *[f(F.col("close"), F.col("open") + F.lit(1e-11)).alias(n) for n, f in (("eq", X.eq), ("neq", X.neq), ("lt", X.lt), ("le", X.le), ("gt", X.gt), ("ge", X.ge))]), f"SELECT symbol, bar_index, abs(close - o) < 1e-10 AS eq, abs(close - o) >= 1e-10 AS neq, o - close >= 1e-10 AS lt, close - o < 1e-10 AS le, close - o >= 1e-10 AS gt, o - close < 1e-10 AS ge FROM (SELECT *, open + 1e-11 AS o FROM {_HOURLY})")

# --- arrays: the first twelve components of each vector, to whole hundreds so that ties occur ---


def _vectors(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and embedding is not null")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: F.floor(x.cast("double") * 20).cast("double"))
    return e.select("vec_id", part(1, 12).alias("a"), part(13, 12).alias("b"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, F.lit(3)), lambda x: F.floor(x.cast("double") * 20).cast("double"))).alias("m"), F.transform(F.sequence(F.lit(3), F.lit(5)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, F.lit(3)), lambda x: F.floor(x.cast("double") * 20).cast("double"))).alias("k"))


_cut = "list_transform(embedding[{}:{}], lambda x: floor(CAST(x AS DOUBLE) * 20))"
_V = "(SELECT vec_id, {} AS a, {} AS b, [{}, {}, {}] AS m, [{}, {}, {}] AS k FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)".format(_cut.format(1, 12), _cut.format(13, 24), *[_cut.format(3 * i + 1, 3 * i + 3) for i in range(6)])
_var = "(list_sum(list_transform(a, lambda v: (v - list_avg(a)) * (v - list_avg(a)))) / 12)"
_arrays: dict[str, tuple] = {
    "abs": (lambda a, b: A.abs_(a), "list_transform(a, lambda x: abs(x) + 0.0)"), "avg": (lambda a, b: A.avg(a), "list_avg(a)"), "sum": (lambda a, b: A.sum_(a), "list_sum(a)"), "max": (lambda a, b: A.max_(a, 1), "list_reverse_sort(a)[2]"), "min": (lambda a, b: A.min_(a), "list_min(a)"),
    "range": (lambda a, b: A.range_(a), "list_max(a) - list_min(a)"), "median": (lambda a, b: A.median(a), "list_median(a)"), "variance": (lambda a, b: A.variance(a), "list_var_pop(a)"), "stdev": (lambda a, b: A.stdev(a, False), "list_stddev_samp(a)"),
    "mode": (lambda a, b: A.mode(a), "list_min(list_filter(a, lambda x: len(list_filter(a, lambda y: y = x)) = list_max(list_transform(a, lambda z: len(list_filter(a, lambda q: q = z))))))"),
    "covariance": (lambda a, b: A.covariance(a, b), "list_avg(list_transform(range(1, 13), lambda i: a[i] * b[i])) - list_avg(a) * list_avg(b)"), "standardize": (lambda a, b: A.standardize(a), "list_transform(a, lambda x: CASE WHEN list_stddev_pop(a) = 0 THEN 1.0 ELSE (x - list_avg(a)) / list_stddev_pop(a) END)"),
    "percentile_linear_interpolation": (lambda a, b: A.percentile_linear_interpolation(a, 30), "list_sort(a)[4] + (list_sort(a)[5] - list_sort(a)[4]) * 0.1"), "percentile_nearest_rank": (lambda a, b: A.percentile_nearest_rank(a, 30), "list_sort(a)[4]"), "percentrank": (lambda a, b: A.percentrank(a, 2), "100.0 * len(list_filter(a, lambda x: x < a[3])) / 11"),
    "get": (lambda a, b: A.get(a, -2), "a[11]"), "set": (lambda a, b: A.set_(a, 3, F.lit(9.0)), "list_concat(a[1:3], [9.0], a[5:12])"), "first": (lambda a, b: A.first(a), "a[1]"), "last": (lambda a, b: A.last(a), "a[12]"), "push": (lambda a, b: A.push(a, F.lit(7.0)), "list_append(a, 7.0)"), "unshift": (lambda a, b: A.unshift(a, F.lit(7.0)), "list_prepend(7.0, a)"),
    "pop": (lambda a, b: A.pop(a), "a[1:11]"), "shift": (lambda a, b: A.shift(a), "a[2:12]"), "insert": (lambda a, b: A.insert(a, 2, F.lit(5.0)), "list_concat(a[1:2], [5.0], a[3:12])"), "remove": (lambda a, b: A.remove(a, 4), "list_concat(a[1:4], a[6:12])"), "slice": (lambda a, b: A.slice_(a, 2, 6), "a[3:6]"), "fill": (lambda a, b: A.fill(a, F.lit(1.0), 2, 4), "list_concat(a[1:2], [1.0, 1.0], a[5:12])"),
    "concat": (lambda a, b: A.concat(a, b), "list_concat(a, b)"), "reverse": (lambda a, b: A.reverse(a), "list_reverse(a)"), "copy": (lambda a, b: A.copy(a), "a"), "size": (lambda a, b: A.size(a), "CAST(len(a) AS INTEGER)"), "join": (lambda a, b: A.join(F.transform(a, lambda x: x.cast("int").cast("string")), ", "), "array_to_string(list_transform(a, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ', ')"),
    "includes": (lambda a, b: A.includes(a, F.lit(1.0)), "list_contains(a, 1.0)"), "indexof": (lambda a, b: A.indexof(a, F.lit(1.0)).cast("int"), "CAST(coalesce(list_position(a, 1.0), 0) - 1 AS INTEGER)"), "lastindexof": (lambda a, b: A.lastindexof(a, F.lit(1.0)).cast("int"), "CAST(CASE WHEN list_contains(a, 1.0) THEN 12 - list_position(list_reverse(a), 1.0) ELSE -1 END AS INTEGER)"),
    "every": (lambda a, b: A.every(a), "len(list_filter(a, lambda x: x = 0)) = 0"), "some": (lambda a, b: A.some(a), "len(list_filter(a, lambda x: x <> 0)) > 0"), "sort": (lambda a, b: A.sort(a, False), "list_reverse_sort(a)"), "sort_indices": (lambda a, b: A.sort_indices(a), "list_transform(list_sort(list_transform(range(1, 13), lambda i: {'x': a[i], 'i': i})), lambda s: CAST(s.i - 1 AS INTEGER))"),
    "binary_search": (lambda a, b: A.binary_search(F.sort_array(F.array_distinct(a)), F.lit(1.0)), "CAST(coalesce(list_position(list_sort(list_distinct(a)), 1.0), 0) - 1 AS INTEGER)"), "binary_search_leftmost": (lambda a, b: A.binary_search_leftmost(F.sort_array(a), F.lit(1.0)).cast("int"), "CAST(len(list_filter(a, lambda x: x < 1)) - CASE WHEN list_contains(a, 1.0) THEN 0 ELSE 1 END AS INTEGER)"), "binary_search_rightmost": (lambda a, b: A.binary_search_rightmost(F.sort_array(a), F.lit(1.0)).cast("int"), "CAST(len(list_filter(a, lambda x: x <= 1)) - CASE WHEN list_contains(a, 1.0) THEN 1 ELSE 0 END AS INTEGER)"),
    "new": (lambda a, b: A.new(3, A.first(a)), "[a[1], a[1], a[1]]"), "from": (lambda a, b: A.from_(A.first(a), A.last(a)), "[a[1], a[12]]"), "clear": (lambda a, b: A.size(A.clear(a)), "0"),
    "new_typed": (lambda a, b: F.concat_ws(",", A.size(A.new_float(2)).cast("string"), A.new_int(2).cast("string"), A.new_bool(1).cast("string"), A.size(A.new_string(3)).cast("string")), "'2,[0, 0],[false],3'"),
}
_lists = {"abs", "standardize", "set", "push", "unshift", "pop", "shift", "insert", "remove", "slice", "fill", "concat", "reverse", "copy", "sort", "new", "from"}
_plain = {"size", "join", "includes", "indexof", "lastindexof", "every", "some", "sort_indices", "binary_search", "binary_search_leftmost", "binary_search_rightmost", "clear", "new_typed"}
for _name, (_f, _s) in _arrays.items():
    _out = f"list_transform({_s}, lambda x: round(CAST(x AS DOUBLE), 6) + 0.0)" if _name in _lists else _s if _name in _plain else r6(_s)
    query(f"array_{_name}", lambda s, d, f=_f: _vectors(s, d).select("vec_id", f(F.col("a"), F.col("b")).alias("value")), f"SELECT vec_id, {_out} AS value FROM {_V}")

# --- matrices: 3 x 3 ---

_T = "[[m[1][1], m[2][1], m[3][1]], [m[1][2], m[2][2], m[3][2]], [m[1][3], m[2][3], m[3][3]]]"
_det = "(m[1][1] * (m[2][2] * m[3][3] - m[2][3] * m[3][2]) - m[1][2] * (m[2][1] * m[3][3] - m[2][3] * m[3][1]) + m[1][3] * (m[2][1] * m[3][2] - m[2][2] * m[3][1]))"
_each = "list_transform(range(1, 4), lambda i: list_transform(range(1, 4), lambda j: {}))".format
_flat = "flatten(m)"
_cell = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]


def _all(test: str, of=lambda i, j: True) -> str:
    """Whether test holds in all cells for which of does."""
    return "(" + " AND ".join(test.format(i=i, j=j) for i, j in _cell if of(i, j)) + ")"


_is = [
    "true", _all("m[{i}][{j}] = 0"), _all("m[{i}][{j}] = CASE WHEN {i} = {j} THEN 1 ELSE 0 END"), _all("m[{i}][{j}] = 0", lambda i, j: i != j), _all("m[{i}][{j}] = 0", lambda i, j: i + j != 4),
    _all("m[{i}][{j}] = m[{j}][{i}]"), _all("m[{i}][{j}] = -m[{j}][{i}]"), "(" + _all("m[{i}][{j}] = 0", lambda i, j: i > j) + " OR " + _all("m[{i}][{j}] = 0", lambda i, j: i < j) + ")",
    _all("m[{i}][{j}] IN (0, 1)"), "(" + _all("m[{i}][{j}] >= 0") + " AND " + _all("abs(m[{i}][1] + m[{i}][2] + m[{i}][3] - 1) <= 1e-10", lambda i, j: j == 1) + ")",
]
_tests = "concat_ws(',', " + ", ".join(f"CAST({t} AS INTEGER)" for t in _is) + ", '1,0,1,1,0,1,0,1,1,1')"
_matrix: dict[str, tuple] = {
    "new": (lambda m, k: Z.new(2, 2, Z.get(m, 0, 0)), "[[m[1][1], m[1][1]], [m[1][1], m[1][1]]]"), "get": (lambda m, k: Z.get(m, 1, 2), "m[2][3]"), "set": (lambda m, k: Z.set_(m, 1, 2, F.lit(8.0)), "[m[1], [m[2][1], m[2][2], 8.0], m[3]]"), "rows": (lambda m, k: Z.rows(m), "3"), "columns": (lambda m, k: Z.columns(m), "3"), "elements_count": (lambda m, k: Z.elements_count(m), "9"),
    "row": (lambda m, k: Z.row(m, 1), "m[2]"), "col": (lambda m, k: Z.col(m, 1), "[m[1][2], m[2][2], m[3][2]]"), "add_row": (lambda m, k: Z.add_row(m, 1, Z.row(k, 0)), "[m[1], k[1], m[2], m[3]]"), "add_col": (lambda m, k: Z.add_col(m, 1, Z.row(k, 0)), "list_transform(range(1, 4), lambda i: [m[i][1], k[1][i], m[i][2], m[i][3]])"), "remove_row": (lambda m, k: Z.remove_row(m, 0), "[m[2], m[3]]"), "remove_col": (lambda m, k: Z.remove_col(m, 0), "list_transform(m, lambda r: r[2:3])"),
    "swap_rows": (lambda m, k: Z.swap_rows(m, 0, 2), "[m[3], m[2], m[1]]"), "swap_columns": (lambda m, k: Z.swap_columns(m, 0, 2), "list_transform(m, lambda r: [r[3], r[2], r[1]])"), "submatrix": (lambda m, k: Z.submatrix(m, 0, 2, 1, 3), "[m[1][2:3], m[2][2:3]]"), "concat": (lambda m, k: Z.concat(m, k), "list_concat(m, k)"), "copy": (lambda m, k: Z.copy(m), "m"), "fill": (lambda m, k: Z.fill(m, F.lit(1.0), 0, 1, 0, 2), "[[1.0, 1.0, m[1][3]], m[2], m[3]]"),
    "reshape": (lambda m, k: Z.reshape(m, 1, 9), f"[{_flat}]"), "reverse": (lambda m, k: Z.reverse(m), "[list_reverse(m[3]), list_reverse(m[2]), list_reverse(m[1])]"), "sort": (lambda m, k: Z.sort(m, 1), "list_transform(list_sort(list_transform(range(1, 4), lambda i: {'k': m[i][2], 'i': i})), lambda s: m[s.i])"), "transpose": (lambda m, k: Z.transpose(m), _T), "sum": (lambda m, k: Z.sum_(m, k), _each("m[i][j] + k[i][j]")), "diff": (lambda m, k: Z.diff(m, k), _each("m[i][j] - k[i][j]")),
    "mult": (lambda m, k: Z.mult(m, k), _each("m[i][1] * k[1][j] + m[i][2] * k[2][j] + m[i][3] * k[3][j]")), "mult_vector": (lambda m, k: Z.mult_vector(m, Z.row(k, 0)), "list_transform(m, lambda r: r[1] * k[1][1] + r[2] * k[1][2] + r[3] * k[1][3])"), "kron": (lambda m, k: Z.kron(m, k), "list_transform(range(0, 9), lambda i: list_transform(range(0, 9), lambda j: m[i // 3 + 1][j // 3 + 1] * k[i % 3 + 1][j % 3 + 1]))"), "pow": (lambda m, k: Z.pow_(m, 2), _each("m[i][1] * m[1][j] + m[i][2] * m[2][j] + m[i][3] * m[3][j]")),
    "avg": (lambda m, k: Z.avg(m), f"list_avg({_flat})"), "max": (lambda m, k: Z.max_(m), f"list_max({_flat})"), "min": (lambda m, k: Z.min_(m), f"list_min({_flat})"), "median": (lambda m, k: Z.median(m), f"list_median({_flat})"), "mode": (lambda m, k: Z.mode(m), "list_min(list_filter(flatten(m), lambda x: len(list_filter(flatten(m), lambda y: y = x)) = list_max(list_transform(flatten(m), lambda z: len(list_filter(flatten(m), lambda q: q = z))))))"), "trace": (lambda m, k: Z.trace(m), "m[1][1] + m[2][2] + m[3][3]"), "det": (lambda m, k: Z.det(m), _det),
    "rank": (lambda m, k: Z.rank(Z.submatrix(m, 0, 2, 0, 2)), "CASE WHEN abs(m[1][1] * m[2][2] - m[1][2] * m[2][1]) > 0 THEN 2 WHEN list_max(list_transform([m[1][1], m[1][2], m[2][1], m[2][2]], lambda x: abs(x))) > 0 THEN 1 ELSE 0 END"),
    "eigenvalues": (lambda m, k: Z.eigenvalues(Z.submatrix(m, 0, 2, 0, 2)), "CASE WHEN ((m[1][1] - m[2][2]) / 2) ** 2 + m[1][2] * m[2][1] >= 0 THEN [(m[1][1] + m[2][2]) / 2 + sqrt(((m[1][1] - m[2][2]) / 2) ** 2 + m[1][2] * m[2][1]), (m[1][1] + m[2][2]) / 2 - sqrt(((m[1][1] - m[2][2]) / 2) ** 2 + m[1][2] * m[2][1])] END"),
    "tests": (lambda m, k: F.concat_ws(",", *[f(x).cast("int").cast("string") for x in (m, _identity()) for f in (Z.is_square, Z.is_zero, Z.is_identity, Z.is_diagonal, Z.is_antidiagonal, Z.is_symmetric, Z.is_antisymmetric, Z.is_triangular, Z.is_binary, Z.is_stochastic)]), _tests),
}


def _big() -> Column:
    return F.array(*[F.array(*[F.lit(100.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])


def _identity() -> Column:
    return F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])


_scalar, _vector = {"get", "avg", "max", "min", "median", "mode", "trace", "det"}, {"row", "col", "mult_vector", "eigenvalues"}
for _name, (_f, _s) in _matrix.items():
    if _s is not None:
        _s = r6(_s) if _name in _scalar else f"list_transform({_s}, lambda x: round(CAST(x AS DOUBLE), 6) + 0.0)" if _name in _vector else _s if _name in {"rows", "columns", "elements_count", "rank", "tests"} else f"list_transform({_s}, lambda r: list_transform(r, lambda x: round(CAST(x AS DOUBLE), 6) + 0.0))"
    query(f"matrix_{_name}", lambda s, d, f=_f: _vectors(s, d).select("vec_id", f(F.col("m"), F.col("k")).alias("value")), f"SELECT vec_id, {_s} AS value FROM {_V}" if _s is not None else None)

for _name, _f in (("inv", Z.inv), ("pinv", Z.pinv)):  # a function of Python's stands outside lambdas: the product comes in a second step
    query(f"matrix_{_name}_times", lambda s, d, f=_f: _vectors(s, d).select("vec_id", Z.sum_(F.col("m"), _big()).alias("g")).withColumn("i", f(F.col("g"))).select("vec_id", Z.mult(F.col("i"), F.col("g")).alias("value")), f"SELECT vec_id, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]] AS value FROM {_V}")
query("matrix_eigenvectors", lambda s, d: _vectors(s, d).select("vec_id", Z.eigenvectors(F.col("m")).alias("value")))  # signs are free: tests hold A v = l v

# --- maps: word lengths of nations by name ---


def _regions(spark, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pairs = F.sort_array(F.collect_list(F.struct("n_name", F.length("n_name").cast("double").alias("v"))))
    return n.groupBy("n_regionkey").agg(F.map_from_entries(pairs).alias("m"))


_R = "(SELECT n_regionkey, list(n_name ORDER BY n_name) AS ks, list(CAST(length(n_name) AS DOUBLE) ORDER BY n_name) AS vs FROM nation GROUP BY 1)"
_maps: dict[str, tuple] = {
    "size": (lambda m: M.size(m), "CAST(len(ks) AS INTEGER)"), "keys": (lambda m: M.keys(m), "ks"), "values": (lambda m: M.values(m), "vs"), "contains": (lambda m: M.contains(m, "CHINA"), "list_contains(ks, 'CHINA')"), "get": (lambda m: M.get(m, F.element_at(M.keys(m), 1)), "vs[1]"), "clear": (lambda m: M.size(M.clear(m)), "0"),
    "new": (lambda m: M.size(M.new()), "0"), "copy": (lambda m: M.keys(M.copy(m)), "ks"), "put": (lambda m: M.values(M.put(m, F.element_at(M.keys(m), 2), F.lit(99.0))), "list_concat(vs[1:1], [99.0], vs[3:])"), "put_all": (lambda m: M.keys(M.put_all(m, F.create_map(F.lit("~"), F.lit(1.0)))), "list_append(ks, '~')"), "remove": (lambda m: M.keys(M.remove(m, F.element_at(M.keys(m), 1))), "ks[2:]"),
}
for _name, (_f, _s) in _maps.items():
    query(f"map_{_name}", lambda s, d, f=_f: _regions(s, d).select("n_regionkey", f(F.col("m")).alias("value")), f"SELECT n_regionkey, {_s} AS value FROM {_R}")

# --- strings, over customers ---

_str: dict[str, tuple] = {
    "lower": (lambda c, x: S.lower(c), "lower(c_name)"), "upper": (lambda c, x: S.upper(c), "upper(c_name)"), "trim": (lambda c, x: S.trim(F.concat(F.lit("  "), c)), "c_name"), "length": (lambda c, x: S.length(c), "CAST(length(c_name) AS INTEGER)"), "repeat": (lambda c, x: S.repeat(c, 2, "-"), "c_name || '-' || c_name"), "replace_all": (lambda c, x: S.replace_all(c, "0", "o"), "replace(c_name, '0', 'o')"),
    "replace": (lambda c, x: S.replace(c, "0", "o", 1), "CASE WHEN len(string_split(c_name, '0')) > 2 THEN array_to_string(string_split(c_name, '0')[1:2], '0') || 'o' || array_to_string(string_split(c_name, '0')[3:], '0') ELSE c_name END"), "contains": (lambda c, x: S.contains(c, "00"), "contains(c_name, '00')"), "startswith": (lambda c, x: S.startswith(c, "Cust"), "starts_with(c_name, 'Cust')"), "endswith": (lambda c, x: S.endswith(c, "7"), "ends_with(c_name, '7')"),
    "pos": (lambda c, x: S.pos(c, "7"), "CAST(nullif(instr(c_name, '7'), 0) - 1 AS INTEGER)"), "substring": (lambda c, x: S.substring(c, 2, 6), "substr(c_name, 3, 4)"), "split": (lambda c, x: S.split(c, "#"), "string_split(c_name, '#')"), "match": (lambda c, x: S.match(c, "[0-9]+"), "regexp_extract(c_name, '[0-9]+')"), "tonumber": (lambda c, x: S.tonumber(S.match(c, "[0-9]+$")), "round(TRY_CAST(regexp_extract(c_name, '[0-9]+$') AS DOUBLE), 6) + 0.0"),
    "tostring": (lambda c, x: F.concat_ws("|", S.tostring(x, "0.00"), S.tostring(x, "integer")), "printf('%.2f|%.0f', round(x, 2), round(x))"), "format": (lambda c, x: S.format_("{0}: {1,number,0.0}", c, x), "c_name || ': ' || printf('%.1f', round(x, 1))"),
}
for _name, (_f, _s) in _str.items():
    query(f"str_{_name}", lambda s, d, f=_f: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", f(F.col("c_name"), F.col("c_custkey") / F.lit(8.0)).alias("value")), f"SELECT c_custkey, {_s} AS value FROM (SELECT *, c_custkey / CAST(8 AS DOUBLE) AS x FROM customer)")

# --- time ---

query("time_parts", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", *[v.alias(k) for k, v in T.parts(F.col("time")).items()]), f"SELECT symbol, bar_index, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, CAST(day(time) AS INTEGER) AS dayofmonth, CAST(dayofweek(time) + 1 AS INTEGER) AS dayofweek, CAST(hour(time) AS INTEGER) AS hour, CAST(minute(time) AS INTEGER) AS minute, CAST(second(time) AS INTEGER) AS second, CAST(weekofyear(time) AS INTEGER) AS weekofyear FROM {_HOURLY}")
query("time_align", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", T.align(F.col("time"), "240").alias("h4"), T.align(F.col("time"), "D").alias("d"), T.align(F.col("time"), "W").alias("w"), T.align(F.col("time"), "M").alias("m")), f"SELECT symbol, bar_index, time_bucket(INTERVAL 4 HOUR, time) AS h4, CAST(date_trunc('day', time) AS TIMESTAMP) AS d, CAST(date_trunc('week', time) AS TIMESTAMP) AS w, CAST(date_trunc('month', time) AS TIMESTAMP) AS m FROM {_HOURLY}")
query("time_change", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", T.change(F.col("time"), "D").alias("value")), f"SELECT symbol, bar_index, coalesce(date_trunc('day', time) <> lag(date_trunc('day', time)) OVER (PARTITION BY symbol ORDER BY bar_index), false) AS value FROM {_HOURLY}")
query("time_session", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", T.in_session(F.col("time"), "0930-1600:23456").alias("day"), T.in_session(F.col("time"), "2200-0400:23456").alias("night")), f"SELECT symbol, bar_index, hour(time) * 60 + minute(time) BETWEEN 570 AND 959 AND dayofweek(time) + 1 IN (2, 3, 4, 5, 6) AS day, (hour(time) >= 22 AND (dayofweek(time) + 1) % 7 + 1 IN (2, 3, 4, 5, 6)) OR (hour(time) < 4 AND dayofweek(time) + 1 IN (2, 3, 4, 5, 6)) AS night FROM {_HOURLY}")
query("time_format", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", S.format_time(F.col("time").cast("timestamp"), "yyyy-MM-dd HH:mm").alias("value")), f"SELECT symbol, bar_index, strftime(time, '%Y-%m-%d %H:%M') AS value FROM {_HOURLY}")
query("time_first_and_last_of_day", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", T.first_of_session(F.col("time")).alias("isfirst"), T.last_of_session(F.col("time")).alias("islast")), f"SELECT symbol, bar_index, coalesce(CAST(time AS DATE) <> lag(CAST(time AS DATE)) OVER (PARTITION BY symbol ORDER BY bar_index), true) AS isfirst, coalesce(CAST(time AS DATE) <> lead(CAST(time AS DATE)) OVER (PARTITION BY symbol ORDER BY bar_index), true) AS islast FROM {_HOURLY}")
query("color_from_gradient", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", I.from_gradient(F.col("close"), 10.0, 60.0, "#102030", "#F0E0D0").alias("value")), f"SELECT symbol, bar_index, printf('#%02X%02X%02X', CAST(round(16 + 224 * x) AS INTEGER), CAST(round(32 + 192 * x) AS INTEGER), CAST(round(48 + 160 * x) AS INTEGER)) AS value FROM (SELECT *, least(greatest((close - 10) / 50.0, 0.0), 1.0) AS x FROM {_HOURLY})")
query("input_source", lambda s, d: B.event_bars(s, d).select("symbol", "bar_index", I.Inputs({"src": "hlc3"}).source("src").alias("value")), f"SELECT symbol, bar_index, {r6('(high + low + close) / 3')} AS value FROM {_HOURLY}")
query("join_other_symbol", lambda s, d: R.other_symbol(B.event_bars(s, d), "click", F.col("close"), "value").select("symbol", "bar_index", "value"), f"SELECT b.symbol, b.bar_index, {r6('o.close')} AS value FROM {_HOURLY} b LEFT JOIN (SELECT time, close FROM {_HOURLY} WHERE symbol = 'click') o USING (time)")
query("join_first_in_lower_tf", lambda s, d: R.security_lower(R.by_calendar(B.event_bars(s, d), "D"), "D", B.event_bars(s, d), F.col("close")).select("symbol", "bar_index", "last", "first"), f"WITH b AS (SELECT * FROM {_HOURLY}) SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS INTEGER) AS bar_index, round(l, 6) + 0.0 AS last, round(f, 6) + 0.0 AS first FROM (SELECT symbol, date_trunc('day', time) AS day, last(close ORDER BY time) AS l, first(close ORDER BY time) AS f FROM b GROUP BY 1, 2)")
