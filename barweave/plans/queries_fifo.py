"""Queries that pair fills first in, first out, and what trades add up to; fills are order lines, bought and sold in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import account, broker, fifo
from . import bars as B

Q: dict = {}
SQL: dict[str, str] = {}
ORDER = ("time", "l_orderkey", "l_linenumber", "amount", "l_quantity")
#: So many digits that no amount lies half-way between two roundings; prices end within eight.
RATE = 0.00031415926535


def fills(spark, sf_dir: str) -> DataFrame:
    """Each order line as a fill of its flag and status: bought if order and line number add up to an even number, else sold; RATE of the amount as commission."""
    side = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, 1).otherwise(-1)
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"), (F.col("l_quantity") * side).alias("qty"), price.alias("price"), (F.col("l_extendedprice") * RATE).alias("commission"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("amount"), "l_quantity")


def _matched(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fifo.match(fills(spark, sf_dir), F.date_trunc("month", "time"), ORDER)


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(c, 8 if c.endswith("price") else digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _named(trades: DataFrame) -> DataFrame:
    """Trades as merged_fills reads them."""
    side = F.when(F.col("size") > 0, "Long").otherwise("Short")
    return trades.withColumns({"entry_id": side, "exit_id": F.concat(F.lit("Close "), side)})


Q["fifo_trades"] = lambda s, d: _rounded(_matched(s, d)[0])
Q["fifo_open_lots"] = lambda s, d: _rounded(_matched(s, d)[1])
Q["fifo_summary"] = lambda s, d: _rounded(fifo.summary(_matched(s, d)[0]), 3)
Q["fifo_merged_fills"] = lambda s, d: _rounded(broker.merged_fills(_named(_matched(s, d)[0])).drop("price"))
Q["fifo_positions"] = lambda s, d: fifo.running(fills(s, d), ("symbol",), F.date_trunc("month", "time"), ORDER, {"position": F.col("qty").cast(f"decimal(28,{fifo.PLACES})")}, {"price_before": F.col("price")}).select("symbol", "l_orderkey", "l_linenumber", "amount", "l_quantity", F.col("position").cast("double").alias("position"), (F.round("price_before", 8) + F.lit(0.0)).alias("price_before"))

ACCOUNT = broker.Config(initial_capital=1e7, risk_free_rate=2.0)


def _day(time):
    return F.date_trunc("day", time).cast("timestamp_ntz")


def _account(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily bars, trades and the curve of the account."""
    bars, trades = B.line_bars(spark, sf_dir), _matched(spark, sf_dir)[0]
    return bars, trades, account.curve(bars, fills(spark, sf_dir), trades, _day, F.date_trunc("month", "time"), ORDER, ACCOUNT)


def _metrics(spark, sf_dir: str) -> DataFrame:
    bars, trades, equity = _account(spark, sf_dir)
    return broker.metrics(account.placed(trades, bars, _day), equity, ACCOUNT)


Q["account_curve"] = lambda s, d: _rounded(_account(s, d)[2].drop("close"), 2)
Q["account_months"] = lambda s, d: _rounded(account.months(_account(s, d)[2], ACCOUNT), 2)
Q["account_metrics"] = lambda s, d: _rounded(_metrics(s, d), 3)

_FILLS = f"""f AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS time, l_orderkey, l_linenumber, l_extendedprice AS amount, l_quantity, l_extendedprice / nullif(l_quantity, 0) AS price, l_extendedprice * {RATE!r}::DOUBLE / l_quantity AS rate,
  CAST(CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN l_quantity ELSE -l_quantity END AS DECIMAL(28, 8)) AS qty FROM lineitem)"""
_BY = "PARTITION BY symbol ORDER BY time, l_orderkey, l_linenumber, amount, l_quantity"
_TRADES = f"""{_FILLS},
p AS (SELECT *, sum(qty) OVER ({_BY}) - qty AS held FROM f WHERE qty <> 0),
s AS (SELECT *, CASE WHEN sign(held) * sign(qty) < 0 THEN least(abs(held), abs(qty)) ELSE 0 END AS closes FROM p),
e AS (SELECT symbol, sign(qty) AS side, time, price, rate, q, sum(q) OVER (PARTITION BY symbol, sign(qty) ORDER BY time, l_orderkey, l_linenumber, amount, l_quantity) AS hi, row_number() OVER (PARTITION BY symbol, sign(qty) ORDER BY time, l_orderkey, l_linenumber, amount, l_quantity) AS no
  FROM (SELECT *, abs(qty) - closes AS q FROM s) WHERE q > 0),
x AS (SELECT symbol, -sign(qty) AS side, time, price, rate, closes AS q, sum(closes) OVER (PARTITION BY symbol, sign(qty) ORDER BY time, l_orderkey, l_linenumber, amount, l_quantity) AS hi, row_number() OVER (PARTITION BY symbol, sign(qty) ORDER BY time, l_orderkey, l_linenumber, amount, l_quantity) AS no FROM s WHERE closes > 0),
m AS (SELECT e.symbol, e.side, e.no AS entry_no, x.no AS exit_no, e.time AS entry_time, e.price AS entry_price, x.time AS exit_time, x.price AS exit_price, CAST(least(e.hi, x.hi) - greatest(e.hi - e.q, x.hi - x.q) AS DOUBLE) AS part, e.rate AS er, x.rate AS xr
  FROM e JOIN x ON x.symbol = e.symbol AND x.side = e.side AND e.hi - e.q < x.hi AND x.hi - x.q < e.hi),
t AS (SELECT symbol, entry_time, entry_price, exit_time, exit_price, side * part AS size, part * (er + xr) AS commission, side * part * (exit_price - entry_price) - part * (er + xr) AS profit, entry_no, exit_no FROM m)"""
SQL["fifo_trades"] = f"WITH {_TRADES} SELECT symbol, CAST(entry_time AS TIMESTAMP) AS entry_time, round(entry_price, 8) AS entry_price, CAST(exit_time AS TIMESTAMP) AS exit_time, round(exit_price, 8) AS exit_price, round(size, 4) AS size, round(commission, 4) + 0.0 AS commission, round(profit, 4) + 0.0 AS profit, entry_no, exit_no FROM t"
SQL["fifo_open_lots"] = f"""WITH {_TRADES}, g AS (SELECT symbol, side, entry_no, sum(part) AS gone FROM m GROUP BY ALL)
SELECT e.symbol, CAST(e.time AS TIMESTAMP) AS entry_time, round(e.price, 8) AS entry_price, round(e.side * (CAST(e.q AS DOUBLE) - coalesce(gone, 0)), 4) + 0.0 AS size, round((CAST(e.q AS DOUBLE) - coalesce(gone, 0)) * e.rate, 4) + 0.0 AS commission, e.no AS entry_no
FROM e LEFT JOIN g ON g.symbol = e.symbol AND g.side = e.side AND g.entry_no = e.no WHERE CAST(e.q AS DOUBLE) - coalesce(gone, 0) > 1e-9"""
SQL["fifo_summary"] = f"""WITH {_TRADES},
a AS (SELECT symbol, count(*) AS closed_trades, count(*) FILTER (profit > 0) AS winning_trades, count(*) FILTER (profit < 0) AS losing_trades, count(*) FILTER (profit = 0) AS even_trades, sum(profit) AS net_profit,
  coalesce(sum(profit) FILTER (profit > 0), 0) AS gross_profit, coalesce(-sum(profit) FILTER (profit < 0), 0) AS gross_loss, avg(profit) AS avg_trade, avg(profit) FILTER (profit > 0) AS avg_winning_trade, -avg(profit) FILTER (profit < 0) AS avg_losing_trade,
  avg(100 * profit / (abs(size) * entry_price)) AS avg_trade_percent, max(profit) AS largest_winning_trade, -min(profit) AS largest_losing_trade, sum(commission) AS commission_paid FROM t GROUP BY symbol),
d AS (SELECT symbol, CAST(exit_time AS DATE) AS day, sum(profit) AS made FROM t GROUP BY ALL),
l AS (SELECT symbol, count(*) AS days, count(*) FILTER (day > coalesce(kept, DATE '0001-01-01')) AS loss_days FROM (SELECT *, max(CASE WHEN made >= 0 THEN day END) OVER (PARTITION BY symbol) AS kept FROM d) GROUP BY symbol)
SELECT symbol, closed_trades, winning_trades, losing_trades, even_trades, loss_days, days, {", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in ("net_profit", "gross_profit", "gross_loss", "avg_trade", "avg_winning_trade", "avg_losing_trade", "avg_trade_percent", "largest_winning_trade", "largest_losing_trade", "commission_paid"))},
  round(gross_profit / nullif(gross_loss, 0), 3) + 0.0 AS profit_factor, round(100.0 * winning_trades / closed_trades, 3) + 0.0 AS percent_profitable, round(100 * net_profit / 1000000, 3) + 0.0 AS net_profit_percent FROM a JOIN l USING (symbol)"""
SQL["fifo_merged_fills"] = f"""WITH {_TRADES}, u AS (
  SELECT symbol, entry_time AS time, sign(size) AS side, CASE WHEN size > 0 THEN 'Long' ELSE 'Short' END AS label, abs(size) AS qty FROM t
  UNION ALL SELECT symbol, exit_time, -sign(size), CASE WHEN size > 0 THEN 'Close Long' ELSE 'Close Short' END, abs(size) FROM t)
SELECT symbol, CAST(time AS TIMESTAMP) AS time, CAST(side AS DOUBLE) AS side, label, round(sum(qty), 4) AS qty, count(*) AS fills FROM u GROUP BY symbol, time, side, label"""
SQL["fifo_positions"] = f"WITH {_FILLS} SELECT symbol, l_orderkey, l_linenumber, amount, l_quantity, CAST(sum(qty) OVER ({_BY}) AS DOUBLE) AS position, round(lag(price) OVER ({_BY}), 8) + 0.0 AS price_before FROM f"

_SO_FAR = "PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING"
_CURVE = f"""{_TRADES}, b AS (SELECT * FROM {B.sql_bars("line", "day")}),
g AS (SELECT symbol, date_trunc('day', time) AS time, sum(qty) AS qty, sum(CAST(-(CAST(qty AS DOUBLE) * price) - amount * {RATE!r}::DOUBLE AS DECIMAL(28, 8))) AS cash, max(after) AS most, min(after) AS least
  FROM (SELECT *, sum(qty) OVER ({_BY}) AS after FROM f WHERE qty <> 0 AND price IS NOT NULL) GROUP BY ALL),
h AS (SELECT symbol, date_trunc('day', exit_time) AS time, sum(CAST(greatest(profit, 0) AS DECIMAL(28, 8))) AS won, sum(CAST(greatest(-profit, 0) AS DECIMAL(28, 8))) AS lost FROM t GROUP BY ALL),
v AS (SELECT symbol, time, bar_index, high, low, close, CAST(coalesce(sum(qty) OVER w, 0) AS DOUBLE) AS size, CAST(coalesce(sum(cash) OVER w, 0) AS DOUBLE) AS cash, CAST(coalesce(sum(won) OVER w, 0) AS DOUBLE) AS gross_profit, CAST(coalesce(sum(lost) OVER w, 0) AS DOUBLE) AS gross_loss,
  CAST(greatest(max(most) OVER w, 0) AS DOUBLE) AS held_long, CAST(greatest(-min(least) OVER w, 0) AS DOUBLE) AS held_short FROM b LEFT JOIN g USING (symbol, time) LEFT JOIN h USING (symbol, time) WINDOW w AS ({_SO_FAR})),
y AS (SELECT *, gross_profit - gross_loss AS net_profit, 1e7 + cash + size * close AS equity, 1e7 + cash + size * CASE WHEN size > 0 THEN low ELSE high END AS worst, 1e7 + cash + size * CASE WHEN size > 0 THEN high ELSE low END AS best,
  greatest(1e7, max(1e7 + gross_profit - gross_loss) OVER w) AS peak, least(1e7, min(1e7 + gross_profit - gross_loss) OVER w) AS trough FROM v WINDOW w AS ({_SO_FAR})),
c AS (SELECT symbol, time, bar_index, close, equity, net_profit, equity - 1e7 - net_profit AS open_profit, gross_profit, gross_loss, size AS position_size, greatest(0, max(peak - worst) OVER w) AS max_drawdown, greatest(0, max(CASE WHEN peak > 0 THEN 100 * (peak - worst) / peak END) OVER w) AS max_drawdown_percent,
  greatest(0, max(best - trough) OVER w) AS max_runup, greatest(0, max(CASE WHEN best > 0 THEN 100 * (best - trough) / best END) OVER w) AS max_runup_percent, held_long, held_short FROM y WINDOW w AS ({_SO_FAR})),
mo AS (SELECT symbol, date_trunc('month', time) AS month, arg_max(equity, bar_index) AS equity, count(*) AS bars FROM c GROUP BY ALL),
mr AS (SELECT *, equity / nullif(lag(equity, 1, 1e7) OVER (PARTITION BY symbol ORDER BY month), 0) - 1 AS gain FROM mo)"""


def _round(names: str, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names.split())


SQL["account_curve"] = f"WITH {_CURVE} SELECT symbol, bar_index, time, {_round('equity net_profit open_profit gross_profit gross_loss position_size max_drawdown max_drawdown_percent max_runup max_runup_percent held_long held_short', 2)} FROM c"
SQL["account_months"] = f"WITH {_CURVE} SELECT symbol, CAST(month AS TIMESTAMP) AS month, bars, {_round('equity', 2)}, round(100 * gain, 2) + 0.0 AS gain_percent FROM mr"
SQL["account_metrics"] = f"""WITH {_CURVE},
q AS (SELECT t.*, abs(size) * entry_price AS notional, e2.bar_index AS ei, x2.bar_index AS xi FROM t LEFT JOIN b e2 ON e2.symbol = t.symbol AND e2.time = date_trunc('day', entry_time) LEFT JOIN b x2 ON x2.symbol = t.symbol AND x2.time = date_trunc('day', exit_time)),
a AS (SELECT symbol, count(*) AS closed_trades, count(*) FILTER (profit > 0) AS winning_trades, count(*) FILTER (profit < 0) AS losing_trades, count(*) FILTER (profit = 0) AS even_trades, avg(profit) AS avg_trade, avg(profit) FILTER (profit > 0) AS avg_winning_trade, -avg(profit) FILTER (profit < 0) AS avg_losing_trade,
  avg(100 * profit / notional) AS avg_trade_percent, avg(100 * profit / notional) FILTER (profit > 0) AS avg_winning_trade_percent, -avg(100 * profit / notional) FILTER (profit < 0) AS avg_losing_trade_percent, avg(100 * (exit_price / entry_price - 1) * sign(size)) AS avg_price_move_percent,
  avg(100 * profit / (notional + commission / 2)) AS avg_closed_trade_percent, max(profit) AS largest_winning_trade, -min(profit) AS largest_losing_trade, avg(xi - ei) AS avg_bars_in_trade, sum(commission) AS commission_paid FROM q GROUP BY symbol),
z AS (SELECT symbol, arg_max(equity, bar_index) AS equity, arg_max(net_profit, bar_index) AS net_profit, arg_max(open_profit, bar_index) AS open_profit, arg_max(gross_profit, bar_index) AS gross_profit, arg_max(gross_loss, bar_index) AS gross_loss, max(max_drawdown) AS max_drawdown, max(max_drawdown_percent) AS max_drawdown_percent, max(max_runup) AS max_runup, max(max_runup_percent) AS max_runup_percent,
  max(abs(position_size)) AS max_contracts_held, max(held_long) AS max_contracts_held_long, max(held_short) AS max_contracts_held_short, 100 * (arg_max(close, bar_index) / arg_min(close, bar_index) - 1) AS buy_and_hold_percent, date_diff('second', min(time), max(time)) / 86400 AS days FROM c GROUP BY symbol),
k AS (SELECT symbol, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS sd, sqrt(avg(least(r, 0) ** 2)) AS dd FROM (SELECT symbol, gain - 2.0 / 1200 AS r FROM mr) GROUP BY symbol),
s2 AS (SELECT *, 100 * net_profit / 1e7 AS net_profit_percent, 100 * gross_profit / 1e7 AS gross_profit_percent, 100 * gross_loss / 1e7 AS gross_loss_percent, 100 * open_profit / 1e7 AS open_profit_percent, gross_profit / nullif(gross_loss, 0) AS profit_factor, 100.0 * winning_trades / closed_trades AS percent_profitable,
  winning_trades / closed_trades * coalesce(avg_winning_trade, 0) - losing_trades / closed_trades * coalesce(avg_losing_trade, 0) AS expectancy, CASE WHEN n >= 2 AND sd > 0 THEN mean / sd ELSE 0 END AS sharpe, CASE WHEN n >= 2 AND dd > 0 THEN mean / dd ELSE 0 END AS sortino,
  CASE WHEN days >= 1 AND 1e7 + net_profit > 0 THEN 100 * (((1e7 + net_profit) / 1e7) ** (365 / days) - 1) ELSE 0 END AS cagr FROM z JOIN a USING (symbol) JOIN k USING (symbol))
SELECT symbol, closed_trades, winning_trades, losing_trades, even_trades, {_round("equity net_profit open_profit gross_profit gross_loss max_drawdown max_drawdown_percent max_runup max_runup_percent net_profit_percent gross_profit_percent gross_loss_percent open_profit_percent profit_factor percent_profitable expectancy avg_trade avg_winning_trade avg_losing_trade avg_trade_percent avg_winning_trade_percent avg_losing_trade_percent avg_price_move_percent avg_closed_trade_percent largest_winning_trade largest_losing_trade avg_bars_in_trade commission_paid max_contracts_held max_contracts_held_long max_contracts_held_short sharpe sortino cagr buy_and_hold_percent", 3)} FROM s2"""
