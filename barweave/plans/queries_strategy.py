"""Backtests over hourly bars of events. What a strategy decides depends on its own fills, which SQL's windows can't follow; tests hold known runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recursive as R
from ..operators import ta
from ..operators.broker import LONG, SHORT, Config, backtest, merged_fills, metrics
from . import bars as B
from . import script as S
from .queries_ta import windows

Q: dict = {}
SQL: dict[str, str] = {}


def averages(bar: dict, b) -> None:
    if bar["fast"] is None or bar["slow"] is None:
        return
    if bar["fast"] > bar["slow"]:
        b.entry("Long", LONG)
    elif bar["fast"] < bar["slow"]:
        b.entry("Short", SHORT)


def bracket(bar: dict, b) -> None:
    if bar["rsi"] is not None and bar["rsi"] < 45:
        b.entry("Long", LONG)
    b.exit("Out", "Long", profit=2000.0, loss=1000.0)


AVERAGES, BRACKET = Config(commission_value=0.1), Config(pyramiding=2, default_qty_type="cash", default_qty_value=1000.0)


def _bars(spark, sf_dir: str) -> DataFrame:
    bars = B.event_bars(spark, sf_dir).withColumns({"fast": ta.sma(F.col("close"), 5), "slow": ta.sma(F.col("close"), 20)})
    return R.fold(bars, R.Step(("rsi",), R.rsi, ("close",), (14,)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


for _name, _script, _config in (("averages", averages, AVERAGES), ("bracket", bracket, BRACKET)):
    Q[f"strategy_{_name}_trades"] = lambda s, d, f=_script, c=_config: _rounded(backtest(_bars(s, d), f, c))
    Q[f"strategy_{_name}_equity"] = lambda s, d, f=_script, c=_config: _rounded(backtest(_bars(s, d), f, c, want="equity"))
    Q[f"strategy_{_name}_metrics"] = lambda s, d, f=_script, c=_config: _rounded(metrics(backtest(_bars(s, d), f, c), backtest(_bars(s, d), f, c, want="equity"), c))
Q["strategy_averages_open"] = lambda s, d: _rounded(backtest(_bars(s, d), averages, AVERAGES, want="open"))
Q["strategy_merged_fills"] = lambda s, d: _rounded(merged_fills(backtest(_bars(s, d), averages, AVERAGES)))
INDICATOR = 'fast = ta.sma(close, 5)\nslow = ta.sma(close, 14)\nplot(fast - slow, "spread")\nplot(ta.crossover(fast, slow), "up")'
Q["script_indicator"] = lambda s, d: _rounded(S.run(B.event_bars(s, d), INDICATOR))
_five = "PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"
SQL["script_indicator"] = f"""WITH b AS (SELECT * FROM {B.sql_bars()}),
d AS (SELECT symbol, time, bar_index, CASE WHEN bar_index >= 4 THEN avg(close) OVER ({_five}) END AS fast, CASE WHEN bar_index >= 13 THEN avg(close) OVER f END AS slow FROM b {windows()})
SELECT symbol, time, bar_index, round(fast - slow, 6) AS spread, coalesce(lag(fast) OVER w <= lag(slow) OVER w AND fast - slow >= 1e-10, false) AS up FROM d {windows()}"""
CROSS = 'strategy("Cross", commission_value=0.1)\nfast = ta.ema(close, 5)\nslow = ta.ema(close, 20)\nif (ta.crossover(fast, slow))\n    strategy.entry("Long", strategy.long)\nif (ta.crossunder(fast, slow))\n    strategy.close("Long")'
Q["script_strategy"] = lambda s, d: _rounded(S.run_strategy(B.event_bars(s, d), CROSS))
