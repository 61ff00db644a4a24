"""What an account is worth on every bar, from fills and the trades they pair to, without replaying a strategy.

Fills and trades are summed up by bar where they lie, meet the bars in one aggregation by (symbol, time), and run on
over a symbol's bars like any other series; so what moves by symbol alone is bars, however many fills they had.
``broker.metrics`` reads the curve and the trades of ``placed`` as it reads those of a backtest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .broker import Config
from .fifo import PLACES, running

_MONEY = f"decimal(28,{PLACES})"


def curve(bars: DataFrame, fills: DataFrame, trades: DataFrame, bucket: Callable[[Column], Column], block: Column, order: tuple[str, ...] = ("time",), config: Config = Config()) -> DataFrame:
    """A row for each of bars (symbol, time, bar_index, high, low, close): equity, its parts and its extremes so far.

    fills, block and order are those of ``fifo.match``, trades what it returned; bucket gives the time of the bar that a time falls
    into. What falls into no bar counts from the symbol's next bar on; fills of a symbol without bars are nowhere. A bar
    without a close has the last one, one without a high or low its close; equity is NULL while a position stands and no close is known.

    equity is capital, cash paid and received less commissions, and the position at the close; net_profit is that of closed trades,
    open_profit the rest, so commissions of open lots are in it. max_drawdown is the most that equity, at the worst price of a bar,
    lay under the peak of capital and net profit, max_runup the most it lay over their trough at the best price; _percent: the
    largest share of that peak, and of the equity reached. held_long and held_short: the largest position after any one fill.
    """
    zero, capital, point = F.lit(0).cast(_MONEY), F.lit(float(config.initial_capital)), F.lit(float(config.pointvalue))
    done = fills.withColumn("qty", F.col("qty").cast(_MONEY)).where("qty <> 0 and price is not null and symbol is not null")
    done = running(done, ("symbol",), block, order, {"_after": F.col("qty")})
    paid = -(F.col("qty").cast("double") * F.col("price") * point) - F.coalesce("commission", F.lit(0.0))
    of_fills = done.groupBy("symbol", bucket(F.col("time")).alias("time")).agg(F.sum("qty").alias("_qty"), F.sum(paid.cast(_MONEY)).alias("_cash"), F.max("_after").alias("_most"), F.min("_after").alias("_least"))
    won, lost = F.greatest("profit", F.lit(0.0)), F.greatest(-F.col("profit"), F.lit(0.0))
    of_trades = trades.groupBy("symbol", bucket(F.col("exit_time")).alias("time")).agg(F.sum(won.cast(_MONEY)).alias("_won"), F.sum(lost.cast(_MONEY)).alias("_lost"))
    prices = bars.select("symbol", "time", "bar_index", "high", "low", "close")
    rows = prices.unionByName(of_fills, allowMissingColumns=True).unionByName(of_trades, allowMissingColumns=True)
    rows = rows.groupBy("symbol", "time").agg(*[F.max(c).alias(c) for c in rows.columns if c not in ("symbol", "time")])
    w = Window.partitionBy("symbol").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)

    def so_far(x: Column) -> Column:
        return F.coalesce(F.sum(x).over(w), zero).cast("double")

    rows = rows.select(
        "symbol", "time", "bar_index", F.last("close", ignorenulls=True).over(w).alias("close"), "high", "low", so_far(F.col("_qty")).alias("position_size"), so_far(F.col("_cash")).alias("_cash"),
        so_far(F.col("_won")).alias("gross_profit"), so_far(F.col("_lost")).alias("gross_loss"), F.greatest(F.max("_most").over(w), zero).cast("double").alias("held_long"), F.greatest(-F.min("_least").over(w), zero).cast("double").alias("held_short"),
    ).where("bar_index is not null")
    size = F.col("position_size")

    def worth(price: Column) -> Column:
        return capital + F.col("_cash") + F.when(size == 0, F.lit(0.0)).otherwise(size * price * point)

    low, high = F.coalesce("low", "close"), F.coalesce("high", "close")
    rows = rows.withColumn("net_profit", F.col("gross_profit") - F.col("gross_loss")).withColumns(
        {
            "equity": worth(F.col("close")),
            "_worst": worth(F.when(size > 0, low).otherwise(high)),
            "_best": worth(F.when(size > 0, high).otherwise(low)),
            "_peak": F.greatest(capital, F.max(capital + F.col("net_profit")).over(w)),
            "_trough": F.least(capital, F.min(capital + F.col("net_profit")).over(w)),
        }
    )
    down, up, none = F.col("_peak") - F.col("_worst"), F.col("_best") - F.col("_trough"), F.lit(0.0)
    rows = rows.withColumns(
        {
            "open_profit": F.col("equity") - capital - F.col("net_profit"),
            "max_drawdown": F.greatest(none, F.max(down).over(w)),
            "max_drawdown_percent": F.greatest(none, F.max(F.when(F.col("_peak") > 0, 100 * down / F.col("_peak"))).over(w)),
            "max_runup": F.greatest(none, F.max(up).over(w)),
            "max_runup_percent": F.greatest(none, F.max(F.when(F.col("_best") > 0, 100 * up / F.col("_best"))).over(w)),
        }
    )
    names = "symbol bar_index time close equity net_profit open_profit gross_profit gross_loss position_size max_drawdown max_drawdown_percent max_runup max_runup_percent held_long held_short"
    return rows.select(*names.split())


def placed(trades: DataFrame, bars: DataFrame, bucket: Callable[[Column], Column]) -> DataFrame:
    """trades with entry_bar_index and exit_bar_index; NULL where no bar is."""
    for end in ("entry", "exit"):
        at = bars.select("symbol", F.col("time").alias("_bar"), F.col("bar_index").alias(f"{end}_bar_index"))
        trades = trades.withColumn("_bar", bucket(F.col(f"{end}_time"))).join(at, ["symbol", "_bar"], "left").drop("_bar")
    return trades


def months(equity: DataFrame, config: Config = Config()) -> DataFrame:
    """Each month's last equity, and its return on the month before's, the first one's on the capital; a month without bars is none."""
    w = Window.partitionBy("symbol").orderBy("month")
    last = equity.groupBy("symbol", F.date_trunc("month", "time").cast("timestamp_ntz").alias("month")).agg(F.max_by("equity", "bar_index").alias("equity"), F.count("*").alias("bars"))
    before = F.when(F.row_number().over(w) == 1, F.lit(float(config.initial_capital))).otherwise(F.lag("equity").over(w))
    return last.withColumn("gain_percent", 100 * (F.try_divide(F.col("equity"), before) - 1))
