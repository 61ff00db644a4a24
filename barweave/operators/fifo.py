"""First in, first out: which part of which fill closes which part of which earlier one, without a fold.

Fills of a symbol in order have a position before and after each: what reduces it is an exit, what
enlarges it an entry, and a fill that turns it is both. All entries of one side laid end to end by quantity make a
line, all exits of that side another; as both lines are equally long whenever the position is flat, the k-th
unit that was entered is the k-th one that is closed. So a trade is a stretch where one entry's range and one exit's range overlap,
and it ends where one of both does. The line is dealt in blocks, each range to all that it touches; down the ends of
a block, the latest range seen of each kind is the one that covers an end. There are no more stretches than fills,
whatever their sizes.

Sums over fills by time are worked out in blocks: rows sum within their block, one row a block sums over blocks, and
both are added where they meet. A symbol with a third of all fills is spread over its blocks by time and by quantity.

Quantities are decimals of ``PLACES`` places, so that sums in any order are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimal places of quantities.
PLACES = 8
#: A symbol's mean quantities of a block of its line.
WIDTH = 2048
#: Ends on a line: one digit short of the most, so that differences keep all places.
_LINE = f"decimal(37,{PLACES})"
#: Before all blocks of a type; other types are compared as text.
FIRST = {"bigint": str(-(2**63)), "timestamp": "-290000-01-01 00:00:00", "timestamp_ntz": "-290000-01-01 00:00:00"}


def _dealt(df: DataFrame, block: Column) -> DataFrame:
    """df with _block, its row's block and never NULL, and _at, which orders blocks; no block at all is the first one."""
    kind = df.select(block).dtypes[0][1]
    if kind in FIRST:
        at = F.coalesce(block, F.lit(FIRST[kind]).cast(kind))
        return df.withColumns({"_block": at, "_at": at})
    return df.withColumns({"_block": F.coalesce(block.cast("string"), F.lit("")), "_at": F.coalesce(block, F.lit(None))})


def _add(rows: DataFrame, within: str, before: str) -> Column:
    """Both sums; those of the most digits would be added with a place less."""
    kind = rows.select(within).dtypes[0][1].replace("decimal(38,", "decimal(37,")
    return F.col(within).cast(kind) + F.coalesce(before, F.lit(0)).cast(kind)


def running(df: DataFrame, keys: tuple[str, ...], block: Column, order: tuple[str, ...], sums: dict[str, Column], previous: dict[str, Column] | None = None) -> DataFrame:
    """df with the sums of all rows up to this one, and the previous row's values, for each value of keys by order.

    block must not fall as order rises. Rows move once, by keys and block.
    """
    previous = previous or {}
    dealt = _dealt(df, block)
    within = Window.partitionBy("_block", *keys).orderBy(*order)
    rows = dealt.withColumns({**{f"_s{i}": F.sum(x).over(within) for i, x in enumerate(sums.values())}, **{f"_p{i}": F.lag(F.struct(x.alias("x"))).over(within) for i, x in enumerate(previous.values())}})
    last = F.struct(*order)
    parts = dealt.groupBy("_block", *keys).agg(F.min("_at").alias("_at"), *[F.sum(x).alias(f"_b{i}") for i, x in enumerate(sums.values())], *[F.max_by(F.struct(x.alias("x")), last).alias(f"_q{i}") for i, x in enumerate(previous.values())])
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_b{i}").over(before).alias(f"_b{i}") for i in range(len(sums))] + [F.last(f"_q{i}").over(before).alias(f"_q{i}") for i in range(len(previous))]
    carry = parts.select("_block", *keys, *carried)
    both = rows.join(carry, ["_block", *keys])
    named = [_add(both, f"_s{i}", f"_b{i}").alias(n) for i, n in enumerate(sums)]
    named += [F.coalesce(f"_p{i}", f"_q{i}")["x"].alias(n) for i, n in enumerate(previous)]
    return both.select(*df.columns, *named)


def _split(fills: DataFrame, block: Column, order: tuple[str, ...]) -> DataFrame:
    """fills with what of each is an exit and an entry, on which side, and where they end on their lines; e_no and x_no number them.
    closed is the length of all exits of the side that the fill enters, width that of the symbol's blocks of the line.

    Fills move and are sorted once for both rounds of sums, the position and what depends on it."""
    within = Window.partitionBy("_block", "symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    of_symbol = Window.partitionBy("symbol")
    before = of_symbol.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    zero, buys, size = F.lit(0).cast(f"decimal(28,{PLACES})"), F.col("qty") > 0, F.abs("qty")
    dealt = _dealt(fills, block)
    carry = dealt.groupBy("_block", "symbol").agg(F.min("_at").alias("_at"), F.sum("qty").alias("_b")).select("_block", "symbol", F.sum("_b").over(before).alias("_b"))
    rows = dealt.withColumn("_s", F.sum("qty").over(within)).join(carry, ["_block", "symbol"])
    rows = rows.withColumn("after", _add(rows, "_s", "_b").cast(_LINE)).drop("_s", "_b")
    held = (F.col("after") - F.col("qty")).cast(_LINE)
    against = F.when(buys, held < 0).otherwise(held > 0)
    rows = rows.withColumn("out", F.when(against, F.least(F.abs(held), size)).otherwise(zero).cast(f"decimal(28,{PLACES})"))
    rows = rows.withColumn("into", (size - F.col("out")).cast(f"decimal(28,{PLACES})"))
    enters, leaves = F.col("into") > 0, F.col("out") > 0
    sums = {"bought": F.when(buys, size).otherwise(zero), "e_long": F.when(buys, F.col("into")).otherwise(zero)}
    sums |= {"e_long_no": (buys & enters).cast("long"), "x_long_no": (~buys & leaves).cast("long"), "e_short_no": (~buys & enters).cast("long"), "x_short_no": (buys & leaves).cast("long")}
    totals = {"_all": size, "_n": F.lit(1), "_x_long": F.when(~buys, F.col("out")), "_x_short": F.when(buys, F.col("out"))}
    parts = rows.groupBy("_block", "symbol").agg(F.min("_at").alias("_at"), *[F.sum(x).alias(n) for n, x in (sums | totals).items()])
    carry = parts.select("_block", "symbol", *[F.sum(n).over(before).alias(f"_b_{n}") for n in sums], *[F.sum(n).over(of_symbol).alias(n) for n in totals])
    rows = rows.withColumns({f"_s_{n}": F.sum(x).over(within) for n, x in sums.items()}).join(carry, ["_block", "symbol"])
    rows = rows.withColumns({n: _add(rows, f"_s_{n}", f"_b_{n}").cast("long" if n.endswith("_no") else _LINE) for n in sums})
    # a side's entries less its exits are the position on it, and a buy is an entry of the one or an exit of the other
    x_short = (F.col("bought") - F.col("e_long")).cast(_LINE)
    at = {"e": F.when(buys, F.col("e_long")).otherwise(x_short + F.greatest(-F.col("after"), zero)), "x": F.when(buys, x_short).otherwise(F.col("e_long") - F.greatest("after", zero))}
    return rows.select(
        "symbol", "time", "price", (F.coalesce("commission", F.lit(0.0)) / size.cast("double")).alias("rate"), "into", "out", F.when(buys, 1).otherwise(-1).alias("side"), (F.col("_all").cast("double") / F.col("_n") * WIDTH).alias("width"),
        at["e"].cast(_LINE).alias("e_end"), F.when(buys, F.col("e_long_no")).otherwise(F.col("e_short_no")).alias("e_no"), at["x"].cast(_LINE).alias("x_end"), F.when(buys, F.col("x_short_no")).otherwise(F.col("x_long_no")).alias("x_no"),
        F.coalesce(F.when(buys, F.col("_x_long")).otherwise(F.col("_x_short")), zero).cast(_LINE).alias("closed"),
    )


def match(fills: DataFrame, block: Column, order: tuple[str, ...] = ("time",), pointvalue: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Trades and what is still open, from fills (symbol, time, qty, price, commission, and order's columns, which must tell a symbol's fills apart).

    qty is signed; fills of no quantity, price or symbol are left out. block is a Column that does not fall as order rises, such as the
    month of time: the fills of a symbol's block are one task's rows. Trades: symbol, entry_time, entry_price, exit_time, exit_price,
    size (signed), commission (both fills' shares), profit (less commission), entry_no and exit_no. Open: symbol, entry_time, entry_price, size, commission, entry_no.
    """
    qty = F.col("qty").cast(f"decimal(28,{PLACES})")
    fills = fills.withColumn("qty", qty).where("qty <> 0 and price is not null and symbol is not null")
    split = _split(fills.select(*dict.fromkeys(["symbol", "time", "qty", "price", "commission", *order])), block, order)

    def at(end: Column) -> Column:
        return F.floor(end.cast("double") / F.col("width"))

    def of(kind: str, size: str, side: Column) -> Column:
        end, begin = F.col(f"{kind}_end"), (F.col(f"{kind}_end") - F.col(size)).cast(_LINE)
        return F.when(F.col(size) > 0, F.struct(F.lit(kind == "e").alias("entry"), side.alias("side"), begin.alias("begin"), end.alias("end"), F.col(f"{kind}_no").alias("no"), at(begin).alias("first"), at(end).alias("last")))

    # what lies beyond all exits of its side meets none
    ranges = F.array_compact(F.array(F.when(F.col("e_end") - F.col("into") < F.col("closed"), of("e", "into", F.col("side"))), of("x", "out", -F.col("side"))))
    ranges = split.select("symbol", "time", "price", "rate", F.explode(ranges).alias("r")).select("symbol", "r.*", "time", "price", "rate")
    ranges = ranges.withColumn("block", F.explode(F.sequence("first", "last")))
    down = Window.partitionBy("block", "symbol", "side").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    one = F.struct("begin", "end", "no", "time", "price", "rate")
    met = ranges.withColumns({"e": F.last(F.when(F.col("entry"), one), ignorenulls=True).over(down), "x": F.last(F.when(~F.col("entry"), one), ignorenulls=True).over(down)})
    # of two that end alike the second one seen knows both; the first one's stretch is empty
    part = F.col("end") - F.greatest("e.begin", "x.begin")
    met = met.where(F.col("block") == F.col("last")).where("e is not null and x is not null").withColumn("part", part.cast("double")).where("part > 0")
    size = F.col("side") * F.col("part")
    commission = F.col("part") * (F.col("e.rate") + F.col("x.rate"))
    profit = size * (F.col("x.price") - F.col("e.price")) * F.lit(pointvalue) - commission
    trades = met.select(
        "symbol", F.col("e.time").alias("entry_time"), F.col("e.price").alias("entry_price"), F.col("x.time").alias("exit_time"), F.col("x.price").alias("exit_price"),
        size.alias("size"), commission.alias("commission"), profit.alias("profit"), F.col("e.no").alias("entry_no"), F.col("x.no").alias("exit_no"),
    )
    part = F.least(F.col("into"), (F.col("e_end") - F.col("closed"))).cast("double")
    still = split.where("into > 0 and e_end > closed").withColumn("part", part)
    return trades, still.select("symbol", F.col("time").alias("entry_time"), F.col("price").alias("entry_price"), (F.col("side") * F.col("part")).alias("size"), (F.col("part") * F.col("rate")).alias("commission"), F.col("e_no").alias("entry_no"))


def summary(trades: DataFrame, initial_capital: float = 1_000_000.0) -> DataFrame:
    """One row for each symbol: counts, gross and net profit, means, largest trades, and the run of losing days at the end.

    A day's profit is that of the trades closed on it; loss_days counts the days after the last one whose profit was not below 0."""
    p, notional = F.col("profit"), F.abs("size") * F.col("entry_price")
    won, lost = p > 0, p < 0
    t = trades.groupBy("symbol").agg(
        F.count("*").alias("closed_trades"), F.count(F.when(won, 1)).alias("winning_trades"), F.count(F.when(lost, 1)).alias("losing_trades"), F.count(F.when(p == 0, 1)).alias("even_trades"),
        F.sum(p).alias("net_profit"), F.coalesce(F.sum(F.when(won, p)), F.lit(0.0)).alias("gross_profit"), F.coalesce(F.sum(F.when(lost, -p)), F.lit(0.0)).alias("gross_loss"),
        F.avg(p).alias("avg_trade"), F.avg(F.when(won, p)).alias("avg_winning_trade"), F.avg(F.when(lost, -p)).alias("avg_losing_trade"),
        F.avg(100 * p / notional).alias("avg_trade_percent"), F.max(p).alias("largest_winning_trade"), F.max(-p).alias("largest_losing_trade"), F.sum("commission").alias("commission_paid"),
    )
    day = trades.groupBy("symbol", F.to_date("exit_time").alias("day")).agg(F.sum("profit").alias("made"))
    kept = day.groupBy("symbol").agg(F.max(F.when(F.col("made") >= 0, F.col("day"))).alias("kept"))
    streak = day.join(kept, "symbol").groupBy("symbol").agg(F.count(F.when(F.col("kept").isNull() | (F.col("day") > F.col("kept")), 1)).alias("loss_days"), F.count("*").alias("days"))
    factor = F.try_divide(F.col("gross_profit"), F.when(F.col("gross_loss") > 0, F.col("gross_loss")))
    return t.join(streak, "symbol").withColumns({"profit_factor": factor, "percent_profitable": 100 * F.col("winning_trades") / F.col("closed_trades"), "net_profit_percent": 100 * F.col("net_profit") / F.lit(initial_capital)})
