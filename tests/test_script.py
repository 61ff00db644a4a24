"""Scripts give what the operators give, known strategies their trades, and what is not known a clear refusal."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barweave.operators import recursive as R
from barweave.operators import ta
from barweave.operators.broker import LONG, Config, simulate
from barweave.plans import script as S
from test_broker import UP_TWICE, UP_TWICE_TRADES, bars_of, frame_of

UP_TWICE_TEXT = """strategy("Up twice")
up = close > close[1] and close[1] > close[2]
if (up)
    strategy.entry("Up", strategy.long)
if (close < open)
    strategy.close("Up")"""

#: A script of averages that cross, with a bracket of which half goes at the limit, and what it asks for bar by bar.
CROSSING = """strategy("Crossing", initial_capital=5000, commission_value=0.2)
quick = ta.ema(close, 3)
calm = ta.sma(close, 6)
if (ta.crossover(quick, calm))
    strategy.entry("In", strategy.long, 4)
if (ta.crossunder(quick, calm))
    strategy.close("In", qty_percent=100)
strategy.exit("Half", "In", qty_percent=50, profit=400)"""


def waves(n):
    """Closes of two waves of different length, each bar from the last close."""
    closes = [200 + 9 * math.sin(i / 4) + 5 * math.cos(i / 7) for i in range(n)]
    return bars_of([(o, max(o, c) + 1, min(o, c) - 1, c) for o, c in zip([closes[0], *closes], closes)])


def trades(rows):
    return [(t["entry_id"], t["entry_price"], t["entry_bar_index"], t["exit_id"], t["exit_price"], t["exit_bar_index"], t["size"]) for t in rows]


def test_a_script_gives_the_trades_worked_out_by_hand(spark):
    assert trades(S.run_strategy(frame_of(spark, bars_of(UP_TWICE)), UP_TWICE_TEXT).collect()) == UP_TWICE_TRADES


def test_a_script_trades_as_the_function_it_says(spark):
    bars = waves(120)
    c = [b["close"] for b in bars]
    quick = R.ema(c, 3)
    calm = [None if i < 5 else sum(c[i - 5 : i + 1]) / 6 for i in range(len(c))]

    def script(bar, b):
        i = bar["bar_index"]
        if i and calm[i - 1] is not None:
            if quick[i - 1] <= calm[i - 1] and quick[i] > calm[i]:
                b.entry("In", LONG, 4)
            if quick[i - 1] >= calm[i - 1] and quick[i] < calm[i]:
                b.close("In")
        b.exit("Half", "In", qty_percent=50, profit=400)

    want = trades(simulate(bars, script, Config(initial_capital=5000, commission_value=0.2))[0])
    assert trades(S.run_strategy(frame_of(spark, bars), CROSSING).collect()) == want and {w[3] for w in want} == {"Half", "close_In"}


def test_marks_become_columns(spark):
    got = S.run(frame_of(spark, bars_of(UP_TWICE)), 'plotshape(close > open, title="up")\nplot(close, "c")').orderBy("bar_index").collect()
    assert [r.up for r in got] == [c > o for o, _, _, c in UP_TWICE]


def test_plots_equal_operators(spark):
    df = frame_of(spark, waves(40))
    text = 'n = input.int(5, "Length")\nfast = ta.ema(close, n)\nplot(fast - ta.sma(hl2, n), "d")\nplot(nz(ta.change(close)[1], -1) > 0 and not (close < open) ? math.max(close, open) : na, title="m")\nplot(ta.hma(close, 9), "h")'
    got = S.run(df, text, {"Length": 4}).orderBy("bar_index").collect()
    want = R.fold(df, R.Step(("e",), R.ema, ("close",), (4,))).withColumns({"x": (F.col("high") + F.col("low")) / 2}).withColumn("s", ta.sma(F.col("x"), 4)).withColumn("c", ta.change(F.col("close"))).withColumn("c1", ta.lag(F.col("c"), 1)).withColumn("k", ta.hma_core(F.col("close"), 9)).withColumn("h", ta.wma(F.col("k"), 3)).orderBy("bar_index").collect()
    for g, w in zip(got, want, strict=True):
        assert g.d == (None if w.e is None or w.s is None else pytest.approx(w.e - w.s))
        ok = (w.c1 if w.c1 is not None else -1) > 0 and not w.close < w.open
        assert g.m == (max(w.close, w.open) if ok else None)
        assert g.h == (None if w.h is None else pytest.approx(w.h))


@pytest.mark.parametrize("text, what", [("var x = 1", "state"), ("for i = 0 to 3", "for"), ("f(x) => x", "f"), ("plot(foo.bar(1))", "foo.bar"), ("plot(ta.sma(close, close))", "constant"), ("plot(nope)", "nope"), ("hline(5)", "hline")])
def test_refusals(spark, text, what):
    with pytest.raises(S.Unsupported, match=what):
        S.run(frame_of(spark, bars_of(UP_TWICE)), text)


@pytest.mark.parametrize("line", ['strategy("x", nonsense=1)', 'strategy.entry("L", strategy.long, oca_name="a")', 'strategy.close("L", when=close > 1)', "close", 'strategy.cancel("L", comment="c", x=1)'])
def test_nothing_is_dropped_silently(spark, line):
    df = spark.createDataFrame([("a", 0, dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, bar_index int, time timestamp_ntz, open double, high double, low double, close double, volume double")
    with pytest.raises(S.Unsupported):
        S.compile_script(df, line)


def test_immediate_closes_fill_on_their_bar(spark):
    rows = [("a", i, dt.datetime(2024, 1, 1 + i), o, o + 1, o - 1, o + 0.5, 1.0) for i, o in enumerate([10.0, 20.0, 30.0, 40.0])]
    df = spark.createDataFrame(rows, "symbol string, bar_index int, time timestamp_ntz, open double, high double, low double, close double, volume double")
    for how, price in (("", 40.0), (", immediately=true", 30.5)):
        text = f'strategy("x")\nif (close < 15)\n    strategy.entry("L", strategy.long)\nif (close > 30)\n    strategy.close("L"{how})'
        assert [(t.entry_price, t.exit_price) for t in S.run_strategy(df, text).collect()] == [(20.0, price)]
