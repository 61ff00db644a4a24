"""The recursive operators against plain loops, with missing values, and that folding in one pass changes nothing."""

import math

import pytest

from barweave.operators import recursive as R

NA = math.nan
X = [10, 11, 12, 11, 13, 14, 13, 15, 16, 15, 14, 13, 12, 14, 15, 17, 18, 17, 16, 18]


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert math.isnan(x) and math.isnan(y) or x == pytest.approx(y, abs=1e-9)


def test_ema_skips_na():
    near(R.ema([1, NA, 2, 3, NA, 5], 3), [NA, NA, NA, 2.0, NA, 3.5])


def test_rma_takes_na_as_zero():
    near(R.rma([3, NA, 3, 6], 3), [NA, NA, 2.0, 2.0 * 2 / 3 + 6 / 3])


def test_rsi_first_value_and_no_losses():
    assert [math.isnan(v) for v in R.rsi(X, 5)].index(False) == 5
    assert R.rsi(list(range(1, 12)), 5)[-1] == 100


def test_macd_signal_starts_when_the_line_does():
    line, signal, _ = R.macd(X, 3, 6, 4)
    assert [math.isnan(v) for v in line].index(False) == 5
    assert [math.isnan(v) for v in signal].index(False) == 8


def test_supertrend_turns():
    h = [x + 1 for x in X] + [40, 42, 10, 8]
    low = [x - 1 for x in X] + [38, 40, 6, 4]
    line, direction = R.supertrend(h, low, X + [39, 41, 7, 5], 1.0, 3)
    assert direction[2] == 1.0
    assert direction[-3] == -1.0 and direction[-1] == 1.0
    assert line[-3] < 41 and line[-1] > 5


def test_sar_stays_on_the_other_side():
    h, low, c = [x + 1.0 for x in X], [x - 1.0 for x in X], [float(x) for x in X]
    s = R.sar(h, low, c, 0.02, 0.02, 0.2)
    assert math.isnan(s[0]) and not any(map(math.isnan, s[1:]))
    assert all(v <= lo or v >= hi for v, hi, lo in zip(s[2:], h[2:], low[2:], strict=True))


def test_na_bars_leave_state_alone():
    h, low, c = [x + 1.0 for x in X], [x - 1.0 for x in X], [float(x) for x in X]
    gap = lambda z: z[:8] + [NA] + z[8:]
    for kernel, args in ((R.atr, (5,)), (R.dmi, (4, 4)), (R.supertrend, (2.0, 4)), (R.sar, (0.02, 0.02, 0.2))):
        whole, holed = kernel(h, low, c, *args), kernel(gap(h), gap(low), gap(c), *args)
        one = lambda z: z[0] if isinstance(z, tuple) else z
        near(one(whole), one(holed)[:8] + one(holed)[9:])


def test_fold_in_one_pass(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(X)] + [("b", i, None) for i in range(3)], "symbol string, bar_index int, close double")
    got = R.fold(df, R.Step(("e",), R.ema, ("close",), (5,)), R.Step(("ee",), R.ema, ("e",), (3,))).orderBy("symbol", "bar_index").collect()
    e = R.ema([float(x) for x in X], 5)
    near([NA if r.e is None else r.e for r in got if r.symbol == "a"], e)
    near([NA if r.ee is None else r.ee for r in got if r.symbol == "a"], R.ema(e, 3))
    assert all(r.e is None for r in got if r.symbol == "b")


def test_one_exchange_for_many_windows(spark):
    from pyspark.sql import functions as F

    from barweave.operators import ta

    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(X)], "symbol string, bar_index int, close double")
    c = F.col("close")

    def moves(**made):
        plan = df.withColumns(made)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan.count("Sort [")

    assert moves(s=ta.sma(c, 5), h=ta.highest(c, 7), v=ta.variance(c, 4), l=ta.lag(c, 3)) == (1, 1)
    # windows of the last values that are not na deal a symbol's bars once more where they lie: a sort, no exchange
    assert moves(s=ta.sma(c, 5), h=ta.highest(c, 7), d=ta.stdev(c, 4), b=ta.bb(c, 4, 2.0), l=ta.lag(c, 3)) == (1, 2)
