"""Casts of odd values, bars that still form, plots without values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barweave.functions import casts
from barweave.operators import barstate, plots


def test_casts_of_odd_values(spark):
    xs = [None, float("nan"), 0.0, -0.4, -1.7, 2.9, float("inf"), 1e300]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = rows.select("i", casts.to_int(F.col("x")).alias("n"), casts.to_bool(F.col("x")).alias("b"), casts.to_float(F.col("x")).alias("f")).orderBy("i").collect()
    assert [r.n for r in got] == [None, None, 0, 0, -1, 2, None, None]
    assert [r.b for r in got] == [False, False, False, True, True, True, True, True]
    assert [r.f for r in got] == [None, None, *xs[2:]]


def test_amounts_of_another_currency_are_na(spark):
    rows = spark.createDataFrame([(1.0, "USD"), (2.0, "EUR"), (3.0, None), (4.0, "")], "v double, c string")
    assert [r.a for r in rows.select(casts.to_account(F.col("v"), F.col("c")).alias("a")).collect()] == [1.0, None, 3.0, 4.0]


@pytest.mark.parametrize("minutes, last", [(150, 1), (180, 2), (181, 2)])
def test_the_last_confirmed_bar_moves_when_the_last_one_closes(spark, minutes, last):
    t0 = dt.datetime(2024, 3, 1, 22)
    bars = spark.createDataFrame([("a", t0 + k * dt.timedelta(hours=1), k) for k in range(3)] + [(None, t0, 0)], "symbol string, time timestamp_ntz, bar_index int")
    got = barstate.states(bars, "60", t0 + dt.timedelta(minutes=minutes), "Europe/Berlin").where("symbol = 'a'").orderBy("bar_index").collect()
    assert [r.bar_index for r in got if r.islastconfirmedhistory] == [last]
    assert [r.isconfirmed for r in got] == [True, True, last == 2]
    assert [r.time_tradingday.day for r in got] == [2, 2, 2]  # closes at midnight and later in Berlin
    assert barstate.states(bars.where("false"), "60").count() == 0


def test_plots_of_na(spark):
    bars = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 0, None), ("a", dt.datetime(2024, 1, 2), 1, 0.0)], "symbol string, time timestamp_ntz, bar_index int, x double")
    x = F.col("x")
    got = plots.rows(bars, plots.arrow("m", x, F.lit("u"), F.lit("d")), plots.fill("f", x, F.lit(1.0), F.lit("c"))).orderBy("bar_index", "title").collect()
    assert [(r.value, r.color, r.shape) for r in got] == [([None, None], None, None), ([None], None, None), ([0.0, 1.0], "c", None), ([0.0], None, None)]
    with pytest.raises(ValueError):
        plots.rows(bars)
