"""A run worked out by hand, and rules of the broker one at a time."""

import datetime as dt

import pytest

from barweave.operators.broker import LONG, SHORT, Broker, Config, backtest, merged_fills, metrics, simulate

def bars_of(rows):
    return [{"bar_index": i, "time": dt.datetime(2021, 1, 1) + dt.timedelta(days=i), "open": float(o), "high": float(h), "low": float(lo), "close": float(c), "volume": 1000.0} for i, (o, h, lo, c) in enumerate(rows)]


def up_twice(bar, b):
    """Two rises of the close in a row open, a bar that falls closes."""
    up_twice.closes = [] if bar["bar_index"] == 0 else up_twice.closes
    up_twice.closes.append(bar["close"])
    c = up_twice.closes
    if len(c) > 2 and c[-1] > c[-2] > c[-3]:
        b.entry("Up", LONG)
    if bar["close"] < bar["open"]:
        b.close("Up")


#: Ten bars (open, high, low, close), made up for this test. Closes rise twice on bars 2 and 6, so entries fill at the
#: opens 56 and 61 of bars 3 and 7; bars 4 and 8 fall, so closes fill at the opens 55 and 58 of bars 5 and 9.
UP_TWICE = [(50, 52, 49, 51), (51, 54, 50, 53), (53, 57, 52, 56), (56, 60, 55, 59), (59, 61, 54, 55), (55, 58, 53, 57), (57, 62, 56, 61), (61, 63, 58, 62), (62, 64, 57, 58), (58, 59, 55, 56)]
UP_TWICE_TRADES = [("Up", 56, 3, "close_Up", 55, 5, 1), ("Up", 61, 7, "close_Up", 58, 9, 1)]


def frame_of(spark, bars):
    return spark.createDataFrame([("x", *(b[k] for k in ("bar_index", "time", "open", "high", "low", "close", "volume"))) for b in bars], "symbol string, bar_index int, time timestamp_ntz, open double, high double, low double, close double, volume double")


def test_trades_and_metrics_of_a_run_worked_out_by_hand(spark):
    bars = bars_of(UP_TWICE)
    trades, equity, still = simulate(bars, up_twice, Config())
    assert [tuple(t[k] for k in ("entry_id", "entry_price", "entry_bar_index", "exit_id", "exit_price", "exit_bar_index", "size")) for t in trades] == UP_TWICE_TRADES and still == []

    def script(bar, b):
        if bar["bar_index"] in (2, 6):
            b.entry("Up", LONG)
        if bar["bar_index"] in (4, 8):
            b.close("Up")

    df = frame_of(spark, bars)
    got = metrics(backtest(df, script), backtest(df, script, want="equity")).first()
    assert (got.closed_trades, got.winning_trades, got.losing_trades, got.net_profit, got.gross_profit, got.gross_loss) == (2, 0, 2, -4, 0, 4)
    assert got.avg_losing_trade == 2 and got.avg_losing_trade_percent == pytest.approx((100 / 56 + 300 / 61) / 2) and got.avg_winning_trade_percent is None
    assert got.max_drawdown == pytest.approx(max(e["max_drawdown"] for e in equity)) and got.max_contracts_held_long == 1 and got.max_contracts_held_short == 0
    assert equity[3]["entry_name"] == "Up" and equity[9]["entry_name"] is None


def test_a_margin_call_closes_four_times_what_is_short():
    """1000 of capital hold 40 at 100 on a fifth of margin; at 90 equity is 600, margin 720: 120 short, 18 a piece, so 26.667 go."""
    t, e, still = simulate(bars_of([(100, 101, 99, 100), (100, 101, 99, 100), (98, 99, 90, 95)]), at(0, lambda b: b.entry("L", LONG, 40)), Config(initial_capital=1000, margin_long=20))
    assert [(x["exit_id"], x["exit_price"]) for x in t] == [("Margin call", 90)] and t[0]["size"] == pytest.approx(4 * 120 / 18)
    assert [x["size"] for x in still] == [pytest.approx(40 - 4 * 120 / 18)]


def test_a_partial_exit_closes_its_part_once():
    def script(bar, b):
        if bar["bar_index"] == 0:
            b.entry("L", LONG, 8)
        b.exit("Half", "L", limit=110.0, qty_percent=50)
        b.exit("Two", "L", limit=112.0, qty=2)

    t, e, still = simulate(bars_of([(100, 101, 99, 100), (100, 101, 99, 100), (105, 113, 104, 112), (112, 114, 111, 113), (113, 115, 112, 114)]), script, Config())
    assert sorted((x["exit_id"], x["size"], x["exit_bar_index"]) for x in t) == [("Half", 4, 2), ("Two", 2, 2)] and [x["size"] for x in still] == [2]


def test_close_takes_part_of_the_lots_of_its_time_and_their_exits():
    def script(bar, b):
        if bar["bar_index"] == 0:
            b.entry("L", LONG, 4)
            b.exit("X", "L", stop=90.0)
        if bar["bar_index"] == 1:
            b.close("L", qty=1)
        if bar["bar_index"] == 2:
            b.close("L", qty_percent=50)
            b.entry("S", SHORT, 1)

    t, e, still = simulate(bars_of([(100, 101, 99, 100)] * 3 + [(100, 101, 80, 100)] * 2), script, Config())
    assert [(x["exit_id"], x["size"]) for x in t] == [("close_L", 1), ("close_L", 1.5), ("S", 1.5)] and [x["size"] for x in still] == [-2.5]


def test_risk_rules_stop_entries_and_leave_positions():
    def script(bar, b):
        b.risk = {"max_drawdown_percent": 2.0}
        if bar["bar_index"] in (0, 2):
            b.entry(f"L{bar['bar_index']}", LONG)

    rows = [(100, 101, 99, 100), (100, 101, 96, 97), (97, 98, 96, 97), (97, 98, 96, 97)]
    t, e, still = simulate(bars_of(rows), script, Config(initial_capital=100, pyramiding=5, margin_long=10))
    assert t == [] and [x["entry_id"] for x in still] == ["L0"]

    def loses(bar, b):
        b.risk = {"max_cons_loss_days": 2}
        b.close("D") if b.lots else b.entry("D", LONG)

    rows = [(100 - 2 * k, 101 - 2 * k, 98 - 2 * k, 99 - 2 * k) for k in range(12)]
    t, _, still = simulate(bars_of(rows), loses, Config())
    assert 2 <= len(t) + len(still) <= 3


def test_a_partial_exit_counts_anew_for_each_position():
    """Half goes at 110 of the first position; closed and entered again on one bar, the second gives half at 112 too."""

    def script(bar, b):
        k = bar["bar_index"]
        if k in (0, 2):
            b.entry("L", LONG, 2)
        if k == 2:
            b.close("L")
        b.exit("X", "L", qty=1.0, limit=110.0)

    t, _, still = simulate(bars_of([(100, 101, 99, 100), (100, 101, 99, 100), (105, 111, 104, 106), (106, 112, 105, 107), (107, 108, 106, 107)]), script, Config(pyramiding=2))
    assert [(x["exit_id"], x["exit_bar_index"], x["size"]) for x in t] == [("X", 2, 1), ("close_L", 3, 1), ("X", 3, 1)]
    assert [x["size"] for x in still] == [1]


def test_days_of_loss_are_those_of_closed_trades():
    """Fees of entries are no losing days; a day that makes nothing less ends the streak."""

    def enters(bar, b):
        b.risk = {"max_cons_loss_days": 2}
        b.entry(f"L{bar['bar_index']}", LONG)

    _, _, still = simulate(bars_of([(100, 101, 99, 100)] * 6), enters, Config(commission_value=0.1, pyramiding=9))
    assert len(still) == 5
    b = Broker(Config())
    for i, (bar, price) in enumerate(zip(bars_of([(100, 101, 99, 100)] * 5), (99, 99, 101, 99, 98), strict=True)):
        b.step(i, bar)
        b._open("L", LONG, 1, 100)
        b._close(1, price, "out")
        assert b.loss_days == (1, 2, 0, 1, 2)[i]


def test_a_level_on_the_wrong_side_is_none_unless_renewed():
    once, _ = run([(100, 101, 99, 100)] * 5, lambda bar, b: (b.entry("L", LONG), b.exit("X", "L", stop=130.0)) if bar["bar_index"] == 0 else None)
    assert once == []

    def renews(bar, b):
        if bar["bar_index"] == 0:
            b.entry("L", LONG)
        b.exit("X", "L", stop=130.0)

    t, _ = run([(100, 101, 99, 100)] * 5, renews)
    assert [(x["exit_id"], x["exit_price"]) for x in t] == [("X", 100)]


def test_losses_of_a_day_in_percent_of_the_capital():
    def script(bar, b):
        b.risk = {"max_intraday_loss_percent": 1.0}
        b.close("L") if b.lots else b.entry("L", LONG)

    t, _, still = simulate(bars_of([(100 - k, 101 - k, 98 - k, 99 - k) for k in range(12)]), script, Config(initial_capital=200))
    assert len(t) == 2 and still == []  # each loses 1 of 200


def run(rows, script, **config):
    return simulate(bars_of(rows), script, Config(**config))[:2]


def at(n, then):
    return lambda bar, b: then(b) if bar["bar_index"] == n else None


def test_market_orders_fill_on_the_next_open():
    t, _ = run([(10, 11, 9, 10), (12, 13, 11, 12), (15, 16, 14, 15)], lambda bar, b: b.entry("L", LONG) if bar["bar_index"] == 0 else b.close("L"))
    assert (t[0]["entry_price"], t[0]["entry_bar_index"], t[0]["exit_price"]) == (12, 1, 15)


def test_stop_fills_at_the_worse_of_open_and_stop():
    b = Broker(Config())
    for i, bar in enumerate(bars_of([(10, 11, 9, 10), (14, 15, 13, 14)])):
        b.step(i, bar)
        if i == 0:
            b.entry("L", LONG, stop=12.0)
    assert b.lots[0].price == 14


def test_both_levels_within_a_bar_follow_the_path():
    def script(bar, b):
        if bar["bar_index"] == 0:
            b.entry("L", LONG)
        b.exit("X", "L", limit=110.0, stop=90.0)

    near_high, _ = run([(100, 101, 99, 100), (100, 101, 99, 100), (105, 111, 89, 100)], script)
    near_low, _ = run([(100, 101, 99, 100), (100, 101, 99, 100), (95, 111, 89, 100)], script)
    assert near_high[0]["exit_price"] == 110 and near_low[0]["exit_price"] == 90


def test_gap_through_a_stop_fills_at_the_open():
    def script(bar, b):
        if bar["bar_index"] == 0:
            b.entry("L", LONG)
        b.exit("X", "L", stop=90.0)

    t, _ = run([(100, 101, 99, 100), (100, 101, 99, 100), (80, 85, 79, 84)], script)
    assert t[0]["exit_price"] == 80


def test_reversal_closes_and_opens():
    def script(bar, b):
        if bar["bar_index"] == 0:
            b.entry("L", LONG, 2)
        if bar["bar_index"] == 2:
            b.entry("S", SHORT, 3)

    t, e = run([(10, 11, 9, 10)] * 5, script)
    assert t[0]["size"] == 2 and t[0]["exit_id"] == "S" and e[-1]["position_size"] == -3


def test_commission_leaves_gross_loss_when_the_trade_closes():
    t, e = run([(100, 101, 99, 100), (100, 101, 99, 100), (110, 111, 109, 110), (110, 111, 109, 110)], lambda bar, b: b.entry("L", LONG) if bar["bar_index"] == 0 else b.close("L"), commission_value=1.0)
    assert t[0]["profit"] == pytest.approx(10 - 1 - 1.1)
    assert e[1]["gross_loss"] == pytest.approx(1.0) and e[-1]["gross_loss"] == pytest.approx(0.0) and e[-1]["net_profit"] == pytest.approx(7.9)


def test_short_margin_call_takes_four_times_the_cover():
    rows = [(80_000, 80_100, 79_900, 80_000)] * 2 + [(80_000, 80_000, 80_000, 80_000), (81_000, 100_000, 80_900, 90_000)]
    t, e = run(rows, at(0, lambda b: b.entry("S", SHORT, 5)), initial_capital=575_000, margin_short=100)
    assert [x["exit_id"] for x in t] == ["Margin call"]
    assert t[0]["size"] == pytest.approx(-1.0) and t[0]["exit_price"] == 100_000


def test_flat_run_has_metrics(spark):
    df = spark.createDataFrame([("x", r["bar_index"], r["time"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in bars_of([(10, 11, 9, 10)] * 3)], "symbol string, bar_index int, time timestamp_ntz, open double, high double, low double, close double, volume double")
    nothing = lambda bar, b: None
    t = backtest(df, nothing)
    got = metrics(t, backtest(df, nothing, want="equity")).first()
    assert (got.closed_trades, got.net_profit, got.sharpe) == (0, 0, 0)
    assert merged_fills(t).count() == 0
