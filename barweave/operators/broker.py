"""Backtests: an ordered fold over one symbol's bars that fills orders and keeps a ledger.

A strategy is a function of (bar, broker), called once a bar after the broker has worked on the orders
of earlier bars, so what it orders on a bar is filled from the next one on. ``backtest`` runs one fold
for each (symbol, parameter set); sweeps are as parallel as they have pairs. Trades and per-bar equity
come out as rows, and run metrics are aggregates over them.

Within a bar: lots' excursions, entries (market at the open; a limit at its price when touched; a stop at
the worse of open and stop), a margin check at the open, then exits and the margin check at the adverse
extreme in the order of the assumed path. The path goes to the high first if the open is nearer to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

TINY = 1e-9
LONG, SHORT = 1, -1


@dataclass
class Config:
    initial_capital: float = 100_000.0
    pyramiding: int = 1
    default_qty_type: str = "fixed"  # or cash, percent_of_equity
    default_qty_value: float = 1.0
    commission_type: str = "percent"  # or cash_per_contract, cash_per_order
    commission_value: float = 0.0
    slippage: int = 0
    margin_long: float = 100.0
    margin_short: float = 100.0
    pointvalue: float = 1.0
    mintick: float = 0.01
    risk_free_rate: float = 2.0


@dataclass
class Lot:
    entry_id: str
    size: float
    price: float
    bar: int
    time: object
    fee: float
    worst: float = 0.0
    best: float = 0.0

    @property
    def side(self) -> int:
        return 1 if self.size > 0 else -1


@dataclass
class Order:
    id: str
    side: int
    qty: float
    limit: float | None
    stop: float | None
    bar: int


@dataclass
class Exit:
    id: str
    from_entry: str
    bar: int
    terms: dict = field(default_factory=dict)
    armed: bool = False
    peak: float = math.nan
    left: float | None = None  # of a partial exit, what it may still close of the lots it met
    met: list[Lot] = field(default_factory=list)  # the lots there were when it was looked at last
    called: int = -1  # the bar of the last call, and whether the bar before had one too
    steady: bool = False


class Broker:
    def __init__(self, config: Config):
        self.config = c = config
        self.lots: list[Lot] = []
        self.trades: list[dict] = []
        self.orders: list[Order] = []
        self.exits: list[Exit] = []
        self.closes: list[tuple[str | None, list[Lot], float, bool]] = []
        self.net = self.gross_profit = self.gross_loss = 0.0
        self.equity_peak = self.trough = c.initial_capital
        self.max_drawdown = self.max_drawdown_percent = self.max_runup = self.max_runup_percent = 0.0
        self.held = {"all": 0.0, "long": 0.0, "short": 0.0}
        #: Rules that stop new entries, each by its name: allow_entry_in, max_position_size, max_drawdown (money),
        #: max_drawdown_percent (of the equity's peak), max_intraday_loss (money), max_intraday_loss_percent (of the initial
        #: capital), max_cons_loss_days (days of closed trades that lost, without one between that did not).
        self.risk: dict = {}
        self.halted = False
        self.day, self.day_profit, self.lost_before = None, 0.0, 0
        self.locked: Lot | None | bool = False
        self.late: tuple[float, float, object, int] | None = None
        self.index, self.bar = -1, {}

    # --- what a strategy sees ---

    @property
    def position_size(self) -> float:
        return sum(x.size for x in self.lots)

    @property
    def position_avg_price(self) -> float:
        q = sum(abs(x.size) for x in self.lots)
        return sum(abs(x.size) * x.price for x in self.lots) / q if q else math.nan

    @property
    def loss_days(self) -> int:
        """How many of the last days on which trades closed lost, without one between that did not."""
        return self.lost_before + 1 if self.day_profit < 0 else 0

    def open_profit(self, price: float) -> float:
        return sum((price - x.price) * x.size for x in self.lots) * self.config.pointvalue

    def equity(self, price: float | None = None) -> float:
        return self.config.initial_capital + self.net + self.open_profit(self.bar["close"] if price is None else price)

    def default_entry_qty(self, price: float) -> float:
        c = self.config
        if c.default_qty_type == "cash":
            q = c.default_qty_value / (price * c.pointvalue)
        elif c.default_qty_type == "percent_of_equity":
            q = self.equity() * c.default_qty_value / 100 / (price * c.pointvalue)
        else:
            q = c.default_qty_value
        return math.trunc(q * 1e6) / 1e6

    def margin_liquidation_price(self) -> float:
        """Where equity equals the margin held; na when flat or when there is none."""
        size, c = self.position_size, self.config
        if not size:
            return math.nan
        m = (c.margin_long if size > 0 else c.margin_short) / 100
        den = (size - abs(size) * m) * c.pointvalue
        if abs(den) < TINY:
            return math.nan
        price = (sum(x.size * x.price for x in self.lots) * c.pointvalue - c.initial_capital - self.net) / den
        ticks = price / c.mintick
        return (math.floor(ticks) if size > 0 else math.ceil(ticks)) * c.mintick

    def open_trades(self) -> list[dict]:
        """The lots held, their profit at the bar's close."""
        close, q = self.bar.get("close", math.nan), self.config.pointvalue
        return [{"entry_id": x.entry_id, "entry_price": x.price, "entry_bar_index": x.bar, "entry_time": x.time, "size": x.size, "profit": (close - x.price) * x.size * q - x.fee, "commission": x.fee, "max_drawdown": x.worst, "max_runup": x.best} for x in self.lots]

    # --- what a strategy asks for ---

    def _snap(self, price: float | None, up: bool) -> float | None:
        if price is None or math.isnan(price):
            return None
        t = price / self.config.mintick
        t = round(t) if abs(t - round(t)) < 1e-6 else math.ceil(t) if up else math.floor(t)
        return t * self.config.mintick

    def entry(self, id: str, side: int, qty: float | None = None, limit: float | None = None, stop: float | None = None) -> None:
        """Opens or adds, up to the pyramiding cap, which counts what is queued; against the position it reverses."""
        close = self.bar["close"]
        limit, stop = (self._snap(p, p is not None and p > close) for p in (limit, stop))
        self.orders = [o for o in self.orders if o.id != id]
        position = self.position_size
        same = sum(x.side == side for x in self.lots) + sum(o.side == side and o.bar == self.index and o.limit is None and o.stop is None for o in self.orders)
        if same >= self.config.pyramiding and position * side >= 0:
            return
        q = self.default_entry_qty(close) if qty is None else qty
        if position * side < 0:
            q += abs(position)
        self.orders.append(Order(id, side, q, limit, stop, self.index))

    def order(self, id: str, side: int, qty: float | None = None, limit: float | None = None, stop: float | None = None) -> None:
        """As it stands: no cap, no reversal, no snapping."""
        self.orders = [o for o in self.orders if o.id != id]
        self.orders.append(Order(id, side, self.default_entry_qty(self.bar["close"]) if qty is None else qty, limit, stop, self.index))

    def exit(self, id: str, from_entry: str = "", **terms: float) -> None:
        """Terms: limit, stop (prices), profit, loss (ticks), trail_price or trail_points with trail_offset (ticks), and qty or qty_percent of the position, all by default. Renewed each bar, it stays armed; what it has closed of a position counts until the position is gone. Of an exit that is not renewed each bar, a limit or stop on the wrong side of the entries' mean price is no level."""
        for x in self.exits:
            if (x.id, x.from_entry) == (id, from_entry):
                x.terms, x.steady, x.called = terms, self.index - x.called <= 1, self.index
                return
        if any(not from_entry or y.entry_id == from_entry for y in self.lots) or any(not from_entry or o.id == from_entry for o in self.orders):
            self.exits.append(Exit(id, from_entry, self.index, terms, called=self.index))

    def close(self, id: str, immediately: bool = False, qty: float | None = None, qty_percent: float | None = None) -> None:
        """The lots of this entry as they are now, or so much of them, at the next open; its exits go."""
        lots = [x for x in self.lots if x.entry_id == id]
        if lots:
            held = sum(abs(x.size) for x in lots)
            self.exits = [x for x in self.exits if x.from_entry != id]
            self.closes.append((id, lots, qty if qty is not None else held * qty_percent / 100 if qty_percent is not None else math.inf, immediately))

    def close_all(self, immediately: bool = False) -> None:
        if self.lots:
            self.closes.append((None, list(self.lots), math.inf, immediately))

    def cancel(self, id: str) -> None:
        self.orders = [o for o in self.orders if o.id != id]
        self.exits = [x for x in self.exits if x.id != id]

    def cancel_all(self) -> None:
        """Entries; exits survive."""
        self.orders = []

    # --- the ledger ---

    def _fee(self, qty: float, price: float) -> float:
        c = self.config
        if c.commission_type == "cash_per_contract":
            return c.commission_value * qty
        if c.commission_type == "cash_per_order":
            return c.commission_value
        return c.commission_value / 100 * qty * price * c.pointvalue

    def _open(self, id: str, side: int, qty: float, price: float, fee: float | None = None) -> None:
        fee = self._fee(qty, price) if fee is None else fee
        self.net -= fee
        self.gross_loss += fee
        lot = Lot(id, side * qty, price, self.index, self.bar["time"], fee)
        lot.worst = max(0.0, (price - (self.bar["low"] if side > 0 else self.bar["high"])) * side) * qty * self.config.pointvalue + fee
        self.lots.append(lot)
        size = self.position_size
        for k, v in (("all", abs(size)), ("long", size), ("short", -size)):
            self.held[k] = max(self.held[k], v)

    def _close(self, qty: float, price: float, exit_id: str, only: Callable[[Lot], bool] = lambda x: True, share: float = 1.0) -> float:
        """Takes qty from the oldest lots that qualify; what is left over comes back."""
        total = min(qty, sum(abs(x.size) for x in self.lots if only(x)))
        for lot in list(self.lots):
            if qty <= TINY:
                break
            if not only(lot):
                continue
            part = min(abs(lot.size), qty)
            ratio = part / abs(lot.size)
            c = self.config
            fee_out = (c.commission_value * part / total if c.commission_type == "cash_per_order" else self._fee(part, price)) * share
            fee_in = lot.fee * ratio
            gain = (price - lot.price) * lot.side * part * c.pointvalue
            profit = gain - fee_in - fee_out
            self.net += gain - fee_out
            self.gross_loss -= fee_in
            if profit > 0:
                self.gross_profit += profit
            else:
                self.gross_loss -= profit
            self.trades.append(
                {"entry_id": lot.entry_id, "entry_price": lot.price, "entry_bar_index": lot.bar, "entry_time": lot.time, "exit_id": exit_id, "exit_price": price, "exit_bar_index": self.index, "exit_time": self.bar["time"], "size": part * lot.side, "profit": profit, "commission": fee_in + fee_out, "max_drawdown": lot.worst * ratio, "max_runup": lot.best * ratio}
            )
            if self.bar["time"].date() != self.day:
                self.lost_before, self.day, self.day_profit = self.loss_days, self.bar["time"].date(), 0.0
            self.day_profit += profit
            qty -= part
            if ratio >= 1 - TINY:
                self.lots.remove(lot)
            else:
                lot.size -= part * lot.side
                lot.fee -= fee_in
                lot.worst, lot.best = lot.worst * (1 - ratio), lot.best * (1 - ratio)
        return qty

    def _margin(self, side: int, qty: float, price: float) -> float:
        c = self.config
        return qty * price * c.pointvalue * (c.margin_long if side > 0 else c.margin_short) / 100

    def _margin_call(self, price: float, extreme: bool) -> None:
        size = self.position_size
        if abs(size) <= TINY:
            return
        side, c = (1 if size > 0 else -1), self.config
        short_of = self._margin(side, abs(size), price) - self.equity(price)
        each = self._margin(side, 1, price)
        if short_of <= 0 or each <= 0:
            return
        qty, front = min(abs(size), 4 * short_of / each), self.lots[0]
        front_qty = abs(front.size)
        self._close(qty, price, "Margin call")
        if extreme and qty >= front_qty - TINY and self.lots:
            rest = short_of - self._margin(side, front_qty, price) + front_qty * (price - front.price) * side * c.pointvalue
            cover = math.trunc(rest / each * 1e6) / 1e6
            if rest > 0 and min(abs(self.position_size), 4 * cover) > TINY:
                self.late = (min(abs(self.position_size), 4 * cover), self.bar["close"], self.bar["time"], side)
        self.locked = self.lots[0] if self.lots else None

    # --- one bar ---

    def step(self, index: int, bar: dict) -> None:
        o, h, low = bar["open"], bar["high"], bar["low"]
        if self.late:
            qty, price, _, side = self.late
            self.late = None
            if self.position_size * side > 0:
                self._close(qty, price, "Margin call")
                self.orders = [x for x in self.orders if x.side != side]
        self.index, self.bar, self.locked = index, bar, False
        for lot in self.lots:
            q = abs(lot.size) * self.config.pointvalue
            against, favour = ((lot.price - low) if lot.side > 0 else (h - lot.price)) * q, ((h - lot.price) if lot.side > 0 else (lot.price - low)) * q
            lot.worst, lot.best = max(lot.worst, max(0.0, against) + lot.fee), max(lot.best, max(0.0, favour - lot.fee))
        self._closes(o)
        self._entries(o, h, low)
        self._margin_call(o, False)
        side = 1 if self.position_size > 0 else -1
        to_high = abs(h - o) <= abs(o - low)
        favourable = to_high if side > 0 else not to_high
        extreme = low if side > 0 else h
        if not favourable:
            self._margin_call(extreme, True)
        self._brackets(bar, to_high)
        if favourable:
            self._margin_call(low if self.position_size > 0 else h, True)
        self._latch(bar)

    def after_script(self) -> None:
        """Closes that are to happen on the bar's own close."""
        now, self.closes = [c for c in self.closes if c[3]], [c for c in self.closes if not c[3]]
        self._close_lots(now, self.bar["close"])

    def _close_lots(self, closes: list, price: float) -> None:
        for id, lots, qty, _ in closes:
            self._close(qty, price, f"close_{id}" if id else "close_all", lambda x, some=lots: any(x is y for y in some))

    def _slipped(self, price: float, side: int) -> float:
        return price + side * self.config.slippage * self.config.mintick

    def _closes(self, price: float) -> None:
        closes, self.closes = self.closes, []
        self._close_lots(closes, self._slipped(price, -1 if self.position_size > 0 else 1))

    def _entries(self, o: float, h: float, low: float) -> None:
        for order in list(self.orders):
            price = None
            if order.limit is not None and order.stop is not None:
                continue  # a stop with a limit is kept and never filled
            if order.limit is not None:
                price = order.limit if (low <= order.limit if order.side > 0 else h >= order.limit) else None
            elif order.stop is not None:
                if h >= order.stop if order.side > 0 else low <= order.stop:
                    price = max(o, order.stop) if order.side > 0 else min(o, order.stop)
            else:
                price = o
            if price is None:
                continue
            self.orders.remove(order)
            size = self.position_size
            allowed, largest = self.risk.get("allow_entry_in"), self.risk.get("max_position_size", math.inf)
            if self.halted or allowed not in (None, "all", "long" if order.side > 0 else "short") or abs(size + order.side * order.qty) > largest:
                continue
            price = self._slipped(price, order.side)
            against = size * order.side < 0
            fresh = max(0.0, order.qty - abs(size)) if against else order.qty
            held = self._margin(order.side, abs(size), o) if size * order.side > 0 else 0.0
            if fresh > 0 and self._margin(order.side, fresh, price) > self.equity(o) - held:
                if against:
                    self._close(min(abs(size), order.qty), price, order.id)
                continue
            flat = self.config.commission_type == "cash_per_order" and against and fresh > 0
            if against:
                self._close(min(abs(size), order.qty), price, order.id, share=0.5 if flat else 1.0)
            if fresh > TINY:
                self._open(order.id, order.side, fresh, price, self.config.commission_value / 2 if flat else None)

    def _brackets(self, bar: dict, to_high: bool) -> None:
        o, h, low, close = bar["open"], bar["high"], bar["low"], bar["close"]
        tick = self.config.mintick
        for x in list(self.exits):
            lots = [y for y in self.lots if not x.from_entry or y.entry_id == x.from_entry]
            if not lots:
                if not any(not x.from_entry or q.id == x.from_entry for q in self.orders):
                    self.exits.remove(x)
                continue
            if not any(y is z for y in lots for z in x.met):  # another position than the one it was armed and counted for
                x.left, x.armed, x.peak = None, False, math.nan
            x.met = lots
            side, t = lots[0].side, x.terms
            if not x.steady:
                mean = sum(abs(y.size) * y.price for y in lots) / sum(abs(y.size) for y in lots)
                t = {k: v for k, v in t.items() if v is None or k not in ("limit", "stop") or (v - mean) * side * (1 if k == "limit" else -1) > 0}
            if x.left is None and (t.get("qty") is not None or t.get("qty_percent") is not None):
                x.left = t["qty"] if t.get("qty") is not None else sum(abs(y.size) for y in lots) * t["qty_percent"] / 100
            if x.left is not None and x.left <= TINY:
                continue
            good, bad = (h, low) if side > 0 else (low, h)
            first = to_high if side > 0 else not to_high
            gains: list[tuple[float, Lot]] = []
            losses: list[tuple[float, Lot]] = []
            for lot in lots:
                if self.locked is not False and lot is not self.locked:
                    continue
                tp = t["limit"] if t.get("limit") is not None else lot.price + side * t["profit"] * tick if t.get("profit") is not None else None
                sl = t["stop"] if t.get("stop") is not None else lot.price - side * t["loss"] * tick if t.get("loss") is not None else None
                up, down = tp is not None and (good - tp) * side >= 0, sl is not None and (sl - bad) * side >= 0
                gapped = down and (sl - o) * side >= 0
                if down and gapped and side < 0 and lot.bar == self.index:
                    down = False  # a buy stop already passed at the open spares what was sold at that open
                if up and (first or not down):
                    gains.append((o if (o - tp) * side >= 0 else tp, lot))
                elif down:
                    losses.append((o if gapped else sl, lot))
            trail = self._trail(x, lots, side, good, bad, close, first) if self.locked is False else None
            gains.sort(key=lambda g: g[0] * side)
            losses.sort(key=lambda g: -g[0] * side)
            rest = [(trail, y) for y in lots] if trail is not None else []
            for price, lot in [*gains, *losses, *rest] if first else [*losses, *rest, *gains]:
                if any(lot is y for y in self.lots):
                    part = abs(lot.size) if x.left is None else min(abs(lot.size), x.left)
                    self._close(part, price, x.id, lambda y, z=lot: y is z)
                    x.left = None if x.left is None else x.left - part

    def _trail(self, x: Exit, lots: list[Lot], side: int, good: float, bad: float, close: float, first: bool) -> float | None:
        """The price at which a trailing stop fires on this bar."""
        t, tick = x.terms, self.config.mintick
        if t.get("trail_offset") is None:
            return None
        better = max if side > 0 else min
        fresh = False
        if not x.armed:
            entry = sum(abs(y.size) * y.price for y in lots) / sum(abs(y.size) for y in lots)
            level = t["trail_price"] if t.get("trail_price") is not None else entry + side * t["trail_points"] * tick if t.get("trail_points") is not None else None
            if level is None or (good - level) * side < 0:
                return None
            x.armed, x.peak, fresh = True, good, True

        def trigger() -> float:
            return x.peak - side * t["trail_offset"] * tick

        if not fresh and not first:
            old = trigger()
            if (old - bad) * side >= 0:  # the adverse leg comes before any new peak
                return old
        if not fresh:
            x.peak = better(x.peak, good)
        at = trigger()
        return at if (at - (bad if first else close)) * side >= 0 else None

    def _latch(self, bar: dict) -> None:
        """Peaks of realised equity, and the worst and best excursion from them within the bar."""
        real = self.config.initial_capital + self.net
        base = real + sum(x.fee for x in self.lots)
        self.equity_peak, self.trough = max(self.equity_peak, base), min(self.trough, base)
        size, mean, q = self.position_size, self.position_avg_price, self.config.pointvalue
        worst = best = 0.0
        if size:
            worst = size * (mean - (bar["low"] if size > 0 else bar["high"])) * q
            best = size * ((bar["high"] if size > 0 else bar["low"]) - mean) * q
        down, up = self.equity_peak - real + worst, real + best - self.trough
        if down > self.max_drawdown:
            self.max_drawdown = down
            if self.equity_peak > 0:
                self.max_drawdown_percent = max(self.max_drawdown_percent, 100 * down / self.equity_peak)
        if up > self.max_runup:
            self.max_runup = up
            if real + best > 0:
                self.max_runup_percent = max(self.max_runup_percent, 100 * up / (real + best))
        r = self.risk
        if "max_drawdown" in r and self.max_drawdown >= r["max_drawdown"] or "max_drawdown_percent" in r and self.max_drawdown >= r["max_drawdown_percent"] / 100 * self.equity_peak:
            self.halted = True
        most = [r[k] * scale for k, scale in (("max_intraday_loss", 1), ("max_intraday_loss_percent", self.config.initial_capital / 100)) if k in r]
        if most and self.gross_loss >= min(most) or "max_cons_loss_days" in r and self.loss_days >= r["max_cons_loss_days"]:
            self.halted = True


TRADE = "entry_id string, entry_price double, entry_bar_index int, entry_time timestamp_ntz, exit_id string, exit_price double, exit_bar_index int, exit_time timestamp_ntz, size double, profit double, commission double, max_drawdown double, max_runup double"
EQUITY = "bar_index int, time timestamp_ntz, close double, equity double, net_profit double, open_profit double, gross_profit double, gross_loss double, position_size double, max_drawdown double, max_drawdown_percent double, max_runup double, max_runup_percent double, held_long double, held_short double, entry_name string"
OPEN = "entry_id string, entry_price double, entry_bar_index int, entry_time timestamp_ntz, size double, profit double, commission double, max_drawdown double, max_runup double"


def simulate(bars: list[dict], script: Callable[[dict, Broker], None], config: Config) -> tuple[list[dict], list[dict], list[dict]]:
    """Trades, equity, and the lots still open of one run over bars in order."""
    broker, equity = Broker(config), []
    for i, bar in enumerate(bars):
        broker.step(i, bar)
        script(bar, broker)
        broker.after_script()
        equity.append({"bar_index": i, "time": bar["time"], "close": bar["close"], "equity": broker.equity(), "net_profit": broker.net, "open_profit": broker.open_profit(bar["close"]), "gross_profit": broker.gross_profit, "gross_loss": broker.gross_loss, "position_size": broker.position_size, "max_drawdown": broker.max_drawdown, "max_drawdown_percent": broker.max_drawdown_percent, "max_runup": broker.max_runup, "max_runup_percent": broker.max_runup_percent, "held_long": broker.held["long"], "held_short": broker.held["short"], "entry_name": broker.lots[0].entry_id if broker.lots else None})
    return broker.trades, equity, broker.open_trades()


def backtest(bars: DataFrame, script: Callable[[dict, Broker], None], config: Config = Config(), keys: tuple[str, ...] = ("symbol",), want: str = "trades") -> DataFrame:
    """bars (with the columns script reads; NULL comes as None) folded for each value of keys: rows of trades, of equity, or of the trades still open ("open")."""
    ship(bars.sparkSession)
    kind = {"trades": TRADE, "equity": EQUITY, "open": OPEN}[want]
    names = [x.strip().split(" ")[0] for x in kind.split(",")]

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("bar_index").to_pylist()
        made = simulate(rows, script, config)[("trades", "equity", "open").index(want)]
        types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "timestamp_ntz": pa.timestamp("us")}
        cells = {k: pa.array([rows[0][k]] * len(made), t.schema.field(k).type) for k in keys}
        for part in kind.split(","):
            n, y = part.split()
            cells[n] = pa.array([m[n] for m in made], types[y])
        return pa.table(cells)

    head = ", ".join(f"`{k}` {bars.schema[k].dataType.simpleString()}" for k in keys)
    assert not set(keys) & set(names)
    return bars.groupBy(*keys).applyInArrow(run, f"{head}, {kind}")


def metrics(trades: DataFrame, equity: DataFrame, config: Config = Config(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each run. Ratios of returns are monthly and not annualised; an infinite profit factor is NULL."""
    p, notional = F.col("profit"), F.abs("size") * F.col("entry_price") * config.pointvalue
    won, lost = p > 0, p < 0
    t = trades.groupBy(*keys).agg(
        F.count("*").alias("closed_trades"),
        F.count(F.when(won, 1)).alias("winning_trades"),
        F.count(F.when(lost, 1)).alias("losing_trades"),
        F.count(F.when(p == 0, 1)).alias("even_trades"),
        F.avg(p).alias("avg_trade"),
        F.avg(F.when(won, p)).alias("avg_winning_trade"),
        F.avg(F.when(lost, -p)).alias("avg_losing_trade"),
        F.avg(100 * p / notional).alias("avg_trade_percent"),
        F.avg(F.when(won, 100 * p / notional)).alias("avg_winning_trade_percent"),
        F.avg(F.when(lost, -100 * p / notional)).alias("avg_losing_trade_percent"),
        F.avg(100 * (F.col("exit_price") / F.col("entry_price") - 1) * F.signum("size")).alias("avg_price_move_percent"),
        F.avg(100 * p / (notional + F.col("commission") / 2)).alias("avg_closed_trade_percent"),
        F.max(p).alias("largest_winning_trade"),
        F.max(-p).alias("largest_losing_trade"),
        F.avg(F.col("exit_bar_index") - F.col("entry_bar_index")).alias("avg_bars_in_trade"),
        F.sum("commission").alias("commission_paid"),
    )
    last = F.max_by(F.struct("equity", "net_profit", "open_profit", "gross_profit", "gross_loss", "max_drawdown", "max_drawdown_percent", "max_runup", "max_runup_percent"), "bar_index").alias("z")
    e = equity.groupBy(*keys).agg(last, F.max(F.abs("position_size")).alias("max_contracts_held"), F.max("held_long").alias("max_contracts_held_long"), F.max("held_short").alias("max_contracts_held_short"), F.min_by("close", "bar_index").alias("first_close"), F.max_by("close", "bar_index").alias("last_close"), F.min("time").alias("t0"), F.max("time").alias("t1"))
    w = Window.partitionBy(*keys).orderBy("month")
    month = equity.groupBy(*keys, F.date_trunc("month", "time").alias("month")).agg(F.max_by("equity", "bar_index").alias("m"))
    month = month.withColumn("r", F.try_divide(F.col("m"), F.coalesce(F.lag("m").over(w), F.lit(config.initial_capital))) - 1 - config.risk_free_rate / 1200)
    month = month.groupBy(*keys).agg(F.count("*").alias("months"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.sqrt(F.avg(F.least(F.col("r"), F.lit(0.0)) ** 2)).alias("dd"))
    days = (F.unix_timestamp("t1") - F.unix_timestamp("t0")) / 86_400
    capital = F.lit(config.initial_capital)
    n = F.coalesce("closed_trades", F.lit(0))
    rate = F.coalesce(F.try_divide(F.col("winning_trades"), n), F.lit(0.0))
    loss_rate = F.coalesce(F.try_divide(F.col("losing_trades"), n), F.lit(0.0))
    return e.join(t, list(keys), "left").join(month, list(keys), "left").select(
        *keys,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("closed_trades", "winning_trades", "losing_trades", "even_trades")],
        *[F.col(f"z.{c}").alias(c) for c in ("equity", "net_profit", "open_profit", "gross_profit", "gross_loss", "max_drawdown", "max_drawdown_percent", "max_runup", "max_runup_percent")],
        (100 * F.col("z.net_profit") / capital).alias("net_profit_percent"),
        (100 * F.col("z.gross_profit") / capital).alias("gross_profit_percent"),
        (100 * F.col("z.gross_loss") / capital).alias("gross_loss_percent"),
        (100 * F.col("z.open_profit") / capital).alias("open_profit_percent"),
        F.try_divide(F.col("z.gross_profit"), F.when(F.col("z.gross_loss") > TINY, F.col("z.gross_loss"))).alias("profit_factor"),
        (100 * rate).alias("percent_profitable"),
        (rate * F.coalesce("avg_winning_trade", F.lit(0.0)) - loss_rate * F.coalesce("avg_losing_trade", F.lit(0.0))).alias("expectancy"),
        "avg_trade", "avg_winning_trade", "avg_losing_trade", "avg_trade_percent", "avg_winning_trade_percent", "avg_losing_trade_percent", "avg_price_move_percent", "avg_closed_trade_percent", "largest_winning_trade", "largest_losing_trade", "avg_bars_in_trade", "commission_paid", "max_contracts_held", "max_contracts_held_long", "max_contracts_held_short",
        F.when((F.col("months") >= 2) & (F.col("sd") > 0), F.col("mean") / F.col("sd")).otherwise(0.0).alias("sharpe"),
        F.when((F.col("months") >= 2) & (F.col("dd") > 0), F.col("mean") / F.col("dd")).otherwise(0.0).alias("sortino"),
        F.when((days >= 1) & (capital + F.col("z.net_profit") > 0), 100 * (F.pow((capital + F.col("z.net_profit")) / capital, 365 / days) - 1)).otherwise(0.0).alias("cagr"),
        (100 * (F.col("last_close") / F.col("first_close") - 1)).alias("buy_and_hold_percent"),
    )


def merged_fills(trades: DataFrame) -> DataFrame:
    """Executions by (symbol, time, side, label): entries and exits of one moment as one, with the sum of their quantities."""
    one = trades.select("symbol", F.col("entry_time").alias("time"), F.signum("size").alias("side"), F.col("entry_id").alias("label"), F.abs("size").alias("qty"), F.col("entry_price").alias("price"), F.lit(1).alias("entry"))
    two = trades.select("symbol", F.col("exit_time").alias("time"), (-F.signum("size")).alias("side"), F.col("exit_id").alias("label"), F.abs("size").alias("qty"), F.col("exit_price").alias("price"), F.lit(0).alias("entry"))
    return one.unionAll(two).groupBy("symbol", "time", "side", "label").agg(F.sum("qty").alias("qty"), F.max_by("price", F.struct("entry", "price")).alias("price"), F.count("*").alias("fills"))


