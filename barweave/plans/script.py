"""A small front end: indicator and strategy scripts as plans over bars.

A script is lines of assignments, tuple assignments, ``plot`` calls, and ``if`` blocks of orders. Every
series call becomes a column of its own, because windows don't nest; columns of one window share its
exchange and sort. Recursive calls become steps of a fold. Lengths must be constants (or inputs). What the
front end doesn't know it refuses by name: loops, functions, user types, ``var`` state, drawing.

    run(bars, 'x = ta.sma(close, 5)\\nplot(ta.crossover(close, x), "up")')
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mathlib as X
from ..functions.params import SOURCES, Inputs
from ..operators import recursive as R
from ..operators import ta
from ..operators.broker import LONG, SHORT, Broker, Config, backtest

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(\"[^\"]*\"|'[^']*')|([A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*)|(:=|==|!=|<=|>=|[-+*/%<>=?:,()\[\]]))")
BINARY = {"or": 1, "and": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


class Unsupported(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, Any]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Unsupported(f"can't read {text[at : at + 20]!r}")
        number, string, name, mark = m.groups()
        if number:
            out.append(("number", float(number) if re.search(r"[.eE]", number) else int(number)))
        elif string:
            out.append(("string", string[1:-1]))
        else:
            out.append(("mark", mark) if mark or name in ("and", "or", "not") and not mark else ("name", name))
            if name in ("and", "or", "not"):
                out[-1] = ("mark", name)
        at = m.end()
    return out


class Parser:
    """Expressions as nested tuples: (kind, ...)."""

    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def peek(self) -> tuple[str, Any]:
        return self.t[self.i] if self.i < len(self.t) else ("end", None)

    def take(self, mark: str | None = None) -> tuple[str, Any]:
        got = self.peek()
        if mark is not None and got != ("mark", mark):
            raise Unsupported(f"expected {mark!r}, found {got[1]!r}")
        self.i += 1
        return got

    def whole(self):
        e = self.ternary()
        if self.peek()[0] != "end":
            raise Unsupported(f"unexpected {self.peek()[1]!r}")
        return e

    def ternary(self):
        e = self.binary(1)
        if self.peek() == ("mark", "?"):
            self.take()
            a = self.ternary()
            self.take(":")
            return ("if", e, a, self.ternary())
        return e

    def binary(self, least: int):
        e = self.unary()
        while self.peek()[0] == "mark" and BINARY.get(self.peek()[1], 0) >= least:
            op = self.take()[1]
            e = ("op", op, e, self.binary(BINARY[op] + 1))
        return e

    def unary(self):
        if self.peek() in (("mark", "-"), ("mark", "not"), ("mark", "+")):
            op = self.take()[1]
            e = self.binary(6) if op != "not" else self.binary(3)
            return e if op == "+" else (op, e)
        return self.after(self.atom())

    def atom(self):
        kind, v = self.take()
        if kind in ("number", "string"):
            return ("const", v)
        if kind == "name":
            if self.peek() == ("mark", "("):
                return self.call(v)
            return ("const", v == "true") if v in ("true", "false") else ("name", v)
        if v == "(":
            e = self.ternary()
            self.take(")")
            return e
        raise Unsupported(f"unexpected {v!r}")

    def call(self, name: str):
        self.take("(")
        args, named = [], {}
        while self.peek() != ("mark", ")"):
            if self.peek()[0] == "name" and self.i + 1 < len(self.t) and self.t[self.i + 1] == ("mark", "="):
                key = self.take()[1]
                self.take("=")
                named[key] = self.ternary()
            else:
                args.append(self.ternary())
            if self.peek() != ("mark", ")"):
                self.take(",")
        self.take(")")
        return ("call", name, args, named)

    def after(self, e):
        while self.peek() == ("mark", "["):
            self.take()
            e = ("past", e, self.ternary())
            self.take("]")
        return e


#: Series calls by name: parameter names, s for a series and n for a constant, then what makes the column.
P = ta.price
CALLS: dict[str, tuple[str, Any]] = {
    **{k: ("s:source n:length", getattr(ta, k)) for k in ("sma", "wma", "stdev", "variance", "dev", "median", "mode", "highest", "lowest", "highestbars", "lowestbars", "roc", "cci", "cog", "percentrank")},
    "range": ("s:source n:length", ta.range_), "change": ("s:source n:length=1", ta.change), "mom": ("s:source n:length", ta.mom), "swma": ("s:source", ta.swma), "cum": ("s:source", ta.cum), "max": ("s:source", ta.max_), "min": ("s:source", ta.min_),
    "vwma": ("s:source n:length", lambda x, n: ta.vwma(x, n, P("volume"))), "alma": ("s:source n:length n:offset=0.85 n:sigma=6", ta.alma), "linreg": ("s:source n:length n:offset=0", ta.linreg), "bbw": ("s:source n:length n:mult", ta.bbw), "correlation": ("s:source1 s:source2 n:length", ta.correlation),
    "stoch": ("s:source s:high s:low n:length", ta.stoch), "wpr": ("n:length", ta.wpr), "cross": ("s:source1 s:source2", ta.cross), "crossover": ("s:source1 s:source2", ta.crossover), "crossunder": ("s:source1 s:source2", ta.crossunder), "barssince": ("s:condition", ta.barssince), "valuewhen": ("s:condition s:source n:occurrence=0", ta.hit, lambda y, c, x, n: ta.valuewhen(y)),
    "tr": ("n:handle_na=1", lambda h: ta.tr(bool(h))), "vwap": ("s:source", lambda x: ta.vwap(x, P("volume"))), "pivothigh": ("s:source n:leftbars n:rightbars", ta.pivothigh), "pivotlow": ("s:source n:leftbars n:rightbars", ta.pivotlow), "percentile_linear_interpolation": ("s:source n:length n:percentage", ta.percentile_linear_interpolation), "percentile_nearest_rank": ("s:source n:length n:percentage", ta.percentile_nearest_rank),
}
#: Calls in two steps: a column first, then one over it.
STEPS: dict[str, tuple[str, Any, Any]] = {
    "hma": ("s:source n:length", lambda x, n: ta.hma_core(x, n), lambda y, x, n: ta.wma(y, int(n**0.5))), "rising": ("s:source n:length", lambda x, n: ta.rising_step(x), lambda y, x, n: ta.run_of(y, n)), "falling": ("s:source n:length", lambda x, n: ta.falling_step(x), lambda y, x, n: ta.run_of(y, n)),
    "cmo": ("s:source n:length", lambda x, n: ta.change(x), lambda y, x, n: ta.cmo(y, n)), "mfi": ("s:source n:length", lambda x, n: ta.change(x), lambda y, x, n: ta.mfi(x, y, n, P("volume"))), "obv": ("", lambda: ta.obv_step(), lambda y: ta.total(y)), "pvt": ("", lambda: ta.pvt_step(), lambda y: ta.total(y)), "accdist": ("", lambda: ta.accdist_step(), lambda y: ta.total(y)), "wad": ("", lambda: ta.wad_step(), lambda y: ta.total(y)),
    "nvi": ("", lambda: ta.index_step(True), lambda y: ta.compounded(y)), "pvi": ("", lambda: ta.index_step(False), lambda y: ta.compounded(y)),
}
#: Recursive calls: parameters, kernel, the bars' columns read after the series, outputs.
FOLDS: dict[str, tuple[str, Any, tuple[str, ...], int]] = {
    "ema": ("s:source n:length", R.ema, (), 1), "rma": ("s:source n:length", R.rma, (), 1), "rsi": ("s:source n:length", R.rsi, (), 1), "macd": ("s:source n:fastlen n:slowlen n:siglen", R.macd, (), 3), "atr": ("n:length", R.atr, ("high", "low", "close"), 1), "dmi": ("n:diLength n:adxSmoothing", R.dmi, ("high", "low", "close"), 3), "tsi": ("s:source n:short n:long", R.tsi, (), 1),
    "kc": ("s:source n:length n:mult n:useTrueRange=1", R.kc, ("high", "low", "close"), 3), "kcw": ("s:source n:length n:mult n:useTrueRange=1", R.kcw, ("high", "low", "close"), 1), "supertrend": ("n:factor n:atrPeriod", R.supertrend, ("high", "low", "close"), 2), "sar": ("n:start n:inc n:max", R.sar, ("high", "low", "close"), 1),
}
MATH = {k: getattr(X, v) for k, v in {"abs": "abs_", "acos": "acos", "asin": "asin", "atan": "atan", "avg": "avg", "ceil": "ceil", "cos": "cos", "exp": "exp", "floor": "floor", "log": "ln", "log10": "log10", "max": "max_", "min": "min_", "pow": "pow_", "sign": "sign", "sin": "sin", "sqrt": "sqrt", "tan": "tan", "todegrees": "todegrees", "toradians": "toradians"}.items()}
COMPARE = {"==": X.eq, "!=": X.neq, "<": X.lt, "<=": X.le, ">": X.gt, ">=": X.ge}


@dataclass
class Plan:
    df: DataFrame
    inputs: Inputs
    names: dict[str, Any] = field(default_factory=dict)
    plots: list[str] = field(default_factory=list)
    actions: list[tuple[str | None, str, dict]] = field(default_factory=list)
    config: Config = field(default_factory=Config)
    made: int = 0

    def put(self, value: Column, name: str | None = None) -> Column:
        self.made += 1
        name = name or f"_c{self.made}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def constant(self, e) -> Any:
        if e[0] == "const":
            return e[1]
        if e[0] == "-":
            return -self.constant(e[1])
        if e[0] == "name" and not isinstance(self.names.get(e[1], F), (Column, type(F))):
            return self.names[e[1]]
        if e[0] == "name" and e[1].startswith(("strategy.", "currency.")):
            return e[1].partition(".")[2]
        if e[0] == "call" and e[1].startswith("input"):
            return self.read_input(e)
        raise Unsupported("a constant is needed here")

    def read_input(self, e) -> Any:
        named = {k: self.constant(v) for k, v in e[3].items() if k in ("title", "minval", "maxval", "defval")}
        args = [a for a in e[2]]
        default = named.pop("defval", None) if not args else None if e[1] == "input.source" else self.constant(args[0])
        title = named.pop("title", self.constant(args[1]) if len(args) > 1 else None)
        id = title or f"in_{len(self.inputs.declared)}"
        kind = e[1].partition(".")[2] or "any"
        if kind == "source":
            return self.inputs.source(id, args[0][1] if args else "close")
        if not hasattr(self.inputs, kind):
            raise Unsupported(e[1])
        return getattr(self.inputs, kind)(id, default, None, **(named if kind in ("int", "float") else {}))

    def bind(self, spec: str, e) -> tuple[list[Column], list[Any]]:
        series, constants = [], []
        for k, part in enumerate(spec.split()):
            kind, _, name = part.partition(":")
            name, _, default = name.partition("=")
            given = e[2][k] if k < len(e[2]) else e[3].get(name)
            if given is None:
                if not default:
                    raise Unsupported(f"{e[1]} needs {name}")
                constants.append(float(default) if "." in default else int(default))
            elif kind == "s":
                v = self.column(given)
                series.append(v if given[0] == "name" and given[1] in self.df.columns else self.put(v))
            else:
                constants.append(self.constant(given))
        return series, constants

    def series(self, e) -> Column | tuple[Column, ...]:
        name = e[1].partition(".")[2]
        if name in CALLS:
            s, n = self.bind(CALLS[name][0], e)
            return self.put(CALLS[name][1](*s, *n))
        if name in STEPS:
            s, n = self.bind(STEPS[name][0], e)
            return self.put(STEPS[name][2](self.put(STEPS[name][1](*s, *n)), *s, *n))
        if name in FOLDS:
            spec, kernel, more, outs = FOLDS[name]
            s, n = self.bind(spec, e)
            self.made += 1
            names = tuple(f"_f{self.made}_{k}" for k in range(outs))
            reads = tuple(c._jc.toString() for c in s) + more
            self.df = R.fold(self.df, R.Step(names, kernel, reads, tuple(n)))
            return F.col(names[0]) if outs == 1 else tuple(F.col(x) for x in names)
        if name == "bb":
            s, n = self.bind("s:source n:length n:mult", e)
            b = self.put(ta.bb(s[0], *n))
            return b["middle"], b["upper"], b["lower"]
        raise Unsupported(e[1])

    def column(self, e) -> Column:
        kind = e[0]
        if kind == "const":
            return F.lit(e[1])
        if kind == "name":
            v = self.names.get(e[1])
            if isinstance(v, Column):
                return v
            if v is not None:
                return F.lit(v)
            if e[1] in ("na",):
                return F.lit(None).cast("double")
            if e[1] in ("bar_index", "time"):
                return F.col(e[1])
            if e[1] in SOURCES:
                return F.expr(SOURCES[e[1]])
            if e[1].startswith("math.") and e[1][5:] in ("pi", "e", "phi", "rphi"):
                return getattr(X, e[1][5:])()
            if e[1] in ("ta.tr", "ta.obv", "ta.pvt", "ta.accdist", "ta.wad", "ta.nvi", "ta.pvi"):
                return self.series(("call", e[1], [], {}))
            raise Unsupported(f"unknown name {e[1]}")
        if kind == "-":
            return -self.column(e[1])
        if kind == "not":
            return ~F.coalesce(self.column(e[1]), F.lit(False))
        if kind == "if":
            return F.when(F.coalesce(self.column(e[1]), F.lit(False)), self.column(e[2])).otherwise(self.column(e[3]))
        if kind == "past":
            n = self.constant(e[2])
            return self.put(ta.lag(self.put(self.column(e[1])), int(n)))
        if kind == "op":
            op, a, b = e[1], self.column(e[2]), self.column(e[3])
            if op in COMPARE:
                return COMPARE[op](a, b)
            if op in ("and", "or"):
                a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
                return a & b if op == "and" else a | b
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[op]()
        name = e[1]
        if name.startswith("ta."):
            got = self.series(e)
            if isinstance(got, tuple):
                raise Unsupported(f"{name} gives several series")
            return got
        if name.startswith("math."):
            short = name[5:]
            if short == "round":
                return X.round_(self.column(e[2][0]), int(self.constant(e[2][1])) if len(e[2]) > 1 else 0)
            if short == "sum":
                s, n = self.bind("s:source n:length", e)
                return self.put(X.sum_(s[0], n[0]))
            if short in MATH:
                return MATH[short](*[self.column(a) for a in e[2]])
        if name == "nz":
            return ta.nz(self.column(e[2][0]), float(self.constant(e[2][1])) if len(e[2]) > 1 else 0.0)
        if name == "na":
            return self.column(e[2][0]).isNull()
        if name == "fixnan":
            return self.put(ta.fixnan(self.put(self.column(e[2][0]))))
        if name.startswith("input"):
            v = self.read_input(e)
            return v if isinstance(v, Column) else F.lit(v)
        raise Unsupported(name)

    # --- statements ---

    def statement(self, text: str, condition: str | None) -> None:
        m = re.match(r"\s*\[([^\]]+)\]\s*=\s*(.+)$", text)
        if m:
            got = self.series(Parser(m[2]).whole())
            for n, v in zip(m[1].split(","), got, strict=True):
                if n.strip() != "_":
                    self.names[n.strip()] = self.put(v)
            return
        m = re.match(r"\s*(?:(var|varip)\s+)?(?:(?:int|float|bool|string|color)\s+)?([A-Za-z_]\w*)\s*(:=|=)(?!=)\s*(.+)$", text)
        if m:
            if m[1] or m[3] == ":=":
                raise Unsupported("state that changes from bar to bar")
            if condition:
                raise Unsupported("an assignment under a condition")
            e = Parser(m[4]).whole()
            try:
                self.names[m[2]] = self.constant(e)
            except Unsupported:
                self.names[m[2]] = self.put(self.column(e))
            return
        e = Parser(text).whole()
        if e[0] != "call":
            raise Unsupported(text)
        name, args, named = e[1], e[2], e[3]
        if name in ("indicator", "study"):
            return
        if name in ("plotshape", "plotchar", "bgcolor", "barcolor", "alertcondition"):  # a series each, true or a colour where it shows
            label = self.constant(named["title"]) if "title" in named else f"{name}_{len(self.plots)}"
            self.put(self.column(args[0]), label)
            self.plots.append(label)
            return
        if name == "strategy":
            for k in set(named) - set(Config.__dataclass_fields__) - {"title", "shorttitle", "overlay"}:
                raise Unsupported(f"strategy({k})")
            known = {k: self.constant(v) for k, v in named.items() if k in Config.__dataclass_fields__}
            self.config = Config(**{k: v.removeprefix("commission.") if isinstance(v, str) else v for k, v in known.items()})
            return
        if name == "plot":
            title = named.get("title") or (args[1] if len(args) > 1 else None)
            label = self.constant(title) if title else f"plot_{len(self.plots)}"
            self.put(self.column(args[0]), label)
            self.plots.append(label)
            return
        if name in ("strategy.entry", "strategy.order", "strategy.close", "strategy.close_all", "strategy.exit", "strategy.cancel", "strategy.cancel_all"):
            order = {"strategy.entry": "id direction qty limit stop", "strategy.order": "id direction qty limit stop", "strategy.exit": "id from_entry qty qty_percent profit limit loss stop trail_price trail_points trail_offset", "strategy.close": "id comment qty qty_percent"}.get(name, "id")
            both = dict(zip(order.split(), args, strict=False)) | named
            taken = {*order.split(), "comment", *(("immediately",) if name in ("strategy.close", "strategy.close_all") else ())}
            for k in set(both) - taken:
                raise Unsupported(f"{name}({k})")
            values: dict[str, Any] = {}
            for k, v in both.items():
                try:
                    values[k] = self.constant(v)
                except Unsupported:
                    values[k] = self.put(self.column(v))
            values = {k: ("column", v._jc.toString()) if isinstance(v, Column) else v for k, v in values.items()}
            self.actions.append((condition, name.partition(".")[2], values))
            return
        raise Unsupported(name)

    def condition(self, text: str, outer: str | None) -> str:
        c = F.coalesce(self.column(Parser(text).whole()).cast("boolean"), F.lit(False))
        return self.put(c & F.col(outer) if outer else c)._jc.toString()


def compile_script(bars: DataFrame, text: str, inputs: dict[str, Any] | None = None) -> Plan:
    plan = Plan(bars, Inputs(inputs or {}))
    blocks: list[tuple[int, str]] = []
    for raw in text.splitlines():
        line = re.sub(r"//.*$", "", raw)
        if not line.strip():
            continue
        depth = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        while blocks and depth <= blocks[-1][0]:
            blocks.pop()
        if depth and not blocks:
            raise Unsupported("an indented line outside of a block")
        outer = blocks[-1][1] if blocks else None
        m = re.match(r"\s*if\b(.+)$", line)
        if m:
            blocks.append((depth, plan.condition(m[1].strip(), outer)))
        elif re.match(r"\s*(for|while|switch|else|type|enum|method|import|export)\b", line) or "=>" in line:
            raise Unsupported(line.strip().split()[0])
        else:
            plan.statement(line.strip(), outer)
    return plan


def run(bars: DataFrame, text: str, inputs: dict[str, Any] | None = None) -> DataFrame:
    """symbol, time, bar_index and what the script plots."""
    plan = compile_script(bars, text, inputs)
    return plan.df.select("symbol", "time", "bar_index", *[f"`{p}`" for p in plan.plots])


def run_strategy(bars: DataFrame, text: str, inputs: dict[str, Any] | None = None, want: str = "trades") -> DataFrame:
    """The script's trades, or its equity."""
    plan = compile_script(bars, text, inputs)
    actions = plan.actions

    def script(bar: dict, b: Broker) -> None:
        for condition, what, values in actions:
            if condition is not None and not bar[condition]:
                continue
            v = {k: bar[x[1]] if isinstance(x, tuple) else x for k, x in values.items()}
            v = {k: x for k, x in v.items() if k in ("id", "from_entry", "direction") or isinstance(x, (int, float)) and k in ("immediately", "qty", "qty_percent", "limit", "stop", "profit", "loss", "trail_price", "trail_points", "trail_offset")}
            side = {"long": LONG, "short": SHORT}.get(v.pop("direction", None))
            if what in ("entry", "order"):
                getattr(b, what)(v.pop("id"), side, **v)
            elif what == "exit":
                b.exit(v.pop("id"), v.pop("from_entry", ""), **v)
            elif what == "close":
                b.close(v["id"], bool(v.get("immediately", False)), v.get("qty"), v.get("qty_percent"))
            elif what == "close_all":
                b.close_all(bool(v.get("immediately", False)))
            elif what == "cancel":
                b.cancel(v["id"])
            else:
                getattr(b, what)()

    return backtest(plan.df, script, plan.config, want=want)
