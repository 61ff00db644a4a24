"""Query parameters, symbol names and colours."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = {
    "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
    "hl2": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "ohlc4": "(open + high + low + close) / 4", "hlcc4": "(high + low + 2 * close) / 4",
}
#: The named colours.
COLORS = {
    "aqua": "#00BCD4", "black": "#363A45", "blue": "#2962FF", "fuchsia": "#E040FB", "gray": "#787B86", "green": "#4CAF50", "lime": "#00E676", "maroon": "#880E4F", "navy": "#311B92", "olive": "#808000", "orange": "#FF9800", "purple": "#9C27B0", "red": "#F23645", "silver": "#B2B5BE", "teal": "#089981", "white": "#FFFFFF", "yellow": "#FDD835",
}


@dataclass
class Inputs:
    """Typed parameters of a query. A value given by the parameter's id comes first, then one by its title, then the default."""

    given: dict[str, Any] = field(default_factory=dict)
    declared: dict[str, dict] = field(default_factory=dict)

    def _value(self, kind: str, id: str, default: Any, title: str | None, **limits: Any) -> Any:
        value = self.given.get(id, self.given.get(title, default) if title else default)
        self.declared[id] = {"kind": kind, "default": default, "title": title, "value": value} | limits
        low, high, options = limits.get("minval"), limits.get("maxval"), limits.get("options")
        if low is not None and value < low or high is not None and value > high or options is not None and value not in options:
            raise ValueError(f"{id}: {value!r} is not allowed")
        return value

    def any(self, id: str, default: Any, title: str | None = None) -> Any:
        return self._value("any", id, default, title)

    def int(self, id: str, default: int, title: str | None = None, **limits: Any) -> int:
        return int(self._value("int", id, default, title, **limits))

    def float(self, id: str, default: float, title: str | None = None, **limits: Any) -> float:
        return float(self._value("float", id, default, title, **limits))

    price = float

    def bool(self, id: str, default: bool, title: str | None = None) -> bool:
        return bool(self._value("bool", id, default, title))

    def string(self, id: str, default: str, title: str | None = None, **limits: Any) -> str:
        return str(self._value("string", id, default, title, **limits))

    text_area = symbol = session = timeframe = color = enum = time = string

    def source(self, id: str, default: str = "close", title: str | None = None) -> Column:
        """A series of bars by its name."""
        return F.expr(SOURCES[self._value("source", id, default, title, options=tuple(SOURCES))])


def ticker(symbol: str, prefix: str = "", session: str | None = None, adjustment: str | None = None) -> str:
    """prefix:symbol with modifiers after semicolons."""
    name = f"{prefix}:{symbol}" if prefix else symbol
    return ";".join([name, *[f"{k}={v}" for k, v in (("session", session), ("adjustment", adjustment)) if v]])


def standard(symbol: str) -> str:
    """Without modifiers."""
    return symbol.partition(";")[0]


def plain_symbol(symbol: str, chart: str) -> str:
    """What a request reads: the chart's own symbol for an empty name, without the prefix; a modifier stays."""
    if not symbol:
        return chart
    name, mark, rest = symbol.partition(";")
    return name.rpartition(":")[2] + mark + rest


def heikin_ashi(symbol: str) -> str:
    return f"{standard(symbol)};type=heikinashi"


def color_new(color: str, transparency: float) -> str:
    """#RRGGBBAA with transparency from 0 (solid) to 100."""
    base = COLORS.get(color, color)[:7]
    return f"{base}{round(255 * (1 - min(max(transparency, 0), 100) / 100)):02X}"


def color_rgb(r: int, g: int, b: int, transparency: float = 0) -> str:
    return color_new(f"#{r:02X}{g:02X}{b:02X}", transparency)


def color_parts(color: str) -> tuple[int, int, int, float]:
    """Red, green, blue and transparency."""
    h = COLORS.get(color, color).lstrip("#")
    if not re.fullmatch(r"[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?", h):
        raise ValueError(f"not a colour: {color!r}")
    return int(h[:2], 16), int(h[2:4], 16), int(h[4:6], 16), round(100 * (1 - int(h[6:] or "FF", 16) / 255), 2)


def from_gradient(x: Column, low: float, high: float, low_color: str, high_color: str) -> Column:
    """Between two colours by where x lies, clamped."""
    share = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    a, b = color_parts(low_color), color_parts(high_color)
    return F.format_string("#%02X%02X%02X", *[F.round(p + (q - p) * share).cast("int") for p, q in zip(a[:3], b[:3], strict=True)])


def display_union(*flags: Column) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = F.array_union(out, f)
    return out


def display_minus(a: Column, b: Column) -> Column:
    return F.array_except(a, b)
