"""Time: parts in a zone, alignment to timeframes, sessions. Times are UTC; zones are IANA names or offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

UNITS = {"S": 1, "D": 86_400, "W": 604_800, "M": 2_592_000}
SUPPORTED = ("1", "3", "5", "15", "30", "45", "60", "120", "180", "240", "D", "W", "M")


def in_seconds(timeframe: str) -> int:
    """Of 5 (minutes), 30S, D, 2W, M; a month counts 30 days."""
    m = re.fullmatch(r"(\d*)([SDWM]?)", timeframe)
    if not m or not timeframe:
        raise ValueError(f"not a timeframe: {timeframe!r}")
    return int(m[1] or 1) * UNITS.get(m[2], 60)


def from_seconds(seconds: int) -> str:
    for unit in ("M", "W", "D"):
        if seconds % UNITS[unit] == 0:
            return ("" if seconds == UNITS[unit] else str(seconds // UNITS[unit])) + unit
    return str(seconds // 60) if seconds % 60 == 0 else f"{seconds}S"


def multiplier(timeframe: str) -> int:
    return int(re.match(r"\d*", timeframe)[0] or 1)


def source_grain(wanted: str, supported: tuple[str, ...] = SUPPORTED) -> str | None:
    """The largest supported timeframe that divides wanted; weeks and months need days."""
    if wanted in supported:
        return wanted
    if wanted[-1] in "WM":
        return "D" if "D" in supported else None
    seconds = in_seconds(wanted)
    fit = [t for t in supported if t[-1] not in "WM" and seconds % in_seconds(t) == 0]
    return max(fit, key=in_seconds, default=None)


def zone_id(zone: str) -> str:
    """An IANA name as it is; UTC+5, GMT-03:30 as an offset."""
    m = re.fullmatch(r"(?:UTC|GMT)([+-])(\d{1,2})(?::(\d{2}))?", zone.strip(), re.IGNORECASE)
    return f"{m[1]}{int(m[2]):02d}:{m[3] or '00'}" if m else zone.strip()


def local(ts: Column, zone: str = "UTC") -> Column:
    """What clocks in zone show at ts, a time in UTC without a zone; the session's zone takes no part."""
    return ts if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone_id(zone)), ts.cast("timestamp_ntz"))


def from_local(ts: Column, zone: str = "UTC") -> Column:
    """The time in UTC at which clocks in zone show ts: one that clocks pass over counts as an hour later, of one that they show twice it is the later."""
    if zone == "UTC":
        return ts
    ts = ts.cast("timestamp_ntz")
    first = F.convert_timezone(F.lit(zone_id(zone)), F.lit("UTC"), ts)
    if re.match("[+-]", zone_id(zone)):
        return first
    # clocks are put back by a day at most, so a day on they show the later offset
    day = first + F.expr("INTERVAL 1 DAY")
    later = ts - (local(day, zone) - day)
    return F.when(local(later, zone) == ts, F.greatest(first, later)).otherwise(first)


def parts(ts: Column, zone: str = "UTC") -> dict[str, Column]:
    """dayofweek is 1 on Sunday; weekofyear is ISO's."""
    t = local(ts, zone)
    return {"year": F.year(t), "month": F.month(t), "dayofmonth": F.dayofmonth(t), "dayofweek": F.dayofweek(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t), "weekofyear": F.weekofyear(t)}


def align(ts: Column, timeframe: str) -> Column:
    """The open of the bar that holds ts: months and Monday weeks from the calendar, days and shorter from UTC midnight."""
    unit = timeframe[-1]
    if unit in "MWD" and multiplier(timeframe) == 1:
        return F.date_trunc({"M": "month", "W": "week", "D": "day"}[unit], ts).cast("timestamp_ntz")
    seconds = in_seconds(timeframe)
    day = F.date_trunc("day", ts)
    since = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    return F.timestamp_add("SECOND", (F.floor(since / seconds) * seconds).cast("int"), day.cast("timestamp_ntz"))


def change(ts: Column, timeframe: str) -> Column:
    """The bar is the first of a new bucket; false on the first bar."""
    b = align(ts, timeframe)
    return F.coalesce(b != F.lag(b).over(Window.partitionBy("symbol").orderBy("bar_index")), F.lit(False))


def timestamp(year: Column | int, month: Column | int, day: Column | int, hour: Column | int = 0, minute: Column | int = 0, second: Column | int = 0, zone: str = "UTC") -> Column:
    """The time in UTC, without a zone, of a moment on zone's clocks; parts beyond their range roll over, na in any gives na."""
    year, *rest = [x.cast("int") if isinstance(x, Column) else F.lit(x) for x in (year, month, day, hour, minute, second)]
    t = F.try_make_timestamp_ntz(year, *[F.lit(x) for x in (1, 1, 0, 0, 0)])
    for unit, x, first in zip(("MONTH", "DAY", "HOUR", "MINUTE", "SECOND"), rest, (1, 1, 0, 0, 0), strict=True):
        t = F.timestamp_add(unit, x - first, t)
    return from_local(t, zone)


#: Months as mail dates name them, three letters each.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def timestamp_of(text: Column, zone: str = "UTC") -> Column:
    """The time in UTC, without a zone, of 2024-01-31, 2024-01-31 10:00, 2024-01-31T10:00:00.5 or 31 Jan 2024 10:00:00 (a weekday before it is passed over); Z or an
    offset at the end holds before zone. na for other texts."""
    s, offset = F.trim(text), r"([+-])(\d{2}):?(\d{2})$"
    timed = s.rlike(r":\d{2}(\.\d+)?\s*([Zz]|[+-]\d{2}:?\d{2})$")
    bare = F.when(timed, F.regexp_replace(s, r"\s*([Zz]|[+-]\d{2}:?\d{2})$", "")).otherwise(s)
    mail = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})(?:\s+(\d{2}:\d{2}(?::\d{2})?))?$"
    day, name, year, clock = (F.regexp_extract(bare, mail, k) for k in (1, 2, 3, 4))
    at = F.instr(F.lit(MONTHS), F.initcap(name))
    month = F.when(at % 3 == 1, F.lpad(F.floor((at + 2) / 3).cast("string"), 2, "0"))
    iso = F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), F.when(clock == "", "00:00").otherwise(clock))
    plain = F.when(bare.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), bare).when(bare.rlike(mail), iso)
    t = plain.try_cast("timestamp_ntz")
    part = [F.regexp_extract(s, offset, k) for k in (2, 3)]
    ahead = F.when(timed & s.rlike(offset), (part[0].try_cast("int") * 60 + part[1].try_cast("int")) * F.when(F.regexp_extract(s, offset, 1) == "-", -1).otherwise(1)).otherwise(0)
    return F.when(timed, F.timestamp_add("MINUTE", -ahead, t)).otherwise(from_local(t, zone))


def in_session(ts: Column, spec: str, zone: str = "UTC") -> Column:
    """spec: HHMM-HHMM[,HHMM-HHMM][:days] (1 is Sunday) or 24x7. A session over midnight belongs to the next day."""
    if spec == "24x7":
        return ts.isNotNull()
    times, _, days = spec.partition(":")
    allowed = [int(d) for d in days or "1234567"]
    t = local(ts, zone)
    minute, day = F.hour(t) * 60 + F.minute(t), F.dayofweek(t)
    inside = F.lit(False)
    for part in times.split(","):
        a, b = (int(x[:2]) * 60 + int(x[2:]) for x in part.split("-"))
        if a < b:
            inside = inside | ((minute >= a) & (minute < b) & day.isin(allowed))
        else:
            inside = inside | ((minute >= a) & (day % 7 + 1).isin(allowed)) | ((minute < b) & day.isin(allowed))
    return inside


def close_time(timeframe: str) -> Column:
    """The next bar's open, of the last bar its own end."""
    w = Window.partitionBy("symbol").orderBy("bar_index")
    return F.coalesce(F.lead("time").over(w), F.timestamp_add("SECOND", F.lit(in_seconds(timeframe)), F.col("time")))


def _other_day(ts: Column, zone: str, move) -> Column:
    day = F.to_date(local(ts, zone))
    return F.coalesce(day != move(day).over(Window.partitionBy("symbol").orderBy("bar_index")), F.lit(True))


def first_of_session(ts: Column, zone: str = "UTC") -> Column:
    """The bar before is of another day, or there is none."""
    return _other_day(ts, zone, F.lag)


def last_of_session(ts: Column, zone: str = "UTC") -> Column:
    return _other_day(ts, zone, F.lead)
