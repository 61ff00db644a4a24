"""Text. Positions count from 0; ends are exclusive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import local

lower, upper, trim, length = F.lower, F.upper, F.trim, F.length


def tonumber(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def tostring(x: Column, fmt: str | None = None, mintick: float = 0.01) -> Column:
    """fmt: mintick, integer, percent (two places), price, volume, or a pattern as #.## (at most) and 0.00 (exactly so many places)."""
    if fmt is None:
        return x.cast("string")
    places = len(f"{mintick:.10f}".rstrip("0").partition(".")[2])
    if fmt in ("mintick", "price"):
        return F.format_string(f"%.{places}f", F.round(x / F.lit(mintick)) * F.lit(mintick))
    if fmt == "integer":
        return F.format_string("%.0f", F.round(x))
    if fmt == "percent":
        return F.concat(F.format_string("%.2f", F.round(x * 100, 2)), F.lit("%"))
    if fmt == "volume":
        return F.format_string("%.0f", F.round(x))
    fraction = fmt.partition(".")[2]
    most, least = len(fraction), fraction.count("0")
    fixed = F.format_string(f"%.{most}f", F.round(x, most))
    if least == most:
        return fixed
    kept = F.regexp_replace(fixed, rf"(\.\d{{{least}}}\d*?)0+$", "$1")
    return F.regexp_replace(kept, r"\.$", "")


def repeat(s: Column, n: int, separator: str = "") -> Column:
    return F.array_join(F.array_repeat(s, n), separator)


def replace_all(s: Column, target: str, new: str) -> Column:
    return F.replace(s, F.lit(target), F.lit(new))


def replace(s: Column, target: str, new: str, occurrence: int = 0) -> Column:
    """The occurrence-th (from 0) alone."""
    parts = F.split(s, re.escape(target), -1)
    k = occurrence + 1
    head, tail = F.array_join(F.slice(parts, F.lit(1), F.lit(k)), target), F.array_join(F.slice(parts, F.lit(k + 1), F.greatest(F.size(parts) - k, F.lit(0))), target)
    return F.when(F.size(parts) > k, F.concat(head, F.lit(new), tail)).otherwise(s)


def contains(s: Column, part: str) -> Column:
    return s.contains(part)


def startswith(s: Column, part: str) -> Column:
    return s.startswith(part)


def endswith(s: Column, part: str) -> Column:
    return s.endswith(part)


def pos(s: Column, part: str) -> Column:
    """na if absent."""
    return F.nullif(F.instr(s, part), F.lit(0)) - 1


def substring(s: Column, start: int, end: int | None = None) -> Column:
    return F.substring(s, start + 1, end - start) if end is not None else F.substr(s, F.lit(start + 1))


def split(s: Column, separator: str) -> Column:
    return F.split(s, re.escape(separator), -1)


def match(s: Column, pattern: str) -> Column:
    """The first match; na if none."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 0))


def format_time(ts: Column, fmt: str = "yyyy-MM-dd'T'HH:mm:ssZ", zone: str = "UTC") -> Column:
    """ts, in UTC without a zone, on zone's clocks; Z is the zone's offset as +0530, text in quotes stands for itself. Times that the session's own
    clocks pass over need a session in UTC."""
    shown = local(ts, zone).cast("timestamp_ntz")
    minutes = F.timestamp_diff("MINUTE", ts.cast("timestamp_ntz"), shown)
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    out: list[Column] = []
    for quoted, z, letters in re.findall(r"('(?:[^']|'')*')|(Z+)|([^'Z]+)", fmt):
        if z:
            out.append(offset)
        else:
            out.append(F.lit(quoted[1:-1].replace("''", "'") or "'") if quoted else F.date_format(shown.cast("timestamp"), letters))
    return F.when(ts.isNotNull(), F.concat(*out)) if out else F.lit("")


def format_(pattern: str, *args: Column) -> Column:
    """{0} and {1,number,#.##} stand for the arguments."""
    out: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\d+)(?:,number,([^}]*))?\}", pattern):
        out += [F.lit(pattern[at : m.start()]), tostring(args[int(m[1])], m[2])]
        at = m.end()
    return F.concat(*out, F.lit(pattern[at:]))
