"""Exchange payloads as a Spark data source: ``spark.read.format("klines")`` and ``spark.readStream.format("klines")``.

A folder holds files ``<symbol>-<timeframe>-<first>-<last>.json``, first and last in milliseconds: what an exchange answers to a
request for that range, a list of rows of 12 fields. Files are a partition each. Filters on symbol, timeframe and time go to the source:
a file whose name says that it has none of the rows is never opened, and the others' rows are filtered as they are parsed.
A stream's offset is the last (first time, name) that was read, so files come in order of time and a restart reads each once.

Files are opened by the tasks, under the path as it is given: a folder that all executors see. Bodies that are no list, rows
too short or without a time or price are left out; a file that is no JSON fails its task.

Options: path. Call ``register(spark)`` once.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import ship

SCHEMA = "symbol string, timeframe string, time timestamp, open double, high double, low double, close double, volume double"
NAME = re.compile(r"(.+)-([^-]+)-(\d+)-(\d+)\.json")


@dataclass
class Part(InputPartition):
    """A file, what its name says of it, and the bounds its rows must keep: milliseconds, the upper one outside."""

    path: str
    symbol: str
    timeframe: str
    low: int
    high: int

    def __post_init__(self):
        self.value = self.path


def _listed(folder: str) -> list[tuple[int, int, str, str, str]]:
    """(first, last, path, symbol, timeframe) of the folder's files by time; others are none of its own."""
    out = []
    for name in os.listdir(folder):
        m = NAME.fullmatch(name)
        if m:
            out.append((int(m[3]), int(m[4]), os.path.join(folder, name), m[1], m[2]))
    return sorted(out)


def _millis(t: dt.datetime) -> float:
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return t.timestamp() * 1000


def _rows(part: Part) -> Iterator[tuple]:
    with open(part.path) as f:
        body = json.load(f)
    for row in body if isinstance(body, list) else ():
        if not isinstance(row, list) or len(row) < 6 or any(x is None for x in row[:5]) or not part.low <= int(row[0]) < part.high:
            continue
        time = dt.datetime.fromtimestamp(int(row[0]) / 1000, dt.timezone.utc)
        yield (part.symbol, part.timeframe, time, *map(float, row[1:5]), float(row[5] or 0))


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.names = folder, {}
        self.low, self.high = float("-inf"), float("inf")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes bounds of time, and values of symbol and timeframe; the rest is left to Spark."""
        for f in filters:
            of = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if of in ("symbol", "timeframe") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names[of] = self.names.get(of, values) & values
            elif of == "time" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, _millis(f.value) + 1e-3 * isinstance(f, GreaterThan))
            elif of == "time" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, _millis(f.value) + 1e-3 * isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Part]:
        fits = lambda of, value: of not in self.names or value in self.names[of]
        return [Part(p, s, t, self.low, self.high) for first, last, p, s, t in _listed(self.folder) if fits("symbol", s) and fits("timeframe", t) and last >= self.low and first < self.high]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        return _rows(partition) if partition else iter(())


class Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"first": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listed(self.folder)
        return {"first": files[-1][0], "path": files[-1][2]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        a, b = ((o["first"], o["path"]) for o in (start, end))
        return [Part(p, s, t, float("-inf"), float("inf")) for first, _, p, s, t in _listed(self.folder) if a < (first, p) <= b]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(partition)


class Klines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> Stream:  # noqa: N802
        return Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters go to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Klines)
