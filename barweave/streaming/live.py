"""Bars and indicators of a live stream: committed state that moves with closed bars alone, and a tentative bar beside it.

Each symbol's state holds two things. Committed: what every indicator carries over, as numbers. Tentative: the
bar that ticks still form. A micro-batch brings ticks; one of a later bar closes the tentative one, which is then
added to the committed state and goes out as confirmed. What remains open goes out once a micro-batch as
provisional, with the indicators' values were it to close now: they are worked out on a copy, so any number
of provisional values leaves the confirmed ones as a batch run has them. State lies in Spark's store; a query that is
stopped in the middle of a bar goes on from its checkpoint.

Ticks of a micro-batch count in order of time, of one time by price. A tick of a bar that is closed already comes
too late and is dropped. Ticks without a symbol, time or price are left out; a missing volume is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship

State = list[float]
Bar = tuple[float, float, float, float, float]  # open, high, low, close, volume
NONE = float("nan")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Indicator:
    """names of its values; start: its state before any bar; step: state and bar to state and values, na as NaN."""

    names: tuple[str, ...]
    start: tuple[float, ...]
    step: Callable[[State, Bar], tuple[State, tuple[float, ...]]]


def _mean(s: State, x: float, n: int, a: float) -> State:
    """A seeded average's (values seen, their sum up to the n-th, value)."""
    seen, total, value = s
    seen += 1
    total += x if seen <= n else 0.0
    return [seen, total, total / n if seen == n else a * x + (1 - a) * value if seen > n else NONE]


def ema(name: str, n: int) -> Indicator:
    def step(s: State, bar: Bar) -> tuple[State, tuple[float, ...]]:
        s = _mean(s, bar[3], n, 2 / (n + 1))
        return s, (s[2],)

    return Indicator((name,), (0.0, 0.0, NONE), step)


def rsi(name: str, n: int) -> Indicator:
    def step(s: State, bar: Bar) -> tuple[State, tuple[float, ...]]:
        p, up, down = s[0], s[1:4], s[4:]
        if p != p:
            return [bar[3], *up, *down], (NONE,)
        up, down = _mean(up, max(bar[3] - p, 0.0), n, 1 / n), _mean(down, max(p - bar[3], 0.0), n, 1 / n)
        value = up[2] if up[2] != up[2] else 100.0 if down[2] == 0 else 100 - 100 / (1 + up[2] / down[2])
        return [bar[3], *up, *down], (value,)

    return Indicator((name,), (NONE, 0.0, 0.0, NONE, 0.0, 0.0, NONE), step)


def atr(name: str, n: int) -> Indicator:
    def step(s: State, bar: Bar) -> tuple[State, tuple[float, ...]]:
        p, h, low = s[0], bar[1], bar[2]
        m = _mean(s[1:], h - low if p != p else max(h - low, abs(h - p), abs(low - p)), n, 1 / n)
        return [bar[3], *m], (m[2],)

    return Indicator((name,), (NONE, 0.0, 0.0, NONE), step)


def macd(names: tuple[str, str, str], fast: int, slow: int, signal: int) -> Indicator:
    def step(s: State, bar: Bar) -> tuple[State, tuple[float, ...]]:
        f, w, g = _mean(s[:3], bar[3], fast, 2 / (fast + 1)), _mean(s[3:6], bar[3], slow, 2 / (slow + 1)), s[6:]
        line = f[2] - w[2]
        g = g if line != line else _mean(g, line, signal, 2 / (signal + 1))
        return [*f, *w, *g], (line, g[2], line - g[2])

    return Indicator(names, (0.0, 0.0, NONE) * 3, step)


COMMITTED = "state array<double>, bars long"
TENTATIVE = "bucket long, open double, high double, low double, close double, volume double, ticks long"
BAR = "symbol string, time timestamp, bar_index long, confirmed boolean, open double, high double, low double, close double, volume double, ticks long"


class Bars(StatefulProcessor):
    """A symbol's two values, committed and tentative, and what a micro-batch of its ticks makes of them."""

    def __init__(self, seconds: int, made: tuple[Indicator, ...]):
        self.seconds, self.made = seconds, made
        self.columns = [x.strip().split(" ")[0] for x in BAR.split(",")] + [n for m in made for n in m.names]

    def init(self, handle) -> None:
        self.committed, self.tentative = handle.getValueState("committed", COMMITTED), handle.getValueState("tentative", TENTATIVE)

    def advance(self, state: State, bar: Bar) -> tuple[State, list]:
        """The state after a bar, and the values; state itself stays as it is."""
        at, new, values = 0, [], []
        for m in self.made:
            part, got = m.step(state[at : at + len(m.start)], bar)
            at += len(m.start)
            new += part
            values += [None if v != v else v for v in got]
        return new, values

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, bars = [v for m in self.made for v in m.start], 0
        if self.committed.exists():
            kept, bars = self.committed.get()
            state = [NONE if v is None else v for v in kept]
        bucket, *bar, count = self.tentative.get() if self.tentative.exists() else (None, 0)
        ticks, out, closed = pd.concat(list(rows)).sort_values(["time", "price"]), [], False

        def row(confirmed: bool, values: list) -> tuple:
            return (key[0], pd.Timestamp(bucket * self.seconds, unit="s"), bars, confirmed, *bar, count, *values)

        for b, price, volume in zip(ticks["bucket"].tolist(), ticks["price"].tolist(), ticks["volume"].tolist(), strict=True):
            if bucket is not None and b < bucket:
                continue  # its bar is closed
            if b != bucket:
                if bucket is not None:
                    state, values = self.advance(state, tuple(bar))
                    out.append(row(True, values))
                    bars, closed = bars + 1, True
                bucket, bar, count = b, [price, price, price, price, 0.0], 0
            bar = [bar[0], max(bar[1], price), min(bar[2], price), price, bar[4] + volume]
            count += 1
        if closed:
            self.committed.update(([None if v != v else float(v) for v in state], bars))
        self.tentative.update((bucket, *bar, count))
        out.append(row(False, self.advance(state, tuple(bar))[1]))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def indicators(ticks: DataFrame, seconds: int, *made: Indicator) -> DataFrame:
    """Rows of bars of so many seconds from ticks (symbol, time, price, volume), confirmed ones once and the open one once a micro-batch, with each indicator's values.

    The session must keep states in RocksDB: set spark.sql.streaming.stateStore.providerClass to ROCKS."""
    ship(ticks.sparkSession)
    t = ticks.where("symbol is not null and time is not null and price is not null")
    t = t.select("symbol", "time", F.col("price").cast("double").alias("price"), F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"), F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / seconds).alias("bucket"))
    schema = ", ".join([BAR, *(f"`{n}` double" for m in made for n in m.names)])
    return t.groupBy("symbol").transformWithStateInPandas(Bars(seconds, made), schema, "Append", "None")


# --- a store of bars that a stream replaces and appends to ---------------------------------------------


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows (symbol, time, ...) take the place of what the store at path has for their key, or are added.

    Each micro-batch is one folder named by its number, written over if the batch comes again, so a repeated batch changes
    nothing; nothing that is there already is rewritten, so a lost executor or driver loses nothing. Of several rows of
    one key in a batch a confirmed one counts, else the one of most ticks, where the batch has these columns.
    """

    def write(batch: DataFrame, number: int) -> None:
        order = [F.col(c) for c in ("confirmed", "ticks") if c in batch.columns]
        latest = batch.where("symbol is not null and time is not null").groupBy("symbol", "time").agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns if c not in ("symbol", "time")]), F.struct(*order, F.lit(0))).alias("row"))
        latest.select("symbol", "time", "row.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark, path: str) -> DataFrame:
    """The store's rows, for each symbol and time those of the last batch that has them. Sums where rows lie: of a key's versions one a task moves."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    own = [c for c in rows.columns if c not in ("symbol", "time", "batch")]
    return rows.groupBy("symbol", "time").agg(F.max_by(F.struct(*own), "batch").alias("row")).select("symbol", "time", "row.*")


def compact(spark, path: str) -> None:
    """Makes one folder of all: the rows of latest() become the last batch's, then the earlier folders go."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("batch="))
    if len(done) < 2:
        return
    last, whole = done[-1], spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_whole")
    latest(spark, path).write.mode("overwrite").parquet(f"{path}/_whole")
    # a reader between these two steps finds every key in the folders that are left, or in the new one
    fs.rename(whole, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={last}/_whole"))
    for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={last}/_whole")):
        fs.rename(s.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={last}/whole-{s.getPath().getName()}"))
    for number in done[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number}"), True)
