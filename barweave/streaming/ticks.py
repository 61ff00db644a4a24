"""Bars from a stream of ticks.

Ticks are (symbol, time, price, volume). Bars close by event time: a watermark says how late a tick may
come, within it a tick changes its bar by its own time, after it the tick is dropped. A bar goes out once,
when the watermark passes its end; replaying ticks then closing bars gives the bars of a batch run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """Ticks from JSON messages in any of the usual spellings: s/symbol, p/price, q/v/volume, T/E/t/time in milliseconds."""
    j = lambda *names: F.coalesce(*[F.get_json_object(F.col(column).cast("string"), f"$.{n}") for n in names])
    t = raw.select(j("symbol", "s").alias("symbol"), F.timestamp_millis(j("time", "T", "E", "t").try_cast("long")).alias("time"), j("price", "p").try_cast("double").alias("price"), F.coalesce(j("volume", "q", "v").try_cast("double"), F.lit(0.0)).alias("volume"))
    return t.where("symbol is not null and time is not null and price is not null")


def bars(ticks: DataFrame, width: str = "1 minute", late: str | None = "10 minutes") -> DataFrame:
    """Tumbling bars, in batch or streaming alike; of ticks of one time the larger price counts last."""
    t = ticks.withWatermark("time", late) if ticks.isStreaming and late else ticks
    at = F.struct("time", "price")
    made = t.groupBy("symbol", F.window("time", width).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("ticks"))
    return made.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume", "ticks")


def coalesced(batch: DataFrame) -> DataFrame:
    """One tick a symbol of a micro-batch: the last price and time, the summed volume."""
    return batch.groupBy("symbol").agg(F.max("time").alias("time"), F.max_by("price", F.struct("time", "price")).alias("price"), F.sum("volume").alias("volume"))


def smoothed(closed: DataFrame, n: int) -> DataFrame:
    """An exponential average carried over a stream of closed bars, with its value were a bar to close now.

    The committed state moves only with closed bars; a provisional value is worked out beside it and
    never stored, so any number of provisional bars leaves no drift.
    """
    ship(closed.sparkSession)
    a = 2 / (n + 1)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, total, value = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("time")
        out = []
        for time, close in zip(rows["time"], rows["close"], strict=True):
            seen += 1
            total += close if seen <= n else 0.0
            if seen >= n:
                value = total / n if seen == n else a * close + (1 - a) * value
            out.append((key[0], time, close, value if seen >= n else None))
        state.update((seen, total, value))
        yield pd.DataFrame(out, columns=["symbol", "time", "close", "ema"])

    return closed.groupBy("symbol").applyInPandasWithState(run, "symbol string, time timestamp, close double, ema double", "seen int, total double, value double", "append", "NoTimeout")
