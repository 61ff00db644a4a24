"""What a bar knows of its place: the last bar, the trading day, and whether it is history or still forms.

All columns share the exchange and sort of the series' windows. now is the moment a job runs for, one for all rows, so
repeated tasks agree; without it, the query's own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import close_time, in_seconds

NAMES = ("last_bar_index", "last_bar_time", "timenow", "time_tradingday", "isfirst", "islast", "ishistory", "isrealtime", "isnew", "isconfirmed", "islastconfirmedhistory", "ismarket", "ispremarket", "ispostmarket")


def states(bars: DataFrame, timeframe: str, now: dt.datetime | None = None, zone: str = "UTC", live: bool = False) -> DataFrame:
    """bars with the columns NAMES. now is in UTC; zone is the exchange's, whose date at a bar's close is its trading day; live: the last tick
    continues its bar. A symbol's only bar is first and last; a bar that closes at now is confirmed. All bars are of the
    market's session."""
    whole = Window.partitionBy("symbol")
    moment = F.current_timestamp().cast("timestamp_ntz") if now is None else F.lit(now).cast("timestamp_ntz")
    rows = bars.withColumns({"_closes": close_time(timeframe), "last_bar_index": F.max("bar_index").over(whole), "last_bar_time": F.max("time").over(whole), "timenow": moment})
    closes, left = F.col("_closes").cast("timestamp_ntz"), F.col("last_bar_index") - F.col("bar_index")
    ended = F.timestamp_add("SECOND", F.lit(in_seconds(timeframe)), F.col("last_bar_time")) <= F.col("timenow")
    flags: dict[str, Column] = {
        "time_tradingday": F.date_trunc("day", F.convert_timezone(F.lit("UTC"), F.lit(zone), closes)).cast("timestamp_ntz"),
        "isfirst": F.col("bar_index") == 0,
        "islast": left == 0,
        "ishistory": left > 0,
        "isrealtime": left == 0,
        "isnew": F.lit(not live),
        "isconfirmed": closes <= F.col("timenow"),
        "islastconfirmedhistory": F.when(left == 0, ended).when(left == 1, ~ended).otherwise(False),
        "ismarket": F.lit(True),
        "ispremarket": F.lit(False),
        "ispostmarket": F.lit(False),
    }
    return rows.withColumns(flags).select(*bars.columns, *NAMES)
