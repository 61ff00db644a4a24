"""A calendar of trading sessions: when each opens and closes as instants, and bars placed in it.

A session spec is ``HHMM-HHMM`` ranges, comma-separated, and after a colon the days it opens on, 1 for Sunday to 7 for
Saturday, in an exchange's time zone. The calendar turns each day's local times into UTC, so clocks that are put
forward or back make a session an hour earlier or later in UTC, or shorter or longer where it lasts over the change. A range that ends
at or before its begin ends on the next day. Local times that a change leaves out count as an hour later.

Bars meet sessions by a bucket, the UTC day: a session stands once for each day that it touches, and a bar in its own, so
the join is one of equal keys with a range check on few rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400


def parse(spec: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Ranges in minutes of the day, and days."""
    ranges, _, days = spec.strip().partition(":")
    if ranges == "24x7":
        ranges = "0000-0000"
    out = []
    for part in ranges.split(","):
        a, _, b = part.partition("-")
        if len(a) != 4 or len(b) != 4 or not (a + b).isdigit() or int(a[2:]) > 59 or int(b[2:]) > 59 or int(a) > 2359 or int(b) > 2400:
            raise ValueError(f"no session: {spec}")
        a, b = int(a[:2]) * 60 + int(a[2:]), int(b[:2]) * 60 + int(b[2:])
        out.append((a, b if b > a else b + 1440))
    if not set(days) <= set("1234567"):
        raise ValueError(f"no days of a week: {spec}")
    return out, {int(d) for d in days or "1234567"}


def calendar(spark: SparkSession, spec: str, zone: str, first: str, last: str) -> DataFrame:
    """(day, opens, closes): a row for each session that opens on the local days first to last, times in UTC without a zone."""
    ranges, days = parse(spec)
    dates = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day").where(F.dayofweek("day").isin(*days))
    each = dates.select("day", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges])).alias("r"))

    def utc(minutes: Column) -> Column:
        midnight = F.date_add("day", F.floor(minutes / 1440).cast("int")).cast("timestamp_ntz")
        local = midnight + F.make_dt_interval(mins=minutes % 1440)
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)

    return each.select("day", utc(F.col("r.a")).alias("opens"), utc(F.col("r.b")).alias("closes"))


def placed(bars: DataFrame, calendar: DataFrame, seconds: int) -> DataFrame:
    """The bars that begin within a session, with its day, opens, closes, when they close (with the session at the latest), their
    number in the session, and whether they are its first and last. Bars of seconds; sessions must not overlap."""

    def day(t: Column) -> Column:
        return F.datediff(t.cast("date"), F.lit("1970-01-01"))

    touched = calendar.where("opens < closes").withColumn("_day", F.explode(F.sequence(day(F.col("opens")), day(F.col("closes")))))
    met = bars.withColumn("_day", day(F.col("time"))).join(touched, "_day").where("time >= opens and time < closes").drop("_day")
    w = Window.partitionBy("symbol", "opens").orderBy("time")
    ends = F.col("time") + F.make_dt_interval(secs=F.lit(seconds))
    return met.withColumns(
        {
            "time_close": F.least(ends, F.col("closes")),
            "session_bar": F.row_number().over(w) - 1,
            "is_first": F.lag("time").over(w).isNull(),
            "is_last": F.lead("time").over(w).isNull(),
        }
    )


def opened(bars: DataFrame, back: int = 0) -> DataFrame:
    """placed() bars with session_open: when the session began that was so many sessions of the symbol before each bar's."""
    days = bars.select("symbol", "opens").distinct()
    earlier = days.withColumn("session_open", F.lag("opens", back).over(Window.partitionBy("symbol").orderBy("opens")) if back else F.col("opens"))
    return bars.join(earlier, ["symbol", "opens"])
