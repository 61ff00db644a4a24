"""Times on the clocks of a zone, whatever the session's zone is."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barweave.functions import strings, times


@pytest.fixture(params=["UTC", "Asia/Tokyo"])
def session(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_parts_and_timestamps_in_any_session(session):
    t = F.lit("2024-07-01 03:05:00").cast("timestamp_ntz")
    got = session.range(1).select(*[v.alias(k) for k, v in times.parts(t, "America/New_York").items()]).first()
    assert (got.month, got.dayofmonth, got.hour, got.minute) == (6, 30, 23, 5)
    assert one(session, times.timestamp(2024, 6, 30, 23, 5, zone="America/New_York")) == dt.datetime(2024, 7, 1, 3, 5)
    assert one(session, times.timestamp(2023, 14, 0, 25, -1, 61, "UTC+2")) == dt.datetime(2024, 1, 31, 23, 0, 1)
    assert one(session, times.timestamp(F.lit(None).cast("int"), 1, 1)) is None


@pytest.mark.parametrize("local, zone, want", [
    ((1995, 9, 24, 2), "Europe/Berlin", (1995, 9, 24, 1)), ((1995, 9, 24, 1, 59, 59), "Europe/Berlin", (1995, 9, 23, 23, 59, 59)), ((1995, 9, 24, 3), "Europe/Berlin", (1995, 9, 24, 2)),
    ((1996, 3, 31, 2, 30), "Europe/Berlin", (1996, 3, 31, 1, 30)), ((2024, 11, 3, 1, 30), "America/New_York", (2024, 11, 3, 6, 30)), ((2024, 4, 7, 1, 45), "Australia/Lord_Howe", (2024, 4, 6, 15, 15)),
    ((1969, 9, 30, 12), "Pacific/Kwajalein", (1969, 10, 1)), ((2024, 11, 3, 1, 30), "UTC-5", (2024, 11, 3, 6, 30)), ((2024, 11, 3, 1, 30), "UTC", (2024, 11, 3, 1, 30))])
def test_of_a_time_that_clocks_show_twice_the_later_counts(session, local, zone, want):
    assert one(session, times.timestamp(*local, zone=zone)) == dt.datetime(*want)
    assert one(session, times.timestamp_of(F.lit(str(dt.datetime(*local))), zone)) == dt.datetime(*want)


@pytest.mark.parametrize("text, zone, want", [
    ("2024-01-31", "UTC", (2024, 1, 31)), ("2024-01-31 10:00", "UTC+1", (2024, 1, 31, 9)), (" 2024-01-31T10:00:30Z ", "Asia/Tokyo", (2024, 1, 31, 10, 0, 30)),
    ("2024-01-31T10:00:00-03:30", "UTC", (2024, 1, 31, 13, 30)), ("Wed, 31 Jan 2024 10:00:00 +0200", "UTC", (2024, 1, 31, 8)), ("1 feb 2024", "GMT-5", (2024, 2, 1, 5)),
    ("31 Anf 2024", "UTC", None), ("soon", "UTC", None), ("", "UTC", None), ("2024-02-30", "UTC", None)])
def test_timestamps_of_texts(session, text, zone, want):
    assert one(session, times.timestamp_of(F.lit(text), zone)) == (want and dt.datetime(*want))


def test_formats(session):
    t = F.lit("2024-01-31 20:05:09").cast("timestamp_ntz")
    assert one(session, strings.format_time(t)) == "2024-01-31T20:05:09+0000"
    assert one(session, strings.format_time(t, "EEE D h:mm a 'o''clock' Z", "UTC-03:30")) == "Wed 31 4:35 PM o'clock -0330"
    assert one(session, strings.format_time(F.lit(None).cast("timestamp_ntz"))) is None
