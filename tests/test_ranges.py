"""The store and its manifest, the cache that fetches no range twice, pages, sessions over clock changes, history at any distance."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barweave.functions import sessions
from barweave.operators import pages, ta
from barweave.sources import store as S

T0 = dt.datetime(2024, 3, 1)
MINUTE = dt.timedelta(minutes=1)
BARS = "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double"


def bars_of(spark, symbol, first, count, close=1.0):
    return spark.createDataFrame([(symbol, first + k * MINUTE, 1.0, 2.0, 0.5, close, float(k)) for k in range(count)], BARS)


def test_missing_ranges_equal_minute_by_minute(spark):
    rng = random.Random(6)

    def ranges(n):
        out = []
        for _ in range(n):
            a = rng.randrange(200)
            out.append((rng.choice("xyz"), T0 + a * MINUTE, T0 + (a + rng.choice([0, 1, 5, 30, -2])) * MINUTE))
        return out

    requests, covered = ranges(30), ranges(25) + [(None, T0, T0 + MINUTE), ("x", None, T0)]
    schema = "symbol string, start timestamp_ntz, end timestamp_ntz"
    got = S.missing(spark.createDataFrame(requests, schema), spark.createDataFrame(covered, schema)).collect()
    want = set()
    for symbol in "xyz":
        need = {k for s, a, b in requests if s == symbol for k in range(300) if a <= T0 + k * MINUTE < b}
        need -= {k for s, a, b in covered if s == symbol and a for k in range(300) if a <= T0 + k * MINUTE < b}
        for k in sorted(need):
            if k - 1 not in need:
                end = next(e for e in range(k, 400) if e not in need)
                want.add((symbol, T0 + k * MINUTE, T0 + end * MINUTE))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 4


def test_no_range_is_fetched_twice(spark, tmp_path):
    asked = []

    def fetch(spark, symbol, timeframe, start, end):
        asked.append((symbol, start, end))
        return bars_of(spark, symbol, start, int((end - start) / MINUTE))

    cache = S.Cache(S.Store(spark, str(tmp_path / "s"), chunk=40), fetch)
    at = lambda k: T0 + k * MINUTE
    assert cache.get("A", "1", at(0), at(100)).count() == 100 and asked == [("A", at(0), at(100))]
    assert cache.get("A", "1", at(20), at(80)).count() == 60 and len(asked) == 1
    got = cache.get("A", "1", at(-10), at(130))
    assert [r.time for r in got.orderBy("bar_index").collect()] == [at(k) for k in range(-10, 130)]
    assert asked[1:] == [("A", at(-10), at(0)), ("A", at(100), at(130))]
    assert cache.get("B", "1", at(50), at(60)).count() == 10 and asked[3:] == [("B", at(50), at(60))]
    assert cache.fill([("A", "1", at(120), at(140)), ("A", "1", at(135), at(150)), ("A", "1", at(0), at(9)), ("B", "5", at(0), at(5))]) == 2
    assert asked[4:] == [("A", at(130), at(150)), ("B", at(0), at(5))]
    again = S.Cache(S.Store(spark, str(tmp_path / "s")), fetch)  # what is covered outlives the process
    assert again.get("A", "1", at(-10), at(150)).count() == 160 and len(asked) == 6
    assert again.get("A", "1", at(5), at(5)).count() == 0 and again.get("A", "1", at(5), at(1)).count() == 0
    again.store.put(bars_of(spark, "A", at(0), 3, close=9.0), "1")  # by hand, over what was there
    assert [r.close for r in again.get("A", "1", at(0), at(5)).orderBy("bar_index").collect()] == [9.0, 9.0, 9.0, 1.0, 1.0]


def test_only_chunks_that_meet_the_range_are_read(spark, tmp_path):
    st = S.Store(spark, str(tmp_path / "s"), chunk=50)
    st.put(bars_of(spark, "A", T0, 500).unionAll(bars_of(spark, "B", T0, 120)), "1")
    rows = st.manifest().collect()
    assert sorted((r.symbol, r.rows) for r in rows) == [("A", 50)] * 10 + [("B", 20)] + [("B", 50)] * 2
    got = st.get("A", "1", T0 + 120 * MINUTE, T0 + 201 * MINUTE)
    assert got.count() == 81 and {r.bar_index for r in got.collect()} == set(range(81))
    assert len(got.inputFiles()) == 3 == st.hits and st.misses == 0
    assert st.get("A", "5", T0, T0 + MINUTE).count() == 0 and st.get("C", "1", T0, T0 + MINUTE).count() == 0 and st.misses == 2
    s = st.stats().first()
    assert (s.folders, s.bars, s.hits, s.misses, s.evictions, s.hit_rate) == (13, 620, 3, 2, 0, 0.6)
    st.get("B", "1", T0, T0 + MINUTE)
    assert st.evict(4) == 9 and st.stats().first().folders == 4 and st.evict(4) == 0
    kept = {(r.symbol, r.first) for r in st.manifest().collect()}
    assert kept == {("A", T0 + k * MINUTE) for k in (100, 150, 200)} | {("B", T0)}  # those used last
    assert st.get("A", "1", T0, T0 + 500 * MINUTE).count() == 150
    assert len(list((tmp_path / "s" / "bars").rglob("part-*.parquet"))) == 4


def test_pages(spark, tmp_path):
    df = spark.range(1037).select(((F.col("id") * 7919) % 1037).alias("k"), (F.col("id") % 5).alias("v"), F.col("id"))
    pages.write(df, str(tmp_path / "p"), F.floor(F.col("k") / 100), ("k",), 100)
    for n in (0, 3, 10, 11):
        got = pages.nth(spark, str(tmp_path / "p"), n)
        assert sorted(r.k for r in got.collect()) == list(range(1037))[100 * n : 100 * n + 100]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert f"(page#" in plan and f"= {n})" in plan and "PartitionFilters: [isnotnull(page" in plan
    files = pages.nth(spark, str(tmp_path / "p"), 3)
    assert files.select(F.input_file_name()).distinct().count() == 1
    assert [r.k for r in pages.after(spark, str(tmp_path / "p"), ("k",), (250,), 5).collect()] == [251, 252, 253, 254, 255]
    two = [(r.v, r.k) for r in pages.after(spark, str(tmp_path / "p"), ("v", "k"), (1, 1030), 4).collect()]
    want = sorted((r.v, r.k) for r in df.collect())
    assert two == [x for x in want if x > (1, 1030)][:4]
    with pytest.raises(ValueError, match="a row"):
        pages.paged(df, F.lit(0), ("k",), 0)
    assert pages.paged(df.limit(0), F.floor(F.col("k") / 100), ("k",), 5).count() == 0


def test_sessions_over_clock_changes(spark):
    cal = {str(r.day): r for r in sessions.calendar(spark, "0930-1600:23456", "America/New_York", "2024-03-07", "2024-11-05").collect()}
    assert "2024-03-09" not in cal and "2024-03-10" not in cal  # a weekend, and the Sunday of the change
    hour = lambda d: (cal[d].opens.hour, cal[d].opens.minute, cal[d].closes.hour)
    assert hour("2024-03-08") == (14, 30, 21) and hour("2024-03-11") == (13, 30, 20)
    assert hour("2024-11-01") == (13, 30, 20) and hour("2024-11-04") == (14, 30, 21)
    night = {str(r.day): (r.closes - r.opens).total_seconds() / 3600 for r in sessions.calendar(spark, "2200-0400", "Europe/Berlin", "2024-03-29", "2024-10-28").collect()}
    assert night["2024-03-29"] == 6 and night["2024-03-30"] == 5 and night["2024-10-26"] == 7
    two = sessions.calendar(spark, "0900-1130,1230-1500:2", "Asia/Tokyo", "2024-01-01", "2024-01-08").collect()
    assert [(r.opens.hour, r.opens.minute, r.closes.hour) for r in sorted(two)] == [(0, 0, 2), (3, 30, 6)] * 2
    assert sessions.calendar(spark, "24x7", "UTC", "2024-01-01", "2024-01-02").count() == 2
    for bad in ("9-16", "0930-1600:8", "0960-1000", "x"):
        with pytest.raises(ValueError):
            sessions.parse(bad)


def test_bars_in_sessions(spark):
    bars = spark.createDataFrame([(s, dt.datetime(2024, 3, d, h, 30), 1.0) for s in "ab" for d in (8, 11) for h in range(24) if s == "a" or h != 15], "symbol string, time timestamp_ntz, close double")
    cal = sessions.calendar(spark, "0930-1600:23456", "America/New_York", "2024-03-07", "2024-03-12")
    got = sessions.opened(sessions.placed(bars, cal, 3600), 1).orderBy("symbol", "time").collect()
    a = [(r.time.day, r.time.hour, r.session_bar, r.is_first, r.is_last) for r in got if r.symbol == "a"]
    assert a == [(8, h, h - 14, h == 14, h == 20) for h in range(14, 21)] + [(11, h, h - 13, h == 13, h == 19) for h in range(13, 20)]
    last = [r for r in got if r.symbol == "a" and r.is_last]
    assert [r.time_close.hour * 60 + r.time_close.minute for r in last] == [21 * 60, 20 * 60]  # the session's end, not the bar's
    assert {(r.time.day, r.session_open and (r.session_open.day, r.session_open.hour)) for r in got} == {(8, None), (11, (8, 14))}
    assert len([r for r in got if r.symbol == "b"]) == 12


def test_history_at_a_distance_that_varies(spark):
    rng = random.Random(1)
    rows = [(s, i, float(i), rng.choice([None, -1, 0, 1, 3, 50])) for s in ("a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, bar_index int, close double, n int")
    got = {(r.symbol, r.bar_index): r.was for r in ta.history(df, "was", F.col("close"), F.col("n")).collect()}
    assert got == {(s, i): c - n if n is not None and 0 <= n <= i else None for s, i, c, n in rows}
    assert "Window" not in ta.history(df, "was", F.col("close"), F.col("n"))._jdf.queryExecution().executedPlan().toString()
