"""Every query with SQL gives DuckDB's rows; every other one gives rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from barweave import catalog  # noqa: E402
from oracle import connect, of_duck, of_spark  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, con):
    got = of_spark(catalog.queries()[name](spark, sf_dir))
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got[1]
    else:
        want = of_duck(con, sql)
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert [r for r, w in zip(got[1], want[1], strict=True) if r != w] == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["symbol", "time", "bar_index", "close", "fast", "slow"]
    assert set(e.oracle_sql()) <= set(e.queries())
