"""Every registered query runs on the smallest tables, and agrees with its SQL where it has one."""

import pytest

import __spark_entry__ as entry_point
from tests.conftest import SF
from tools.check import compare

NAMES = sorted(entry_point.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert df.collect() is not None
    else:
        err, _ = compare(df, sql, con)
        assert err is None, err


def test_entry_returns_events(spark):
    out = entry_point.entry(spark)
    assert out.count() > 0
    assert "intensity_max" in out.columns


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
