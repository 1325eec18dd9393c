"""Every query with a DuckDB text, compared value by value."""

import __spark_entry__ as entry
import pytest
from compare import connect, diff

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, con, sf, name):
    assert diff(spark, con, sf, entry.queries()[name], SQL[name]) is None


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "city_name" and df.count() == 25
