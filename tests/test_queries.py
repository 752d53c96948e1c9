"""Every registered query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
import check_oracle
from eventide.queries import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return check_oracle.duck(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf, name):
    ok, note = check_oracle.compare(spark, con, name, QUERIES[name], SQL.get(name), sf)
    assert ok, note


def test_contract(spark):
    assert set(SQL) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "hour_start_utc"
