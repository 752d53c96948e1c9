"""Registered text queries against their SQL on the driver's small tables."""

import pytest

import check_oracle
from eventide.llm import queries


@pytest.mark.parametrize("name", queries.SQL)
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, size):
    sf = f"/root/testdata/{size}"
    ok, note = check_oracle.compare(spark, check_oracle.duck(sf), name, queries.QUERIES[name], queries.SQL[name], sf)
    assert ok, note
