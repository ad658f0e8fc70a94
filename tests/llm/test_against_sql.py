"""The queries that SQL can express, on the driver's smallest tables."""

import pytest

from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", [*ORACLES])
def test_query(spark, sf, duck, rows, name):
    found, expected = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
