"""Every registered query of the engine against the SQL registered for it."""

import pytest

from tidemark.plans import registry


@pytest.mark.parametrize("name", [*registry.ORACLES])
def test_query(spark, sf, duck, rows, name):
    found, expected = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name,column,by", [("hll_distinct", "l_partkey", "l_returnflag"), ("hll_words", "l_suppkey", "l_linestatus")])
def test_distinct_counts_are_close(spark, sf, duck, name, column, by):
    found = {r["d"]: r["v"] for r in registry.QUERIES[name](spark, sf).collect()}
    exact = dict(duck.sql(f"SELECT {by}, count(DISTINCT {column}) FROM lineitem GROUP BY ALL").fetchall())
    assert found.keys() == exact.keys()
    assert all(abs(found[k] - n) <= max(1, 0.03 * n) for k, n in exact.items())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = registry.QUERIES["time_filter_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "o_totalprice" not in plan
    joined = registry.QUERIES["join_dim_left"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined and "Python" not in joined
