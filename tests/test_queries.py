"""Every registered digest query against DuckDB, or at least its columns and rows."""

import pytest

from against import compare
from treeline import plan_queries, source_queries  # noqa: F401  register more
from treeline import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, sf, name):
    compare(spark, sf, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["path", "class", "churn", "in_degree", "loc", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
