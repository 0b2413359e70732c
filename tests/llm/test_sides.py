"""Tables that grow with the corpus are broadcast by no join: each would lie on the driver several times over."""

import pytest

from treeline.llm import common as C
from treeline.llm import graph, neardup


@pytest.fixture
def plans(monkeypatch):
    """The plans, as they ran, of all tables kept from here on; all but the smallest are large."""
    ran, cut = [], C.cut

    def watched(df):
        out = cut(df)
        ran.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(C, "cut", watched)
    monkeypatch.setattr(graph, "cut", watched, raising=False)
    monkeypatch.setattr(C, "BROADCAST_ROWS", 10, raising=False)
    return ran


def test_components_keep_large_tables_off_the_driver(spark, plans):
    edges = spark.range(300).selectExpr("id AS a", "CASE WHEN id % 30 = 29 THEN id ELSE id + 1 END AS b")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {n: n // 30 * 30 for n in range(300)}
    assert len(plans) > 3 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_near_duplicates_broadcast_clusters_beyond_a_block_only(spark, plans):
    text = lambda i, j: " ".join(f"g{i}w{k}" for k in range(40)) + f" end{j}"
    rows = [(i * 3 + j, text(i, j)) for i in range(60) for j in range(3)]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    assert {r["id"]: r["component_id"] for r in found.collect()} == {n: n // 3 * 3 for n, _ in rows}
    joins = [line for p in plans for line in p.split("\n") if "BroadcastHashJoin" in line and "cluster" not in line]
    assert plans and not joins
