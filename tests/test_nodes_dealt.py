import pytest

from treeline import source_queries as SQ
from treeline.operators import order as O
from treeline.operators import peel


def test_nodes_of_a_small_file_are_not_broadcast(spark, sf, monkeypatch):
    """A file may hold far more than its size tells, so no table of all nodes is a broadcast one."""
    nodes, edges = SQ.cyclic(spark, sf)
    plans, kept = [edges._jdf.queryExecution().executedPlan().toString()], peel.kept

    class Enough(Exception):
        pass

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        if len(plans) == 3:  # nodes, and edges between them
            raise Enough
        return kept(df)

    monkeypatch.setattr(peel, "kept", watched)
    with pytest.raises(Enough):
        O.dependency_order(nodes, edges)
    assert not [p for p in plans if "BroadcastHashJoin" in p]
