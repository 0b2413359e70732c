"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for all nodes of ``edges`` (``a``, ``b``).

    Each round, a node takes the least root among its own and its neighbours', and then its root's root, so
    long chains halve.  Every round's table is kept in the shared folder, and a large one is broadcast by no join.
    Null ends are ignored; an empty table gives no rows.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = C.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = C.cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
    many = roots.count()
    while True:
        near = both.join(C.side(roots, many), F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(C.side(near, many), F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("at"), F.col("root").alias("far"))
        jumped = step.join(C.side(jump, many), F.col("root") == F.col("at"))
        new = C.cut(jumped.select("node", F.least("root", "far").alias("root"), (F.least("root", "far") != F.col("old")).alias("moved")))
        roots = new.select("node", "root")
        if new.filter("moved").limit(1).count() == 0:
            return roots
