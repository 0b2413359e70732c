"""Peeling a graph wave by wave, as joins: what is needed first, and what depends on nothing left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.plans.session import kept


def peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (group, node) with ``wave`` (from 0): each wave holds, per group, the nodes whose needs all lie in earlier ones.

    ``edges`` has group, node, need; edges to oneself, to unknown nodes and repeated ones don't count.  Where all that is left
    of a group waits for each other, the node with the fewest open needs, and then the least, goes alone.

    One round a wave for all groups together: the last wave meets the edges that need it, and the counts of open needs
    fall.  A group is never one task's: rows are dealt by node, before repeated ones are
    looked for, as an input of few files would else be few tasks' to hold.  Every round's table is kept by checkpoint.
    """
    nodes = kept(nodes.select("group", "node").repartition("group", "node").distinct())
    real = edges.select("group", "node", "need").filter("node <> need").repartition("group", "node", "need").distinct()
    known = nodes.hint("merge")  # never broadcast: Spark may judge it by the files it came from, which are far smaller
    real = real.join(known, ["group", "node"], "left_semi").join(known.select("group", F.col("node").alias("need")), ["group", "need"], "left_semi")
    edge = kept(real.repartition("group", "need"))
    needs = edge.groupBy("group", "node").agg(F.count("*").alias("open"))
    left = kept(nodes.join(needs, ["group", "node"], "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long"))))
    out, n = None, 0
    while True:
        ready = left.filter("open = 0").select("group", "node")
        least = left.groupBy("group").agg(F.min(F.struct("open", "node")).alias("least")).filter("least.open > 0")
        wave = kept(ready.unionByName(least.select("group", F.col("least.node").alias("node"))).withColumn("wave", F.lit(n).cast("long")))
        if wave.isEmpty():
            return wave if out is None else out
        out = wave if out is None else out.unionByName(wave)
        if n % 16 == 15:
            out = kept(out)
        met = edge.join(wave.select("group", F.col("node").alias("need")), ["group", "need"]).groupBy("group", "node").agg(F.count("*").alias("met"))
        rest = left.join(wave, ["group", "node"], "left_anti").join(met, ["group", "node"], "left")
        left = kept(rest.select("group", "node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")))
        n += 1
