"""Dependency order in waves, and tests placed after their subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.operators.peel import peeled
from treeline.operators.rank import numbered_within


def waves(nodes: list[str], needs: dict[str, set[str]], tie: dict[str, tuple]) -> list[str]:
    """Nodes so that each follows those it needs; each wave by its tie-break.  On a cycle, the node with the
    fewest needs open, and then the least name, goes next.  For a few nodes at hand; ``dependency_order`` is for tables."""
    here = set(nodes)
    open_needs = {n: {m for m in needs.get(n, ()) if m in here and m != n} for n in nodes}
    users: dict[str, list[str]] = {}
    for n, many in open_needs.items():
        for m in many:
            users.setdefault(m, []).append(n)
    out: list[str] = []
    left = set(nodes)
    ready = [n for n in nodes if not open_needs[n]]
    while left:
        wave = sorted(ready, key=lambda n: (tie[n], n)) or [min(left, key=lambda n: (len(open_needs[n]), n))]
        ready = []  # a need is discarded once, so a user gets here once
        for n in wave:
            left.discard(n)
            out.append(n)
        for n in wave:
            for user in users.get(n, ()):
                open_needs[user].discard(n)
                if user in left and not open_needs[user]:
                    ready.append(user)
    return out


def dependency_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``chapter``, ``node``, ``ordinal``: each chapter's nodes in waves, a wave by tie and name.

    ``nodes`` has chapter, node, tie (string; null first, as if empty); ``edges`` has chapter, from, to, where ``from``
    needs ``to``.  On a cycle, the node with the fewest needs open, and then the least name, goes next.  Waves are
    peeled by joins and numbers come from a range sort, so a chapter may be of any size.
    """
    own = nodes.select(F.col("chapter").alias("group"), "node", F.coalesce("tie", F.lit("")).alias("tie"))
    need = edges.select(F.col("chapter").alias("group"), F.col("from").alias("node"), F.col("to").alias("need"))
    waved = own.repartition("group", "node").groupBy("group", "node").agg(F.max("tie").alias("tie")).hint("merge").join(peeled(own, need), ["group", "node"])
    placed = numbered_within(waved, "group", [F.col("wave"), F.col("tie"), F.col("node")], "ordinal")
    return placed.select(F.col("group").alias("chapter"), "node", "ordinal")


def test_subject(path: Column) -> Column:
    """Name of the file that a test is about, without extension."""
    name = P.stem(P.basename(path))
    return F.regexp_replace(F.regexp_replace(name, r"^test_|_test$|\.(test|spec)$", ""), r"^_+|_+$", "")


def beside_subjects(files: DataFrame) -> DataFrame:
    """``files`` (chapter, path, pos, test) with ``place``: a test comes right after the first file of its
    chapter that it is named for, or at the chapter's end."""
    named = files.filter("NOT test").withColumn("name", P.stem(P.basename(F.col("path"))))
    first = named.groupBy("chapter", "name").agg(F.min("pos").alias("subject"))
    tests = files.filter("test").withColumn("name", test_subject(F.col("path"))).join(first, ["chapter", "name"], "left")
    late = F.coalesce("subject", F.lit(2**31)).cast("long")
    placed = tests.select("chapter", "path", "pos", "test", F.struct(late.alias("at"), F.lit(1).alias("after"), F.col("pos").alias("own")).alias("place"))
    rest = files.filter("NOT test").select("chapter", "path", "pos", "test", F.struct(F.col("pos").cast("long").alias("at"), F.lit(0).alias("after"), F.col("pos").alias("own")).alias("place"))
    return rest.unionByName(placed)
