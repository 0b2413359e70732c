"""Peeling by joins against plain loops: cycles, groups of one, unknown ends, and many edges."""

import random
import time

from treeline.operators import graph as G
from treeline.operators import order as O
from treeline.operators.peel import peeled
from treeline.operators.rank import numbered_within
from treeline.plans import architecture as AR


def test_order_with_cycles_against_a_loop(spark):
    rng = random.Random(4)
    nodes, edges, want = [], [], {}
    for c in range(6):
        names = [f"n{i:02d}" for i in range(rng.randint(1, 14))]
        own = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 26))}
        tie = {n: rng.choice(["a", "b", "c", None]) for n in names}
        nodes += [(f"c{c}", n, tie[n]) for n in names]
        edges += [(f"c{c}", a, b) for a, b in own] + [(f"c{c}", "n00", "elsewhere"), ("no chapter", "n00", "n01")]
        needs = {n: {b for a, b in own if a == n} for n in names}
        for i, n in enumerate(O.waves(sorted(names), needs, {n: (tie[n] or "",) for n in names})):
            want[f"c{c}", n] = i + 1
    got = O.dependency_order(spark.createDataFrame(nodes, "chapter string, node string, tie string"), spark.createDataFrame(edges, "chapter string, from string, to string"))
    assert {(r["chapter"], r["node"]): r["ordinal"] for r in got.collect()} == want


def test_layers_with_cycles_against_a_loop(spark):
    rng = random.Random(5)
    names = [f"p{i:02d}" for i in range(20)]
    edges = sorted({(rng.choice(names[:16]), rng.choice(names[:16])) for _ in range(30)})
    rows, alone = G.layers(names, [e for e in edges if e[0] != e[1]])
    got = AR.layered(spark.createDataFrame([(n,) for n in names], "root string"), spark.createDataFrame([*edges, ("p00", "gone")], "from string, to string"))
    assert {r["root"]: r["layer"] for r in got.collect()} == {n: i for i, row in enumerate(rows) for n in row} | {n: None for n in alone}


def test_many_edges_of_one_group(spark):
    """100,000 edges over five layers: as many rounds as layers, whatever a layer holds."""
    rng = random.Random(6)
    width = 4000
    edges = list({("g", f"{k}/{rng.randrange(width)}", f"{k - 1}/{rng.randrange(width)}") for k in range(1, 5) for _ in range(26000)})
    assert len(edges) > 100_000
    nodes = spark.createDataFrame(sorted({("g", x) for _, a, b in edges for x in (a, b)}), "group string, node string")
    began = time.time()
    got = {r["node"]: r["wave"] for r in peeled(nodes, spark.createDataFrame(edges, "group string, node string, need string")).collect()}
    assert time.time() - began < 120
    depth = {}
    for _, a, b in sorted(edges, key=lambda e: int(e[1].split("/")[0])):
        depth[a] = max(depth.get(a, 0), depth.setdefault(b, 0) + 1)
    assert got == depth


def test_nothing_to_peel(spark):
    empty = spark.createDataFrame([], "group string, node string, need string")
    assert peeled(empty.select("group", "node"), empty).collect() == []
    one = spark.createDataFrame([("a", "x", "x"), ("a", "x", "y")], "group string, node string, need string")
    assert [tuple(r) for r in peeled(one.select("group", "node"), one).collect()] == [("a", "x", 0)]


def test_places_within_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(1000), i) for i in range(700)]
    got = numbered_within(spark.createDataFrame(rows, "g string, v long, i long").repartition(7), "g", ["v", "i"]).collect()
    for g in ("hot", "a", "b", None):
        own = sorted((v, i) for h, v, i in rows if h == g)
        assert [(r["v"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])] == own
        assert sorted(r["place"] for r in got if r["g"] == g) == list(range(1, len(own) + 1))
