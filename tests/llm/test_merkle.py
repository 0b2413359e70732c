"""Merkle manifests against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from treeline.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, at):
    for nodes in levels[:-1]:
        run = at - at % 3
        yield nodes[run : run + 3], at - run
        at //= 3


def leaf(row):
    return digest("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS)


def plain(rows):
    """What the query returns, by the contract's words."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: tree([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names}
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[n], key=lambda x: x[:3])):
            way = [*steps(trees[n], i), *steps(top, k)]
            now = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                now["text"] = r["text"].replace("\n", "")
            node = leaf(now)
            for run, p in way:
                node = digest([*run[:p], node, *run[p + 1 :]])
            beside = digest(x for run, p in way for j, x in enumerate(run) if j != p)
            out.append((r["doc_id"], own, trees[n][-1][0], top[-1][0], beside, node, node == top[-1][0]))
    return sorted(out, key=str)


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("strip", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 26, 27, 28, 81, 82, 100, 242, 300])
def test_traversal(size, strip):
    leaves = [digest([str(i)]) for i in range(size)]
    levels = tree(leaves)
    assert merkle.levels(size) == len(levels) - 1
    for extra in (0, 2):  # a last block reaches the others' height by nodes of one
        full = levels + [[digest(levels[-1])]] * (extra > 0) + [[digest([digest(levels[-1])])]] * (extra > 1)
        walked = list(merkle.traverse([x.encode() for x in leaves], len(full) - 1, strip))
        assert len(walked) == size
        for i, path in enumerate(walked):
            assert [x.decode() for x in merkle.siblings(path)] == [x for run, p in steps(full, i) for j, x in enumerate(run) if j != p]
            assert merkle.fold(leaves[i].encode(), path).decode() == full[-1][0] and merkle.unpacked(merkle.packed(path)) == path


def test_traversal_keeps_few_hashes():
    """Two subtrees a strip and open runs, not the tree."""
    size, height, strip = 729, 6, 2
    kept = []
    climbs = []
    grown, climb = merkle.grown, merkle.Climb

    class Counted(climb):
        def __init__(self, level):
            super().__init__(level)
            climbs.append(self)

    merkle.Climb = Counted
    try:
        for _ in merkle.traverse([b"%064d" % i for i in range(size)], height, strip):
            live = climbs[-3 * (len(climbs) // 3) :][-6:]
            kept.append(max(len(c.out) + sum(map(len, c.open)) for c in live))
    finally:
        merkle.Climb = climb
    assert grown is merkle.grown and max(kept) <= 3**strip + 2 * height


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, height):
    rows = [(i, f"t\n{i}" if i % 5 else None, "en" if i % 3 else None, (None, "a", "ü", "z", "A", "")[i % 7 % 6], i if i % 4 else None) for i in range(70)]
    rows += [(100, "alone\n", "en", "one", 5), (None, "no\nid", None, "a", 1), (7, "twice\n", "en", "a", 3), (7, "twice\n", "en", "a", 3), (7, "other", "en", "a", 3)]
    rows += [(1000 + i, "hot\n", "en", "hot", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named = docs.withColumns({c: F.lit(1) for c in ("tree", "pos", "size", "hash", "leaf", "block", "path", "id", "name", "other")})
    got = merkle.manifest(named, altered={"text": tampered()}, height=height)
    assert sorted(map(tuple, got.collect()), key=str) == plain([r.asDict() for r in docs.collect()])


def test_query(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.op13_merkle_manifest(spark, sf)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, df.collect()), key=str) == plain(rows)


def test_siblings_prove_and_one_changed_row_tells(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    changed = F.when(F.col("doc_id") == 5, "forged").otherwise(F.col("text"))
    got = {r["id"]: r for r in merkle.manifest(docs, altered={"text": changed}, height=1, with_siblings=True).collect()}
    assert [i for i, r in got.items() if not r["verified"]] == [5]
    assert all(hashlib.sha256("".join(r["siblings"]).encode()).hexdigest() == r["proof_sha256"] for r in got.values())


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).collect() == []


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumns({"source": F.col("bucket"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(1)})
    rows = [r.asDict() for r in docs.collect()]
    assert sorted(map(tuple, merkle.manifest(docs, altered={"text": tampered()}).collect()), key=str) == plain(rows)
