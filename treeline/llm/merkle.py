"""Merkle dataset manifest: a ternary hash tree per group of rows and one over the groups' roots, with a proof per row.

Every tree is cut into aligned blocks of ``3 ** HEIGHT`` nodes.  A task holds one block, walks its leaves by fractal
traversal and puts the block's own proof, which the trees above have made before, behind each path.  The trees above are
made the same way from the blocks' roots, so neither a tree's size nor the number of trees meets a single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.llm.common import cut

#: Fixed value: nodes that become one.
FAN = 3
#: Levels of a block, and of the subtrees that the traversal keeps.
HEIGHT, STRIP = 8, 2
DIGEST = 64

Path = list[tuple[int, list[bytes]]]


def digest(parts: list[bytes]) -> bytes:
    """Lower-case hex digest of hex digests written one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(size: int) -> int:
    """Levels above ``size`` nodes until one is left."""
    up = 0
    while size > 1:
        size, up = -(-size // FAN), up + 1
    return up


class Climb:
    """Hashes leaves one by one into nodes of a level above, holding at most two nodes of each level between."""

    def __init__(self, level: int) -> None:
        self.level, self.open, self.out = level, [[] for _ in range(level)], []

    def push(self, node: bytes, at: int = 0) -> None:
        while at < self.level:
            run = self.open[at]
            run.append(node)
            if len(run) < FAN:
                return
            node, self.open[at], at = digest(run), [], at + 1
        self.out.append(node)

    def finish(self) -> list[bytes]:
        """The nodes, after the last leaf: runs that aren't full become nodes too."""
        for at in range(self.level):
            if self.open[at]:
                run, self.open[at] = self.open[at], []
                self.push(digest(run), at + 1)
        return self.out


def grown(bottom: list[bytes], up: int) -> list[list[bytes]]:
    """A subtree's levels from the lowest; the highest is below its top."""
    out = [bottom]
    for _ in range(up - 1):
        below = out[-1]
        out.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def traverse(leaves: list[bytes], height: int, strip: int = STRIP) -> Iterator[Path]:
    """The authentication path of each leaf in turn: by level, the node's place in its run and the run.

    The block's ``height`` levels are cut into strips.  Of each strip the subtree over the present leaf exists, and
    the one to its right, the desired one, grows by a leaf at every step, so that it is whole when the walk gets there.
    So hashes kept at a time are those of two subtrees a strip and the open runs below the desired ones.
    """
    strips = [(low, min(low + strip, height)) for low in range(0, height, strip)]
    existing, desired = [], []
    for low, top in strips:
        first = Climb(low)
        for leaf in leaves[: FAN**top]:
            first.push(leaf)
        if len(leaves) <= FAN**top:
            first.finish()
        existing.append(grown(first.out, top - low))
        desired.append(Climb(low))
    for i in range(len(leaves)):
        for s, (low, top) in enumerate(strips):
            width = FAN**top
            if i and i % width == 0:
                existing[s], desired[s] = grown(desired[s].out, top - low), Climb(low)
            ahead = i + width
            if ahead < len(leaves):
                desired[s].push(leaves[ahead])
                if ahead == len(leaves) - 1:
                    desired[s].finish()
        path: Path = []
        for s, (low, top) in enumerate(strips):
            at = i % FAN**top // FAN**low
            for nodes in existing[s]:
                run = at - at % FAN
                path.append((at - run, nodes[run : run + FAN]))
                at //= FAN
        yield path


def fold(node: bytes, path: Path) -> bytes:
    """The root that a node and its path lead to."""
    for place, run in path:
        node = digest([*run[:place], node, *run[place + 1 :]])
    return node


def siblings(path: Path) -> list[bytes]:
    """The other nodes of each run, level by level, left to right."""
    return [x for place, run in path for k, x in enumerate(run) if k != place]


def packed(path: Path) -> bytes:
    return b"".join(bytes([place, len(run)]) + b"".join(run) for place, run in path)


def unpacked(raw: bytes) -> Path:
    out, at = [], 0
    while at < len(raw):
        place, many = raw[at], raw[at + 1]
        out.append((place, [raw[at + 2 + DIGEST * k : at + 2 + DIGEST * (k + 1)] for k in range(many)]))
        at += 2 + DIGEST * many
    return out


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (tree, ...) with ``pos`` and ``size``: a row's place in its tree, from 0, and how many the tree has.

    Rows are range-sorted and kept; a place is the rows of the tree in earlier partitions plus the place inside, so a tree
    with most of all rows is no task's alone.
    """
    held = cut(cut(rows).repartitionByRange(F.col("tree"), *order).sortWithinPartitions("tree", *order))
    held = held.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    runs = held.groupBy("tree", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    by = W.partitionBy("tree")
    before = F.coalesce(F.sum("__n").over(by.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "__part", "__first", before.alias("__before"), F.sum("__n").over(by).alias("size"))
    pos = F.col("__before") + F.col("__at") - F.col("__first")
    return held.join(runs, ["tree", "__part"]).withColumn("pos", pos).drop("__at", "__part", "__first", "__before")


def _blocks(rows: DataFrame, height: int) -> DataFrame:
    """Rows dealt by block, each block's together and in order."""
    return rows.withColumn("block", F.expr(f"pos div {FAN**height}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block, whatever batches they come in."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != (rows[0]["tree"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _batched(rows: Iterator[dict], schema: pa.Schema, many: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) >= many:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``tree``, ``pos``, ``size``, ``hash`` of the blocks' roots, for ``nodes`` of the same columns."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("hash", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for rows in _runs(batches):
                size = rows[0]["size"]
                climb = Climb(min(height, levels(size)))
                for r in rows:
                    climb.push(r["hash"])
                yield {"tree": rows[0]["tree"], "pos": rows[0]["block"], "size": -(-size // FAN**height), "hash": climb.finish()[0]}

        yield from _batched(each(), schema)

    return _blocks(nodes.select("tree", "pos", "size", "hash"), height).mapInArrow(run, "tree string, pos long, size long, hash binary")


def climbed(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, the roots of those blocks and so on; of the last, each tree has one."""
    out = [nodes]
    while True:
        out.append(cut(roots(out[-1], height)))
        if (out[-1].agg(F.max("size")).first()[0] or 1) == 1:
            return out


def _headed(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Blocks of ``nodes``, each behind a row of position -1 that holds the path of the block's root."""
    head = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.col("path").alias("__path"))
    body = nodes.withColumn("block", F.expr(f"pos div {FAN**height}"))
    return body.unionByName(head, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def paths(nodes: DataFrame, above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``tree``, ``pos``, ``path``: the packed path of each node to the last root; ``above`` has those of the blocks' roots."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for head, *rows in _runs(batches):
                own = traverse([r["hash"] for r in rows], min(height, levels(rows[0]["size"])))
                for r, path in zip(rows, own):
                    yield {"tree": r["tree"], "pos": r["pos"], "path": packed(path) + head["__path"]}

        yield from _batched(each(), schema)

    return _headed(nodes.select("tree", "pos", "size", "hash"), above, height).mapInArrow(run, "tree string, pos long, path binary")


def field(c: Column) -> Column:
    """A value in a leaf: ``-`` for null, else its bytes' number, ``:`` and itself."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """Lower-case hex digest of a row."""
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    altered: dict[str, Column] | None = None, height: int = HEIGHT, with_siblings: bool = False,
) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``: a row per row of ``docs``.

    Leaves of a group ascend by key (nulls first), rows of one key by their digest; groups by name, null first.
    ``altered`` gives columns as somebody else has them now: ``folded_root`` is where these and the proof lead, and
    ``verified`` says whether that is the root.  ``with_siblings`` adds the proof itself, ``siblings array<string>``.
    A null group is a group, a null value isn't an empty one, and repeated rows have a leaf each.  An empty table gives no
    rows.  Only the key, the group and the fields are read.  Texts are hashed where they lie; digests alone are shuffled.
    """
    now = [(altered or {}).get(c, F.col(c)) for c in fields]
    one, other = leaf([F.col(c) for c in fields]), leaf(now)
    rows = docs.select(
        F.col(key).alias("id"), F.col(group).cast("string").alias("name"), field(F.col(group)).alias("tree"), F.encode(one, "utf-8").alias("hash"),
        F.when(one != other, F.encode(other, "utf-8")).alias("other"),
    )
    kind = docs.schema[key].dataType
    nodes = cut(placed(rows, [F.col("id").asc_nulls_first(), F.col("hash")]))
    trees = climbed(nodes.select("tree", "pos", "size", "hash"), height)
    names = nodes.filter("pos = 0").select("tree", "name")
    tops = trees[-1].select("tree", "hash").join(names, "tree").select(F.lit("").alias("tree"), "name", F.col("tree").alias("of"), "hash")
    top = cut(placed(tops, [F.col("name").asc_nulls_first()]))
    whole = climbed(top.select("tree", "pos", "size", "hash"), height)
    above = whole[-1].select("tree", "pos", F.lit(b"").alias("path"))
    for level in reversed(whole[:-1]):
        above = paths(level, above, height)
    above = top.select("tree", "pos", "of").join(above, ["tree", "pos"]).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    for level in reversed(trees[1:-1]):
        above = paths(level, above, height)

    text = [("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), *text, *[("siblings", pa.list_(pa.string()))] * with_siblings])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for head, *rows in _runs(batches):
                size = rows[0]["size"]
                own = min(height, levels(size))
                upper = unpacked(head["__path"])
                ends = b"".join(siblings(upper))
                found = subroot = root = None
                for r, path in zip(rows, traverse([r["hash"] for r in rows], own)):
                    if root is None:
                        found = fold(r["hash"], path)
                        subroot = fold(found, upper[: levels(size) - own])
                        root = fold(subroot, upper[levels(size) - own :])
                    beside = siblings(path)
                    block = fold(r["other"] or r["hash"], path)
                    folded = root if block == found else fold(block, upper)
                    out = {
                        "tree": r["tree"], "pos": r["pos"], "leaf": r["hash"].decode(), "subroot": subroot.decode(), "root": root.decode(),
                        "proof_sha256": hashlib.sha256(b"".join(beside) + ends).hexdigest(), "folded_root": folded.decode(),
                    }
                    if with_siblings:
                        out["siblings"] = [x.decode() for x in beside + siblings(upper)]
                    yield out

        yield from _batched(each(), schema)

    ddl = "tree string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", siblings array<string>" * with_siblings
    done = _headed(nodes.select("tree", "pos", "size", "hash", "other"), above, height).mapInArrow(run, ddl)
    ids = nodes.select("tree", "pos", F.col("id").cast(kind).alias("id"))
    return ids.join(done, ["tree", "pos"]).select("id", *[f.name for f in schema][2:], (F.col("folded_root") == F.col("root")).alias("verified"))
