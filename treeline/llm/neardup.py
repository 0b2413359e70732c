"""MinHash near-duplicates with odd sketches.

Documents are sets of word shingles.  MinHash samples are cut into bands; documents that agree on a band are
candidates.  The samples are also folded into an odd sketch, a bitmap of parities: the population count of
two sketches' XOR estimates the sets' similarity, most precisely where it is high, and spares the other
candidates the confirmation on full sets.

Candidates are compared inside clusters (components of the candidate graph).  Only links between parts that
aren't connected yet are confirmed, so a group of n copies costs about n confirmations, not n squared.
Clusters beyond a block are compared in blocks that share some members, and what these leave unconnected
is compared with the whole cluster, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm import common as C
from treeline.llm.anchors import numbered
from treeline.llm.graph import components

#: Production parameters.  With 40 bands of 6 samples, a pair at similarity 0.8 is missed with probability 5e-6.
SHINGLE, PERCENT, BANDS, ROWS, SKETCH_BITS = 5, 80, 40, 6, 1024
#: A sketch's estimate rules a pair out only this far below the threshold (5 standard deviations at 0.8).
MARGIN = 0.14
#: Members of a cluster that one task compares at once, the shingles they hold, and members that all blocks of a
#: larger cluster share.
BLOCK, BLOCK_SHINGLES, HUBS = 1500, 1_000_000, 48

_rng = np.random.default_rng(510510)
_BIT = np.array([(b >> np.arange(8)) & 1 for b in range(256)]).sum(1).astype(np.uint8)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, and where each row's begin (one more at the end).

    A row of fewer than k words, but some, has its whole sequence as its one shingle.
    """
    n = len(off) - 1
    starts, ends, rows = C.words(buf, off)
    h = C.hash_words(buf, starts, ends, lower=True)
    counts = C.row_counts(rows, n)
    grams = C.hash_grams(h, k)
    inside = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    g, r = grams[inside], rows[: len(grams)][inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.cumsum(counts) - counts
        whole = []
        for i in short:
            part = h[first[i] : first[i] + counts[i]]
            whole.append(C.mix(C.hash_grams(part, len(part)) + np.uint64(len(part)))[0])
        g, r = np.concatenate([g, np.array(whole, dtype=np.uint64)]), np.concatenate([r, short])
    key = (r.astype(np.uint64) << np.uint64(44)) | (g >> np.uint64(20))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if (g[order[1:]] != g[order[:-1]])[same].any():  # hashes of a row that differ in low bits only may lie mixed
        order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[new], r[new]
    return g, np.searchsorted(r, np.arange(n + 1))


def samples(values: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash samples of each non-empty row, as an array (rows, count)."""
    full = at[1:] > at[:-1]
    first = at[:-1][full]
    out = np.empty((len(first), count), dtype=np.uint64)
    odd = np.random.default_rng(97).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if len(first):
        work = np.empty_like(values)
        for j in range(count):
            np.multiply(values, odd[j], out=work)
            work ^= work >> np.uint64(32)
            work *= odd[count - 1 - j]
            out[:, j] = np.minimum.reduceat(work, first)
    return out


def odd_sketches(sample: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (rows, bits / 8): each sample flips the bit it hashes to."""
    salt = C.powers(sample.shape[1] + 1)[1:]
    place = (C.mix(sample ^ salt) % np.uint64(bits)).astype(np.int64)
    key = np.arange(len(sample))[:, None] * bits + place
    parity = np.bincount(key.ravel(), minlength=len(sample) * bits) & 1
    return np.packbits(parity.reshape(len(sample), bits).astype(np.uint8), axis=1)


def estimate(one: np.ndarray, many: np.ndarray, count: int) -> np.ndarray:
    """Similarities of one sketch to many, from the population counts of their XOR."""
    bits = one.shape[-1] * 8
    odd = _BIT[one ^ many].sum(-1, dtype=np.int64)
    inner = np.maximum(1 - 2 * odd / bits, 1e-9)
    return 1 + bits / (4 * count) * np.log(inner)


def fingerprint(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each row's set, whatever its order."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(C.mix(values))])
    other = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(C.mix(values * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))])
    return total[at[1:]] - total[at[:-1]], other[at[1:]] - other[at[:-1]]


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``row``, ``id``, set size, set fingerprint and the hashes of its bands (none for an empty set)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in C.slices(batch.column("text")):
                values, at = shingle_sets(buf, off, shingle)
                n = np.diff(at)
                one, two = fingerprint(values, at)
                sample = samples(values, at, bands * rows).reshape(-1, bands, rows)
                band = np.zeros(sample.shape[:2], dtype=np.uint64)
                for j, p in enumerate(C.powers(rows)):
                    band += sample[:, :, j] * p
                band = C.mix(band + C.powers(bands + 1)[1:])
                cut = np.concatenate([[0], np.cumsum(n > 0) * bands]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(C.signed(band.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("row", "id")]
                    + [pa.array(n.astype(np.int64)), pa.array(C.signed(one)), pa.array(C.signed(two)), lists],
                    names=["row", "id", "n", "one", "two", "bands"],
                )

    return docs.mapInArrow(run, f"row long, id {kind}, n long, one long, two long, bands array<long>")


def shared_bits(values: list[np.ndarray]) -> np.ndarray:
    """A bitmap per set over the shingles that at least two of the sets hold."""
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, ids, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[ids] > 1
    words = max(1, -(-int((counts > 1).sum()) // 64))
    out = np.zeros((len(values), words), dtype=np.uint64)
    bit = number[ids[keep]]
    np.bitwise_or.at(out, (owner[keep], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def link_members(
    rows: np.ndarray, values: list[np.ndarray], sketches: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray,
    percent: int, count: int, margin: float,
) -> list[tuple[int, int]]:
    """Confirms links between parts not yet connected (members of one root are), and returns those found.

    One member of ``left`` at a time is compared with the members of ``right`` in other parts: by size, by
    sketch, and then by full set.
    """
    size = np.array([len(v) for v in values], dtype=np.int64)
    part = np.unique(roots, return_inverse=True)[1]
    bits = shared_bits(values)
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(left):
        small, large = np.minimum(size[i], size), np.maximum(size[i], size)
        j = np.flatnonzero(right & (part != part[i]) & (100 * small >= percent * large))
        if not len(j):
            continue
        j = j[estimate(sketches[i], sketches[j], count) >= percent / 100 - margin]
        for k in range(0, len(j), 512):
            at = j[k : k + 512]
            both = np.bitwise_count(bits[i] & bits[at]).sum(1, dtype=np.int64)
            at = at[100 * both >= percent * (size[i] + size[at] - both)]
            parts, first = np.unique(part[at], return_index=True)
            fresh = parts != part[i]
            found += [(int(rows[i]), int(rows[x])) for x in at[first[fresh]]]
            if fresh.any():
                part[np.isin(part, parts)] = part[i]
    return found


def compare(tasks: DataFrame, shingle: int, percent: int, count: int, bits: int, margin: float) -> DataFrame:
    """Links (``a``, ``b``) found in each group of ``tasks`` (cluster, i, j, row, text, root, is_left, is_right)."""
    group = ["cluster", "i", "j"]
    ordered = tasks.repartition(*group).sortWithinPartitions(*group, "row", "is_left", "is_right")

    def links(members: list[tuple]) -> list[tuple[int, int]]:
        rows, texts, roots, left, right = (list(x) for x in zip(*members))
        values: list[np.ndarray] = []
        marks = []
        for lo, hi, buf, off in C.slices(pa.array(texts, pa.large_string())):
            got, at = shingle_sets(buf, off, shingle)
            values += [got[at[k] : at[k + 1]] for k in range(hi - lo)]
            marks.append(odd_sketches(samples(got, at, count), bits))
        sides = np.array(left), np.array(right)
        return link_members(np.array(rows), values, np.concatenate(marks), np.array(roots), *sides, percent, count, margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(g).to_pylist() for g in group)))
            columns = [batch.column(c) for c in ("row", "text", "root", "is_left", "is_right")]
            for n, k in enumerate(keys):
                if k != key and members:
                    out += links(members) if len(members) > 1 else []
                    members = []
                key = k
                members.append(tuple(c[n].as_py() for c in columns))
        if len(members) > 1:
            out += links(members)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS,
    rows: int = ROWS, bits: int = SKETCH_BITS, margin: float = MARGIN, block: int = BLOCK, hubs: int = HUBS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: ``id``, ``row``, set fingerprint (``one``, ``two``), ``n_shingles``,
    ``component_id``, ``first`` (the row that stays).

    ``component_id`` is the least id reachable over links of ``percent`` % similarity or more.  A null or
    wordless text has an empty set and links with nothing; rows of equal sets are one class, whose least
    (id, row) stands for it; repeated rows differ by ``row``, of which exactly one in a component is ``first``.
    A null id takes part and is the least.  A null component has null ids only.
    """
    body, _ = numbered(docs, key, text)
    signed = C.cut(signatures(body, shingle, bands, rows))
    full = signed.filter("n > 0")
    lead = full.groupBy("n", "one", "two").agg(F.min(F.struct("id", "row")).alias("rep"))
    lead = C.cut(lead.select("n", "one", "two", F.col("rep.id").alias("rep_id"), F.col("rep.row").alias("rep")))
    many = lead.count()
    reps = full.join(C.side(lead.select("rep"), many), F.col("row") == F.col("rep"), "left_semi")
    keyed = reps.select("row", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("row").alias("least")).filter("n > 1")
    # A document's bands have one least row each: it is tied to the least of them, and that one to the others,
    # so the members of a large group share these ties instead of having one for each band.
    tied = keyed.join(C.side(shared, bands * many), "band").groupBy("row").agg(F.min("least").alias("label"), F.collect_set("least").alias("leasts"))
    across = tied.select("label", F.explode("leasts").alias("least")).filter("label <> least").distinct()
    ties = tied.filter("row <> label").select(F.col("row").alias("a"), F.col("label").alias("b")).unionAll(across)
    clusters = components(ties).select(F.col("node").alias("row"), F.col("root").alias("cluster"))
    clusters = C.cut(clusters.join(C.side(lead.select(F.col("rep").alias("row"), "n"), many), "row"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("held"))
    parts = F.ceil(F.greatest(F.col("size") / block, F.col("held") / block_shingles)).cast("long")
    large = sizes.select("cluster", "size", parts.alias("parts")).filter("parts > 1")  # a row for each block of members, at most
    placed = clusters.join(F.broadcast(large), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    texts = C.cut(C.side(placed, many).join(body.select("row", "text"), "row").select("row", "cluster", "size", "parts", "n", "text"))
    parts = F.col("parts")
    hub = (parts > 1) & (F.pmod(F.xxhash64("row"), F.col("size")) < hubs)
    own = F.array(F.pmod(F.xxhash64("row", F.lit(1)), parts))
    spread = texts.withColumn("i", F.explode(F.when(hub, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(own)))
    yes = F.lit(True)
    tasks = spread.select("cluster", "i", F.lit(0).cast("long").alias("j"), "row", "text", F.col("row").alias("root"), yes.alias("is_left"), yes.alias("is_right"))
    count = bands * rows
    links = C.cut(compare(tasks, shingle, percent, count, bits, margin))
    roots = components(links)
    if texts.filter("parts > 1").limit(1).count():
        more = _rest(texts.filter("parts > 1"), C.side(roots, many), block, block_shingles)
        links = C.cut(links.unionByName(compare(more, shingle, percent, count, bits, margin)))
        roots = components(links)
    rooted = lead.join(C.side(roots, many), F.col("rep") == F.col("node"), "left").select("n", "one", "two", F.coalesce("root", "rep").alias("root"))
    member = signed.select("id", "row", "n", "one", "two").join(C.side(rooted, many), ["n", "one", "two"], "left")
    member = C.cut(member.select("id", "row", "one", "two", F.col("n").alias("n_shingles"), F.coalesce("root", "row").alias("root")))
    best = C.cut(member.groupBy("root").agg(F.min(F.struct("id", "row")).alias("best"), F.min("id").alias("component_id")))
    out = member.join(C.side(best, best.count()), "root")
    return out.select("id", "row", "one", "two", "n_shingles", "component_id", (F.col("row") == F.col("best.row")).alias("first"))


def _rest(texts: DataFrame, roots: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """Tasks that compare what large clusters' blocks left outside their largest part with all members."""
    rooted = texts.join(roots, F.col("row") == F.col("node"), "left").select("row", "cluster", "parts", "n", "text", F.coalesce("root", "row").alias("root"))
    groups = rooted.groupBy("cluster", "root").agg(F.count("*").alias("many"), F.sum("n").alias("held"))
    top = groups.groupBy("cluster").agg(F.max(F.struct("many", "root", "held")).alias("top"), F.sum("many").alias("all"), F.sum("held").alias("held"))
    many, held = F.col("all") - F.col("top.many"), F.col("held") - F.col("top.held")
    wide = F.ceil(F.greatest(many / block, held / block_shingles)).cast("long")
    top = C.cut(top.filter(many > 0).select("cluster", F.col("top.root").alias("giant"), wide.alias("wide")))
    here = rooted.join(top, "cluster")
    zero, wide, high = F.lit(0).cast("long"), F.col("wide"), F.col("parts")
    place = lambda salt, n: F.array(F.pmod(F.xxhash64("row", F.lit(salt)), n))
    cross = lambda df, i, j, left: df.withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).select(
        "cluster", "i", "j", "row", "text", "root", F.lit(left).alias("is_left"), F.lit(not left).alias("is_right")
    )
    lefts = cross(here.filter(F.col("root") != F.col("giant")), place(2, wide), F.sequence(zero, high - 1), True)
    rights = cross(here, F.sequence(zero, wide - 1), place(3, high), False)
    return lefts.unionByName(rights)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, **options) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of least id.

    Repeated rows count as copies, of which one stays; documents without words all stay.  Where an id occurs
    on rows of different texts, each row is told by its set as well.
    """
    found = classes(docs, key, text, shingle, **options).withColumnsRenamed({c: f"__{c}" for c in ("id", "one", "two")})
    stays = found.filter("first OR n_shingles = 0").select("__id").distinct().hint("merge")  # about a row for each document
    ids = found.groupBy("__id").agg(F.count("*").alias("n"))
    repeated = C.cut(ids.filter("n > 1").select("__id"))
    same = F.col(key).eqNullSafe(F.col("__id"))
    if not repeated.limit(1).count():
        return docs.join(stays, same, "left_semi")
    again = repeated.withColumnRenamed("__id", "__again")
    single = docs.join(stays.join(again, F.col("__id").eqNullSafe(F.col("__again")), "left_anti"), same, "left_semi")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__n", "__f", "__g"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in C.slices(batch.column(at)):
                values, cut = shingle_sets(buf, off, shingle)
                one, two = fingerprint(values, cut)
                part = batch.slice(lo, hi - lo).append_column("__n", pa.array(np.diff(cut).astype(np.int64)))
                yield part.append_column("__f", pa.array(C.signed(one))).append_column("__g", pa.array(C.signed(two)))

    marked = docs.join(repeated, same, "left_semi").mapInArrow(run, schema)
    first = found.filter("first").select("__id", "__one", "__two")
    match = same & (F.col("__f") == F.col("__one")) & (F.col("__g") == F.col("__two"))
    order = W.partitionBy(key, "__f", "__g").orderBy(F.xxhash64(text))
    once = marked.filter("__n > 0").join(first, match, "left_semi").withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at")
    return single.unionByName(once.unionByName(marked.filter("__n = 0")).drop("__n", "__f", "__g"))
