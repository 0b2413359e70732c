"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket boundaries that minimise padding.
Inside a bucket, every document is padded to the boundary, and batches hold as many as the token budget lets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.llm import common as C

#: Production parameters: number of buckets, tokens of a batch with its padding.
BUCKETS, BATCH_TOKENS = 16, 65_536
#: Rows of a bucket that one task numbers.
SHARD_ROWS = 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, ascending, that minimise the sum of padding; exact.

    With ``C`` the running count, the best cost of the first j lengths in k buckets is the least, over i, of
    ``best_{k-1}(i) + length_j * (C_j - C_i)``.  The best i never falls as j grows, so the middle of a range of j
    halves the choice for both of its halves; all ranges of a depth are solved at once.  Among equal costs, fewer
    buckets win.
    """
    order = np.argsort(lengths)
    length, count = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    length, count = length[count > 0], count[count > 0]
    d = len(length)
    if not d:
        return []
    running = np.concatenate([[0], np.cumsum(count)])
    far = np.iinfo(np.int64).max // 4
    best = np.full(d + 1, far)
    best[0] = 0
    came: list[np.ndarray] = []
    costs = []
    for _ in range(max(1, min(buckets, d))):
        new, back = np.full(d + 1, far), np.zeros(d + 1, dtype=np.int32)
        lo, hi, low, high = (np.array([x]) for x in (1, d, 0, d - 1))
        while len(lo):
            j = (lo + hi) // 2
            n = np.minimum(high, j - 1) - low + 1
            first = np.cumsum(n) - n
            i = np.arange(int(n.sum())) - np.repeat(first - low, n)
            cost = best[i] + np.repeat(length[j - 1], n) * (np.repeat(running[j], n) - running[i])
            least = np.minimum.reduceat(cost, first)
            hit = np.flatnonzero(cost == np.repeat(least, n))
            at = i[hit[np.searchsorted(hit, first)]]
            new[j], back[j] = np.minimum(least, far), at
            lo, hi, low, high = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (low, at), (at, high)))
            some = lo <= hi
            lo, hi, low, high = lo[some], hi[some], low[some], high[some]
        came.append(back)
        costs.append(int(new[d]))
        best = new
    k, j, out = int(np.argmin(costs)), d, []
    while k >= 0:
        out.append(int(length[j - 1]))
        j, k = int(came[k][j]), k - 1
    return out[::-1]


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and number of words (``n_tokens``) of every row; a null text has none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in C.slices(batch.column(1)):
                n = C.row_counts(C.words(buf, off)[2], hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n)], names=["id", "n_tokens"])

    return C.plain(docs, key, text).mapInArrow(run, f"id {kind}, n_tokens long")


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per document: key, ``n_tokens``, ``bucket`` (padded length), ``batch`` (number in the bucket,
    from 0), ``padding``.

    A null or empty text has length 0 and is packed like any other; a document longer than the budget is a
    batch of its own; repeated rows are packed each; an empty table gives no rows.  In each bucket all
    batches but the last are full.  Rows of a bucket are numbered in shards, by a hash of the key, and shard
    offsets are added, so a bucket that holds most rows doesn't meet in one task.
    """
    sized = C.cut(lengths(docs, key, text))
    # one row a length: no more than the longest document has words
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    length, n = histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy()
    edges = boundaries(length, n, buckets)
    count = np.bincount(np.searchsorted(edges, length), n, len(edges)).astype(np.int64).tolist()
    if not edges:
        edges, count = [0], [0]
    shards = [max(1, -(-c // shard_rows)) for c in count]
    ladder = F.array(*[F.lit(e).cast("long") for e in edges])
    at = (F.size(F.filter(ladder, lambda e: e < F.col("n_tokens"))) + 1).cast("int")
    placed = sized.withColumn("at", at).withColumn("bucket", F.element_at(ladder, F.col("at")))
    wide = F.element_at(F.array(*[F.lit(s).cast("long") for s in shards]), F.col("at"))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("id", "n_tokens"), wide)).drop("at")
    totals = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("bucket", "shard").orderBy("id", "n_tokens")
    numbered = placed.withColumn("rn", F.row_number().over(inside) - 1).join(offsets, ["bucket", "shard"])
    per_batch = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket"), F.lit(1))), F.lit(1))
    return numbered.select(
        F.col("id").alias(key), "n_tokens", "bucket",
        F.floor((F.col("offset") + F.col("rn")) / per_batch).cast("long").alias("batch"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
