"""Content-defined anchors: how windows of fixed length are compared across a corpus without shuffling them all.

Every window (``w`` items: words or bytes) has an anchor: the run of ``k`` items in it whose hash is least, the
first at a tie.  Equal windows have equal anchors at equal places.  Neighbouring windows of one anchor form a
segment, about two for every ``w - k`` items, and only segments travel:

1. anchors that occur once in the corpus are dropped;
2. of segments of equal content, all but the first hold only windows that start earlier elsewhere;
3. segments that differ but share an anchor may share some windows; these are compared item by item.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.llm import common as C

_INVERSE = np.uint64(pow(int(C._STEP), -1, 2**64))
_PLACE = 24


def first_least(g: np.ndarray, width: int) -> np.ndarray:
    """Where the least of ``g[i : i + width]`` is, for every i; the first at a tie (of the upper 40 bits)."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    chunk = (1 << _PLACE) - width
    for lo in range(0, n, chunk):
        part = g[lo : lo + chunk + width - 1]
        low = (part >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        out[lo : lo + chunk] = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + lo
    return out


class Prefix:
    """Hashes of any run of items, from running sums."""

    def __init__(self, items: np.ndarray) -> None:
        n = len(items)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(items * C.powers(n + 1)[1:])])
        self.inverse = C.powers(n + 1, _INVERSE)

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return C.mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


def segments(seeds: np.ndarray, off: np.ndarray, w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and row of each segment.  ``seeds`` hash all runs of k items
    of the rows' items laid end to end; ``off`` has where each row begins."""
    at = first_least(seeds, w - k + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + w <= off[row + 1]) if len(at) else np.zeros(0, dtype=np.int64)
    at, row = at[inside], row[inside]
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(inside)))
    return inside[first], count, at[first], row[first]


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """``row``, ``id``, ``text``: rows with numbers that follow the ids' order; and whether they are the ids.

    Where ids are whole numbers, none null or repeated, they are the numbers.  Otherwise rows are numbered by
    (id, text), nulls first, and kept in the shared folder, so that every pass sees the same numbers.
    """
    plain = C.plain(docs, key, text)
    whole = docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    if whole and not plain.groupBy("id").count().filter("id IS NULL OR count > 1").limit(1).count():
        return plain.select(F.col("id").cast("long").alias("row"), "id", "text"), docs.schema[key].dataType.typeName() == "long"
    return C.cut(plain.sort("id", "text").select(F.monotonically_increasing_id().alias("row"), "id", "text")), False


def release(df: DataFrame) -> None:
    """Lets Spark remove shuffle files that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


Cutter = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def roles(rows: DataFrame, cutter: Cutter, w: int, k: int) -> DataFrame:
    """Segments that matter, kept in the shared folder.

    ``cutter`` turns bytes and row offsets into items, hashes of their k-runs, and item offsets.  Columns:
    ``row``, ``at`` (first window), ``m`` (windows), ``seed``, ``first_row``, ``first_at`` (first segment of
    this content), ``same`` (segments of this content), ``kinds`` (contents of this anchor).
    """

    def run(batches: Iterator[pa.RecordBatch], seeds_only: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, buf, off in C.slices(batch.column(1)):
                items, seeds, ioff = cutter(buf, off)
                s, m, at, row = segments(seeds, ioff, w, k)
                seed = C.signed(seeds[at])
                if seeds_only:
                    yield pa.RecordBatch.from_arrays([pa.array(seed)], names=["seed"])
                    continue
                content = Prefix(items).runs(s, s + m + w - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (seed, C.signed(content), ids[lo + row], (s - ioff[row]).astype(np.int64), m.astype(np.int32))],
                    names=["seed", "content", "row", "at", "m"],
                )

    body = rows.select("row", "text")
    often = body.mapInArrow(lambda b: run(b, True), "seed long").groupBy("seed").count().filter("count > 1").select("seed")
    often = C.cut(often)
    release(rows)
    every = body.mapInArrow(lambda b: run(b, False), "seed long, content long, row long, at long, m int")
    met = C.cut(every.join(often, "seed", "left_semi"))
    release(rows)
    # Counted before it is shuffled, and joined side by side: a common anchor or content is no task's alone.
    alike = ["seed", "content", "m"]
    known = C.cut(met.groupBy(*alike).agg(F.min(F.struct("row", "at")).alias("first"), F.count("*").alias("same")))
    kinds = C.cut(known.groupBy("seed").agg(F.count("*").alias("kinds")))
    known = C.cut(known.join(kinds, "seed").filter("same > 1 OR kinds > 1"))
    out = met.join(known, alike)
    out = C.cut(out.select("row", "at", "m", "seed", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"), "same", "kinds"))
    release(rows)
    return out


IS_FIRST = "row = first_row AND at = first_at"


def with_lists(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of ``spans`` (``row``, ``at``, ``m``, ``seed`` and more) as one list per document, with its text."""
    columns = ["at", "m", "seed", *(c for c in spans.columns if c not in ("row", "at", "m", "seed"))]
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("spans"))
    return rows.select("row", "text").join(lists, "row")


def list_arrays(column: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row number (from ``lo``) and fields of all structs in rows lo to hi of a list column."""
    part = column.slice(lo, hi - lo)
    flat = part.flatten()
    counts = part.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(hi - lo), counts), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def shared_windows(rows: DataFrame, spans: DataFrame, cutter: Cutter, w: int) -> DataFrame:
    """``row`` and ``at`` of windows in ``spans`` that start earlier in another of them, by window hashes.

    The hash is of 128 bits: the anchor's and the window's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for lo, hi, buf, off in C.slices(batch.column("text"), C.SLICE_BYTES // 2):
                items, _, ioff = cutter(buf, off)
                owner, x = list_arrays(batch.column("spans"), lo, hi)
                m = x["m"].astype(np.int64)
                inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                at = np.repeat(x["at"], m) + inside
                begin = at + ioff[np.repeat(owner, m)]
                window = C.signed(Prefix(items).runs(begin, begin + w))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (np.repeat(x["seed"], m), window, ids[lo + np.repeat(owner, m)], at)], names=["seed", "window", "row", "at"]
                )

    every = with_lists(rows, spans).mapInArrow(run, "seed long, window long, row long, at long")
    order = W.partitionBy("seed", "window").orderBy("row", "at")
    return every.withColumn("n", F.row_number().over(order)).filter("n > 1").select("row", "at")


def ranges(windows: DataFrame, w: int) -> DataFrame:
    """Windows (``row``, ``at``) as ranges ``lo`` to ``hi`` of items, runs of overlapping ones joined."""
    order = W.partitionBy("row").orderBy("at")
    run = F.sum(F.when(F.col("at") - F.lag("at").over(order) <= w, 0).otherwise(1)).over(order)
    marked = windows.distinct().withColumn("run", run)
    return marked.groupBy("row", "run").agg(F.min("at").alias("lo"), (F.max("at") + w).alias("hi")).drop("run")


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n places lie in a range."""
    turn = np.bincount(lo, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(hi, minlength=n + 1)[: n + 1]
    return np.cumsum(turn)[:n] > 0
