"""Suffix-array dedup with a logarithmic index family, on bytes.

Candidate segments (see :mod:`anchors`) are dealt into shards by anchor; those of a common anchor are first cut
by where the anchor lies in their windows, which is the same for equal windows.  A shard takes its segments in
corpus order, in batches.  Each batch gets a suffix array, over every start of a window in it, to the depth of a
window; it is merge-scanned against the suffix arrays already held, for suffixes that agree to that depth; what
is new joins them, and levels of like size merge, so a shard holds a logarithmic number.  Equal windows are
neighbours in suffix order, so no two segments are ever compared, however many share an anchor.

Segments of equal content (exact copies) enter the index once; the others take that content's place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm import anchors as A
from treeline.llm import common as C
from treeline.llm.decontam import gram_hashes

#: Production parameters: bytes of a match and of an anchor, windows of a shard, segments of a batch.
LENGTH, ANCHOR, SHARD_WINDOWS, BATCH = 100, 32, 1 << 18, 4096
#: Partitions of the shuffle; beyond so many shards, a task takes several, one after the other.
MOST_PARTITIONS = 100_000


def cut_bytes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return C._BYTE[buf], gram_hashes(buf, ANCHOR), off


def suffixes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes from each place on, as fixed-width strings in byte order (one is added to every
    byte, as numpy ends strings at a zero; no UTF-8 byte is 255)."""
    if not len(at):
        return np.zeros(0, dtype=f"S{length}")
    rows = np.lib.stride_tricks.sliding_window_view(buf + np.uint8(1), length)[at]
    return rows.view(f"S{length}").ravel()


class Family:
    """The levels of a shard: sorted suffixes, each once, of geometrically growing sizes."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Adds a batch of suffixes, in corpus order; tells which of them occur earlier, in it or in a level."""
        order = np.argsort(batch, kind="stable")
        ordered = batch[order]
        again = np.zeros(len(batch), dtype=bool)
        again[1:] = ordered[1:] == ordered[:-1]
        place = np.flatnonzero(~again)
        fresh = ordered[place]
        new = np.ones(len(place), dtype=bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, fresh), len(level) - 1)
            new &= level[at] != fresh
        # a suffix that a level holds makes all of its equals repeats, the first of the batch included
        again[place] = ~new
        out = np.empty(len(batch), dtype=bool)
        out[order] = again
        if new.any():
            self.levels.append(fresh[new])
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            last = self.levels.pop()
            self.levels[-1] = self.merged(self.levels[-1], last)
        return out

    @staticmethod
    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two sorted arrays as one, without sorting again."""
        out = np.empty(len(a) + len(b), dtype=a.dtype)
        at = np.searchsorted(a, b) + np.arange(len(b))
        rest = np.ones(len(out), dtype=bool)
        rest[at] = False
        out[at], out[rest] = b, a
        return out


def laid_out(rows: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Segments with their bytes: ``seed``, ``piece``, ``row``, ``at``, ``m``, ``body``.

    ``spans`` has ``pieces`` besides: a segment of more than one is cut where the place of the anchor within
    the window passes from one of so many ranges to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for lo, hi, buf, off in C.slices(batch.column("text"), C.SLICE_BYTES // 2):
                owner, x = A.list_arrays(batch.column("spans"), lo, hi)
                m, pieces = x["m"].astype(np.int64), x["pieces"].astype(np.int64)
                begin = x["at"] + off[owner]
                shift, piece = np.zeros(len(m), dtype=np.int64), np.zeros(len(m), dtype=np.int64)
                if (pieces > 1).any():
                    anchor = A.first_least(gram_hashes(buf, ANCHOR), length - ANCHOR + 1)[begin] - begin
                    which = np.repeat(np.arange(len(m)), m)
                    inside = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
                    part = (anchor[which] - inside) * pieces[which] // (length - ANCHOR + 1)
                    new = np.ones(len(which), dtype=bool)
                    new[1:] = (which[1:] != which[:-1]) | (part[1:] != part[:-1])
                    first = np.flatnonzero(new)
                    m, shift, piece, which = np.diff(np.append(first, len(new))), inside[first], part[first], which[first]
                    owner, begin = owner[which], begin[which] + shift
                    x = {k: v[which] for k, v in x.items()}
                size = m + length - 1
                inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                flat = buf[np.repeat(begin, size) + inside]
                cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (x["seed"], piece, ids[lo + owner], x["at"] + shift, m)] + [body],
                    names=["seed", "piece", "row", "at", "m", "body"],
                )

    return A.with_lists(rows, spans).mapInArrow(run, "seed long, piece long, row long, at long, m long, body binary")


def indexed(segments: DataFrame, shards: int, length: int, batch_size: int) -> DataFrame:
    """Ranges (``row``, ``lo``, ``hi``) of bytes of segments that occur earlier, by the index family."""
    shard = F.pmod(F.xxhash64("seed", "piece"), F.lit(shards))
    dealt = segments.select(shard.alias("shard"), "row", "at", "m", "body").repartition(min(shards, MOST_PARTITIONS), "shard")
    ordered = dealt.sortWithinPartitions("shard", "row", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family = None, Family()
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for s, e in zip(edges[:-1], edges[1:]):
                if len(shard) == 0:
                    continue
                if shard[s] != now:
                    now, family = shard[s], Family()
                for lo in range(s, e, batch_size):
                    part = batch.slice(lo, min(batch_size, e - lo))
                    row, at, m = (part.column(c).to_numpy() for c in ("row", "at", "m"))
                    _, _, buf, off = next(C.slices(part.column("body"), 1 << 62, 1 << 62))
                    which = np.repeat(np.arange(len(m)), m)
                    inside = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
                    again = np.flatnonzero(family.add(suffixes(buf, off[which] + inside, length)))
                    if len(again):
                        new = np.ones(len(again), dtype=bool)
                        new[1:] = (np.diff(again) != 1) | (which[again[1:]] != which[again[:-1]])
                        first = np.flatnonzero(new)
                        last = np.append(first[1:], len(again)) - 1
                        i = which[again[first]]
                        made = row[i], at[i] + inside[again[first]], at[i] + inside[again[last]] + length
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], names=["row", "lo", "hi"])

    return ordered.mapInArrow(run, "row long, lo long, hi long")


def remove(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_windows: int = SHARD_WINDOWS, batch: int = BATCH,
) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary), ``spans``.

    Each byte covered by a string of ``length`` bytes that also starts earlier is removed; ``spans`` are the
    maximal removed runs (start, end).  Earlier is a smaller id, or a smaller place in the document; rows of
    one id are ordered by text, and a null id is before all.  A null or empty text has no bytes; of repeated
    rows the first stays.  ``kept`` may end or start inside a character, where the repeat does.
    """
    rows, same = A.numbered(docs, key, text)
    roles = A.roles(rows, cut_bytes, length, ANCHOR)
    several = roles.filter("kinds > 1").filter(A.IS_FIRST)
    total = several.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    # a common anchor's windows are cut into pieces of about a shard, by the anchor's place in them
    places = length - ANCHOR + 1
    pieces = F.least(F.lit(places), F.ceil(F.col("kinds") * places / shard_windows)).cast("int")
    spans = several.select("row", "at", "m", "seed", pieces.alias("pieces"))
    found = C.cut(indexed(laid_out(rows, spans, length), max(1, -(-total // shard_windows)), length, batch))
    A.release(docs)
    copies = roles.filter(f"NOT ({A.IS_FIRST})").select("row", F.col("at").alias("lo"), (F.col("at") + F.col("m") + length - 1).alias("hi"))
    lists = found.unionByName(copies).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    met = rows.join(lists, "row", "left").select("row", "id", "text", "ranges")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in C.slices(batch.column("text")):
                owner, x = A.list_arrays(batch.column("ranges"), lo, hi)
                gone = A.covered(len(buf), x["lo"] + off[owner], x["hi"] + off[owner])
                total = np.concatenate([[0], np.cumsum(gone)])
                starts = gone.copy()
                starts[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(buf)), off)
                ends = gone.copy()
                ends[:-1] &= ~gone[1:] | np.isin(np.arange(1, len(buf)), off)
                s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
                per = np.searchsorted(s, off)
                n, removed = np.diff(off), total[off[1:]] - total[off[:-1]]
                cuts = np.concatenate([[0], np.cumsum(n - removed)]).astype(np.int64)
                kept = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cuts), pa.py_buffer(buf[~gone])]).cast(pa.binary())
                base = np.repeat(off[:-1], np.diff(per))
                span = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], names=["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(n), pa.array(removed), pa.array(np.diff(per)), kept,
                     pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), span)],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
                )

    return met.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")
