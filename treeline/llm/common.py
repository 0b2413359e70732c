"""Shared pieces of the training-data operators: table access, numpy tokenising and hashing.

Text functions work on the UTF-8 bytes of an Arrow batch, cut into slices of about a megabyte, so that
memory stays bounded whatever a partition holds.  A word is a run of bytes outside ``\\x20\\x09-\\x0D``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 12
#: Rows up to which Spark may broadcast a side of a join: the driver holds such a table several times over, by each join.
BROADCAST_ROWS = 100_000

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one is set here, but only on a machine of its own: on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that later steps don't depend on executors' disks."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, as a side of a join; a large one is never broadcast, whatever Spark measures."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes, so that every bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of at most ``rows`` rows of about ``limit`` bytes: first row, last row + 1,
    bytes, offsets.

    A row is never cut, so a slice may exceed the limit by one row.  Nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1), lo + rows)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and row numbers of all words."""
    full = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.empty(len(buf), dtype=bool)
    before[1:] = full[:-1]
    before[:1] = False
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[:-1] = full[1:]
    after[-1:] = False
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = inside + np.repeat(starts, lengths)
    value = (_BYTE_LOWER if lower else _BYTE)[buf[at]] * powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def hash_words_by_sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, piece: int = 1 << 18) -> np.ndarray:
    """What ``hash_words`` gives for words that don't overlap, in order, from running sums over whole pieces of bytes.

    The powers are odd, so a word's place in its piece is divided out modulo 2**64.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    table, lo = _BYTE_LOWER if lower else _BYTE, 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + piece, "right")))
        at, to = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        sums = np.zeros(int(to[-1]) + 1, dtype=np.uint64)
        np.multiply(table[buf[starts[lo] : ends[hi - 1]]], _running(len(sums) - 1, _STEP), out=sums[1:])
        np.cumsum(sums, out=sums)
        out[lo:hi] = (sums[to] - sums[at]) * _running(len(sums) - 1, _UNSTEP)[at] + (to - at).astype(np.uint64)
        lo = hi
    return mix(out)


@lru_cache(maxsize=2)
def _kept(base: np.uint64) -> np.ndarray:
    return powers(1 << 18, base)


def _running(n: int, base: np.uint64) -> np.ndarray:
    return _kept(base)[:n] if n <= 1 << 18 else powers(n, base)


def hash_grams(h: np.ndarray, k: int, base: np.uint64 = _STEP) -> np.ndarray:
    """Hashes of all runs of ``k`` items; shorter than the input by ``k - 1``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j, p in enumerate(powers(k, base)):
            out += h[j : j + n] * p
    return mix(out)


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def char_lengths(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Code points in each byte range."""
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return lead[hi] - lead[lo]


def plain(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; nothing else is scanned or clashes."""
    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
