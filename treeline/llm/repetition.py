"""Quality rules by suffix-array repetition.

Each document gets a suffix array over its words; longest-common-prefix (LCP) intervals of neighbours in it
are the maximal repeated substrings.  Their spans are united, and two limits apply: the fraction of the
words that repeats cover, and the length of the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeline.llm import common as C

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Production limits: repeats of so many words count; more of the words' characters covered, or one repeat
#: both this long and this part of the document, rejects it.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, LONGEST_SHARE = 8, 0.30, 64, 0.15

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_chars long, longest_repeat long, base_failed boolean, kept boolean"
)


def suffix_array(ids: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of all rows' sequences at once (a suffix ends with its row), and ranks by the first
    ``h`` items for h = least, 2 * least, ... as far as suffixes agree.

    Prefix doubling in which only groups of still equal suffixes are sorted again; doubling steps below
    ``least`` use powers of two, so ``least`` must be one.
    """
    n = len(ids)
    end = np.searchsorted(rows, rows, "right")
    key = rows.astype(np.int64) * (int(ids.max()) + 1 if n else 1) + ids
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = slot
    levels: list[tuple[int, np.ndarray]] = []
    alone = new & np.concatenate([new[1:], [True]])
    at, h = np.flatnonzero(~alone), 1
    while True:
        if h >= least:
            levels.append((h, rank.astype(np.int32)))
        if not len(at):
            break
        x = sa[at]
        y = np.where(x + h < end[x], rank[np.minimum(x + h, n - 1)] + 1, 0)
        key = rank[x] * (n + 1) + y
        order = np.argsort(key, kind="stable")
        x, key = x[order], key[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        sa[at] = x
        rank[x] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return sa, levels


def neighbour_lcp(
    sa: np.ndarray, levels: list[tuple[int, np.ndarray]], ids: np.ndarray, rows: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix array that share ``least`` items or more, with the length they share."""
    if not levels or levels[0][0] != least or len(sa) < 2:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    end = np.searchsorted(rows, rows, "right")
    rank = levels[0][1]
    a, b = sa[:-1], sa[1:]
    same = (rank[a] == rank[b]) & (end[a] - a >= least) & (end[b] - b >= least)
    a, b = a[same], b[same]
    lcp, n = np.zeros(len(a), dtype=np.int64), len(ids)
    for h, rank in reversed(levels):
        i, j = a + lcp, b + lcp
        fits = (i + h <= end[a]) & (j + h <= end[b])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        lcp += np.where(fits & (rank[i] == rank[j]), h, 0)
    for _ in range(least - 1):
        i, j = a + lcp, b + lcp
        fits = (i < end[a]) & (j < end[b])
        lcp += fits & (ids[np.minimum(i, n - 1)] == ids[np.minimum(j, n - 1)])
    return a, b, lcp


def repeats(
    hashes: np.ndarray, rows: np.ndarray, n_rows: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in a repeat of ``least`` words or more of their row, and each row's longest repeat."""
    n = len(hashes)
    longest = np.zeros(n_rows, dtype=np.int64)
    if not n:
        return np.zeros(0, dtype=bool), longest
    ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    sa, levels = suffix_array(ids, rows, least)
    a, b, lcp = neighbour_lcp(sa, levels, ids, rows, least)
    turn = np.zeros(n + 1, dtype=np.int64)
    for x in (a, b):
        turn += np.bincount(x, minlength=n + 1)
        turn -= np.bincount(x + lcp, minlength=n + 1)
    np.maximum.at(longest, rows[a], lcp)
    return np.cumsum(turn[:-1]) > 0, longest


def duplicate_lines(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row: lines (cut at \\n) that hold a word and equal an earlier line of the row."""
    n = len(off) - 1
    out = np.zeros(n, dtype=np.int64)
    data = buf.tobytes()
    for i in range(n):
        lines = data[off[i] : off[i + 1]].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    out[i] += bool(line.strip(b" \t\n\r\x0b\x0c"))
                else:
                    seen.add(line)
    return out


def measure(
    ids: np.ndarray, buf: np.ndarray, off: np.ndarray, min_repeat: int, max_covered: float, max_longest: int,
    longest_share: float,
) -> dict[str, np.ndarray]:
    """All columns of ``SCHEMA`` for the rows of one slice."""
    n = len(off) - 1
    starts, ends, rows = C.words(buf, off)
    n_words = C.row_counts(rows, n)
    chars = C.char_lengths(buf, starts, ends)
    word_chars = np.bincount(rows, chars, n).astype(np.int64)
    symbol = np.zeros(256, dtype=np.int64)
    symbol[list(SYMBOLS)] = 1
    total = np.concatenate([[0], np.cumsum(symbol[buf])])
    hashes = C.hash_words(buf, starts, ends)
    covered, longest = repeats(hashes, rows, n, 8)
    n_repeat = np.bincount(rows, covered, n).astype(np.int64)
    if min_repeat != 8:
        covered, longest = repeats(hashes, rows, n, min_repeat)
    covered_chars = np.bincount(rows, chars * covered, n).astype(np.int64)
    base = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    bad = (covered_chars > max_covered * word_chars) | (
        (longest >= max_longest) & (longest > longest_share * n_words)
    )
    return {
        "doc_id": ids, "n_words": n_words, "word_chars": word_chars, "n_symbols": total[off[1:]] - total[off[:-1]],
        "n_dup_lines": duplicate_lines(buf, off), "n_repeat_words": n_repeat, "covered_chars": covered_chars,
        "longest_repeat": longest, "base_failed": base, "kept": ~(base | bad),
    }


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, longest_share: float = LONGEST_SHARE,
) -> DataFrame:
    """One row per row of ``docs`` with the columns of ``SCHEMA``; a map without a shuffle.

    A null text counts as empty; an empty text has no words, fails the base rule and isn't kept.  A null key
    stays null; repeated rows are each measured.  Other columns of ``docs`` aren't read.  ``min_repeat`` is a
    power of two.
    """
    if min_repeat < 1 or min_repeat & (min_repeat - 1):
        raise ValueError("min_repeat must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in C.slices(batch.column(1)):
                got = measure(None, buf, off, min_repeat, max_covered, max_longest, longest_share)
                got["doc_id"] = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_pydict({k: pa.array(v) if k != "doc_id" else v for k, v in got.items()})

    return C.plain(docs, key, text).mapInArrow(run, SCHEMA.replace("doc_id long", f"doc_id {docs.schema[key].dataType.simpleString()}"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass and without a shuffle."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opts = {"min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST,
                "longest_share": LONGEST_SHARE} | limits
        for batch in batches:
            for lo, hi, buf, off in C.slices(batch.column(at)):
                got = measure(None, buf, off, **opts)
                yield batch.slice(lo, hi - lo).filter(pa.array(got["kept"]))

    return docs.mapInArrow(run, docs.schema)
