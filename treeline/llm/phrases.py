"""Substring dedup by repeated-phrase automata.

Recurring passages are confirmed over the corpus: segments (see :mod:`anchors`) whose content occurs more than
once.  Documents are dealt into parts of bounded size; each part gets the passages that occur in it, one
exemplar each, compiles an Aho-Corasick automaton over their words, and streams all its documents through
it to locate every occurrence.  So occurrences never travel, however common a passage is.  Windows that are
shared by passages of different content are found by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm import anchors as A
from treeline.llm import common as C

#: Production parameters: words of a window and of an anchor, bytes of text of a part.
WINDOW, ANCHOR, PART_BYTES = 20, 6, 4 << 20


def cut_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = C.words(buf, off)
    h = C.hash_words(buf, starts, ends)
    counts = C.row_counts(rows, len(off) - 1)
    return h, C.hash_grams(h, ANCHOR), np.concatenate([[0], np.cumsum(counts)])


def spelled(words: np.ndarray) -> tuple[str, int]:
    """Words as fixed numbers of characters, and how many each has.

    A word's number within the part is written in base 64, with other characters for each digit's place, so
    matches start and end with words, and no node of an automaton has more than 64 children.
    """
    unique, numbers = np.unique(words, return_inverse=True)
    digits = 1
    while 64**digits < len(unique):
        digits += 1
    out = np.empty((len(words), digits), dtype=np.uint32)
    for d in range(digits):
        out[:, d] = (numbers >> (6 * (digits - 1 - d)) & 63) + 64 * d
    return out.astype(np.uint8).tobytes().decode("latin-1") if digits <= 4 else out.tobytes().decode("utf-32-le"), digits


def remove_part(
    docs: list[tuple[int, str]], passages: list[tuple[int, int, int, int, int]], shared: list[tuple[int, int, int]], window: int
) -> Iterator[tuple[int, int, int, str]]:
    """Row, words, words removed and kept text of each document of a part.

    ``passages`` are exemplars (row, at, windows, first_row, first_at); ``shared`` are ranges (row, lo, hi)
    to be removed besides.  Words are numbered within the part.
    """
    place = {r: i for i, (r, _) in enumerate(docs)}
    texts = [text.encode() for _, text in docs]
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, owner = C.words(buf, off)
    first = np.searchsorted(owner, np.arange(len(docs) + 1))
    coded, digits = spelled(C.hash_words(buf, starts, ends))
    automaton = ahocorasick.Automaton()
    for row, at, m, first_row, first_at in passages:
        n, lo = m + window - 1, int(first[place[row]]) + at
        automaton.add_word(coded[digits * lo : digits * (lo + n)], (n, first_row, first_at))
    found = len(passages) > 0
    if found:
        automaton.make_automaton()
    more: dict[int, list[tuple[int, int]]] = {}
    for row, lo, hi in shared:
        more.setdefault(row, []).append((lo, hi))
    for i, (row, _) in enumerate(docs):
        lo, hi = int(first[i]), int(first[i + 1])
        spans = list(more.get(row, ()))
        if found and hi - lo >= window:
            for last, (n, first_row, first_at) in automaton.iter(coded[digits * lo : digits * hi]):
                end = (last + 1) // digits
                if (row, end - n) > (first_row, first_at):  # an earlier place lies in a longer segment
                    spans.append((end - n, end))
        kept = texts[i].split()
        if spans:
            gone = A.covered(hi - lo, *np.array(spans).T)
            kept = [x for x, g in zip(kept, gone.tolist()) if not g]
        yield row, hi - lo, hi - lo - len(kept), b" ".join(kept).decode()


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``n_removed``, ``kept`` (its kept words, joined by a space).

    Each word covered by a window of ``window`` words whose sequence also starts earlier is removed.  Earlier is
    a smaller id, or a smaller place in the document; rows of one id are ordered by text, and a null id is
    before all.  A null or empty text has no words; a document shorter than a window stays whole; of repeated
    rows the first stays.  Candidates are told by hashes of 128 bits, words within a part by 64.
    """
    rows, same = A.numbered(docs, key, text)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    part = lambda row: F.pmod(F.xxhash64(row), F.lit(parts))
    roles = A.roles(rows, cut_words, window, ANCHOR)
    several = roles.filter("kinds > 1").filter(A.IS_FIRST).select("row", "at", "m", "seed")
    shared = C.cut(A.ranges(A.shared_windows(rows, several, cut_words, window), window))
    A.release(docs)
    exemplar = F.min(F.struct("row", "at"))
    passages = roles.filter("same > 1").withColumn("part", part("row")).groupBy("part", "first_row", "first_at", "m").agg(exemplar.alias("x"))
    none = F.lit(None).cast("long")
    union = rows.select(part("row").alias("part"), F.lit(2).alias("kind"), "row", F.coalesce("text", F.lit("")).alias("text"), none.alias("a"), none.alias("b"), none.alias("c"), none.alias("d"))
    union = union.unionAll(passages.select("part", F.lit(0), "x.row", F.lit(None).cast("string"), "x.at", F.col("m").cast("long"), "first_row", "first_at"))
    union = union.unionAll(shared.select(part("row"), F.lit(1), "row", F.lit(None).cast("string"), "lo", "hi", none, none))
    ordered = union.repartition(min(parts, 10_000), "part").sortWithinPartitions("part", "kind", "row", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(group: list[list]) -> Iterator[pa.RecordBatch]:
            passages, shared, docs = group
            out: list[tuple] = []
            size = 0
            for row in remove_part(docs, passages, shared, window):
                out.append(row)
                size += len(row[3])
                if size > 4 << 20:
                    yield pack(out)
                    out, size = [], 0
            if out:
                yield pack(out)

        def pack(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=["row", "n_words", "n_removed", "kept"])

        now, group = None, [[], [], []]
        for batch in batches:
            parts, kinds, row, a, b, c, d = (batch.column(x).to_pylist() for x in ("part", "kind", "row", "a", "b", "c", "d"))
            texts = batch.column("text")
            for i, p in enumerate(parts):
                if p != now:
                    if now is not None:
                        yield from result(group)
                    now, group = p, [[], [], []]
                k = kinds[i]
                group[k].append((row[i], texts[i].as_py()) if k == 2 else (row[i], a[i], b[i], c[i], d[i]) if k == 0 else (row[i], a[i], b[i]))
        if now is not None:
            yield from result(group)

    done = ordered.mapInArrow(run, "row long, n_words long, n_removed long, kept string")
    if same:
        return done.withColumnRenamed("row", "id")
    return rows.select("row", "id").join(done, "row").drop("row")
