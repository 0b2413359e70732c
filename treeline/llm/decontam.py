"""Benchmark decontamination by q-gram lemma filtering.

Texts are folded (case, punctuation and white space) to bytes.  Benchmark items are cut into overlapping
windows.  A window of n bytes within e edits of a region shares at least ``n - q + 1 - q * e`` q-grams with it
(q-gram lemma), and they lie on neighbouring diagonals.  So shared q-grams are counted in overlapping bands of
diagonals, regions that meet the bound are kept, and each is verified by banded alignment.

Which bands are counted at all is told by a window's n // q blocks of q bytes side by side: e edits leave
``n // q - e`` of them whole, so only these are looked up, an eighth of all q-grams at q = 8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm import common as C

#: Production parameters: q, bytes of a window and its step, edits per byte, step of the diagonal bands.
Q, WINDOW, STRIDE, EDIT_RATE, BAND = 8, 80, 8, 0.1, 16
#: Bytes of benchmark text that go to the workers at once; a larger benchmark is run in blocks.
BLOCK_BYTES = 8 << 20
#: Pairs of a text's q-gram and a block's place that are held at once, and candidates counted or aligned at once.
PAIRS, BATCH = 1 << 18, 1024
_BITS = 24

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def fold(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, row offsets, and the place of each folded byte in ``buf``.

    A-Z and the capitals of Latin-1 become small letters; a run of other ASCII characters than letters and
    digits becomes one space, none at a row's start.
    """
    out = _FOLD[buf]
    if len(buf):
        capital = np.zeros(len(buf), dtype=bool)
        capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[capital] += 0x20
    keep = out != 32
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[off] = True
    after = np.empty(len(buf), dtype=bool)
    after[1:] = keep[:-1]
    after[:1] = False
    at = np.flatnonzero(keep | (after & ~first[:-1]))
    return out[at], np.searchsorted(at, off), at


def gram_hashes(buf: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q bytes, by doubling."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, size = buf.astype(np.uint64) + np.uint64(1), 1
    parts: list[tuple[int, np.ndarray]] = []
    rest = q
    while rest:
        if rest & 1:
            parts.append((size, h))
        rest >>= 1
        if rest:
            p = C.powers(size + 1)[size]
            h = h[:-size] + h[size:] * p
            size *= 2
    out, done = np.zeros(n, dtype=np.uint64), 0
    for size, h in parts:
        out += h[done : done + n] * C.powers(done + 1)[done]
        done += size
    return C.mix(out)


def banded_distances(
    patterns: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, lo: np.ndarray, width: int, edits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least edits between each row of ``patterns`` and a part of ``text[first:last]`` that starts on one of
    ``width`` diagonals from ``lo``, side by side.

    Returns the rows within ``edits``, their edits, and start and end of the part from ``first``.  Step i of the
    alignment holds text positions i + lo - edits to i + lo + width - 1 + edits.
    """
    n, width = patterns.shape[1], width + 2 * edits
    big, base, size = n + edits + 2, lo - edits, last - first
    spot = base[:, None] + np.arange(n + width)
    inside = (spot >= 0) & (spot < size[:, None])
    seen = np.where(inside, text[np.where(inside, first[:, None] + spot, 0)], -1).astype(np.int16)
    column = np.arange(width)
    at = base[:, None] + column
    cost, origin = np.where((at >= 0) & (at <= size[:, None]), 0, big), at
    rows = np.arange(len(patterns))
    end = np.full((len(rows), 1), big)
    for i in range(1, n + 1):
        diagonal = np.where(inside[:, i - 1 : i - 1 + width], cost + (seen[:, i - 1 : i - 1 + width] != patterns[:, i - 1 : i]), big)
        up = np.concatenate([cost[:, 1:] + 1, end], axis=1)  # pattern byte deleted
        take = up < diagonal
        start = np.where(take, np.concatenate([origin[:, 1:], end], axis=1), origin)
        at = at + 1
        new = np.where((at >= 0) & (at <= size[:, None]), np.where(take, up, diagonal), big)
        run = new - column  # then text bytes inserted, from the left
        best = np.minimum.accumulate(run, axis=1)
        source = np.maximum.accumulate(np.where(run == best, column, 0), axis=1)
        cost, origin = best + column, np.take_along_axis(start, source, axis=1)
        if i % 8 == 0 or i == n:
            live = cost.min(axis=1) <= edits
            if not live.all():
                rows, cost, origin, at, size, end = rows[live], cost[live], origin[live], at[live], size[live], end[live]
                inside, seen, patterns = inside[live], seen[live], patterns[live]
                if not len(rows):
                    break
    if not len(rows):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    best = cost.argmin(axis=1)
    every = np.arange(len(rows))
    return rows, cost[every, best], origin[every, best], at[every, best]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def monotonous(h: np.ndarray, depth: int, periods: int = 32) -> np.ndarray:
    """Places more than ``depth`` inside a stretch that repeats a pattern of at most ``periods`` bytes.

    What matches there matches at the stretch's ends as well, so these places tell nothing new; without them a
    long run of one letter would meet each place of a like run of the benchmark.
    """
    out = np.zeros(len(h), dtype=bool)
    step = max(depth // 4, 1)
    for p in range(1, min(periods, len(h) - 2 * depth) + 1):
        # so long a stretch holds seven places in a row of those looked at
        some = h[p::step] == h[: len(h) - p : step]
        for shift in (1, 2, 3):
            some = some[:-shift] & some[shift:]
        runs = np.flatnonzero(np.diff(np.concatenate([[0], some.view(np.int8), [0]])))
        for first, last in zip(runs[::2].tolist(), runs[1::2].tolist()):
            at, end = max((first - 1) * step, 0), (last + 7) * step
            same = h[at + p : end + p] == h[at:end][: len(h) - p - at]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            for lo, hi in zip((at + edge[::2]).tolist(), (at + edge[1::2] + p).tolist()):
                if hi - lo > 2 * depth:
                    out[lo + depth : hi - depth] = True
    return out


class Index:
    """Windows of benchmark items and the places of their q-grams.

    Each q-gram of an item is kept once, by its place among all items' bytes; a window is a run of places.
    Items shorter than q are kept whole, and must occur as whole words.
    """

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, stride: int, edit_rate: float) -> None:
        self.q, self.stride = q, stride
        self.owner: list[int] = []
        self.short: dict[int, dict[int, int]] = {}  # by length, item by hash
        folds = []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            folded, _, _ = fold(raw, np.array([0, len(raw)]))
            if len(folded) and folded[-1] == 32:
                folded = folded[:-1]
            if len(folded) >= q:
                self.owner.append(item)
                folds.append(folded)
            elif len(folded):
                self.short.setdefault(len(folded), {}).setdefault(int(gram_hashes(folded, len(folded))[0]), item)
        none = np.zeros(0, dtype=np.int64)
        size = np.array([len(x) for x in folds], dtype=np.int64)
        self.first = np.cumsum(size) - size  # of each item
        self.text = np.concatenate(folds) if folds else np.zeros(0, dtype=np.uint8)
        self.size = np.minimum(size, window)  # of an item's windows
        self.last = size - self.size  # start of its last window
        self.edits = np.minimum((edit_rate * self.size + 1e-9).astype(np.int64), np.maximum(self.size - q, 0) // q)
        self.least = self.size - q + 1 - q * self.edits
        aligned = stride % q == 0  # else windows share no blocks, and every q-gram is a seed
        self.need = self.size // q - self.edits if aligned else self.least
        seeds = []
        for x, f, n in zip(folds, self.first, self.size):
            own = np.arange(len(x) - q + 1)
            if aligned:
                own = np.union1d(own[::q], len(x) - n + np.arange(0, n - q + 1, q))
            seeds.append(own + f)
        place = np.concatenate(seeds) if seeds else none
        gram = gram_hashes(self.text, q)[place] if len(place) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.place = gram[order], place[order]
        self.distinct, starts = np.unique(self.gram, return_index=True)
        self.starts = np.append(starts, len(self.gram))
        self.depth = window + 2 * q + int(2 * edit_rate * window)
        self._mark()

    def _mark(self) -> None:
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.short_hash = (gram_hashes(self.text, self.q) >> np.uint64(33)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("bits", "short_hash")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._mark()

    def candidates(self, row: np.ndarray, diagonal: np.ndarray, place: np.ndarray, band: int) -> np.ndarray:
        """Windows with enough whole blocks in a band of diagonals: row, item, start in the item, first diagonal."""
        shift = (-(-len(self.text) // band) + 1) * band  # so that diagonals and bands aren't negative
        step = (diagonal + shift) // band
        wide, all_places = int(step.max()) + 2, len(self.text)
        # bands overlap: band b covers steps b and b + 1
        key = (row * wide + step) * all_places + place
        key = distinct(np.concatenate([key, key - all_places]))
        place = key % all_places
        group = key // all_places
        item = np.searchsorted(self.first, place, "right") - 1
        j = np.arange(len(key)) + self.need[item] - 1
        ok = j < len(key)
        i, j = np.flatnonzero(ok), j[ok]
        ok = (group[i] == group[j]) & (item[i] == item[j]) & (place[j] - place[i] <= self.size[item[i]] - self.q)
        i, j = i[ok], j[ok]
        item, group = item[i], group[i]
        lo = np.maximum(place[j] - self.first[item] - self.size[item] + self.q, 0)
        hi = np.minimum(place[i] - self.first[item], self.last[item])
        a = -(-lo // self.stride)
        n = np.maximum(hi // self.stride - a + 1, 0)
        start = (np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * self.stride
        end = np.flatnonzero(hi == self.last[item])  # an item's last window counts whatever its start
        group = np.concatenate([np.repeat(group, n), group[end]])
        item = np.concatenate([np.repeat(item, n), item[end]])
        start = np.concatenate([start, self.last[item[len(start) :]]])
        got = distinct(group * all_places + self.first[item] + start)
        group, at = got // all_places, got % all_places
        item = np.searchsorted(self.first, at, "right") - 1
        return np.stack([group // wide, item, at - self.first[item], (group % wide) * band - shift], axis=1)

    def counted(self, found: np.ndarray, size: int, edits: int, h: np.ndarray, foff: np.ndarray, band: int) -> np.ndarray:
        """Candidates of one window size that share enough q-grams with a part of their band.

        An alignment visits at most ``edits + 1`` neighbouring diagonals, so q-grams are counted in parts of the band that
        overlap by as many.  A few bits of a hash are compared: a count may be too high, never too low.
        """
        r, item, start, low = found.T
        grams = size - self.q + 1
        spot = (low + start)[:, None] + np.arange(grams + 2 * band - 1)
        inside = (spot >= 0) & (spot <= (foff[r + 1] - foff[r] - self.q)[:, None])
        text = np.where(inside, h[np.where(inside, foff[r][:, None] + spot, 0)], -1)
        pattern = self.short_hash[(self.first[item] + start)[:, None] + np.arange(grams)]
        fours = []
        for k in range(0, 2 * band, 4):
            same = text[:, k : k + grams] == pattern
            for j in range(k + 1, min(k + 4, 2 * band)):
                same |= text[:, j : j + grams] == pattern
            fours.append(same)
        many = min(-(-(edits + 4) // 4), len(fours))
        least, keep = self.least[item], np.zeros(len(found), dtype=bool)
        for k in range(len(fours) - many + 1):
            keep |= np.logical_or.reduce(fours[k : k + many]).sum(axis=1) >= least
        return found[keep]

    def whole_words(self, folded: np.ndarray, foff: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Row, item, start and end (folded) of items shorter than q."""
        for n, items in self.short.items():
            h = gram_hashes(folded, n)
            hit = np.flatnonzero(np.isin(h, np.array(list(items), dtype=np.uint64)))
            row = np.searchsorted(foff, hit, "right") - 1
            lo, hi = foff[row], foff[row + 1]
            before = np.where(hit > lo, folded[np.maximum(hit - 1, 0)] == 32, True)
            after = np.where(hit + n < hi, folded[np.minimum(hit + n, len(folded) - 1)] == 32, hit + n == hi)
            for i in np.flatnonzero(before & after).tolist():
                yield int(row[i]), items[int(h[hit[i]])], int(hit[i] - lo[i]), int(hit[i] - lo[i]) + n

    def find(self, buf: np.ndarray, off: np.ndarray, band: int, once: bool = False) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """Verified regions as (row, item, edits, start, end), in bytes of ``buf`` from the row's start, and which window it
        is (the item's number in the index, -1 for a whole word, and the window's start).

        With ``once``, a row's other candidates are let be as soon as one is verified.
        """
        folded, foff, at = fold(buf, off)
        seen = np.zeros(len(off) - 1, dtype=bool)
        for r, item, s, e in self.whole_words(folded, foff):
            seen[r] = True
            yield (*self._region(r, item, 0, s, e, buf, off, foff, at), -1, 0)
        if not len(self.gram) or len(folded) < self.q:
            return
        h = gram_hashes(folded, self.q)
        hit = self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        hit = np.flatnonzero(hit & ~monotonous(h, self.depth))
        row = np.searchsorted(foff, hit, "right") - 1
        inside = hit + self.q <= foff[row + 1]
        hit, row = hit[inside], row[inside]
        at_gram = np.minimum(np.searchsorted(self.distinct, h[hit]), len(self.distinct) - 1)
        known = self.distinct[at_gram] == h[hit]
        hit, row, at_gram = hit[known], row[known], at_gram[known]
        short = (h >> np.uint64(33)).astype(np.int32)
        for found in self._pairs(hit, row, self.starts[at_gram], self.starts[at_gram + 1], foff, band, seen if once else None):
            for size, edits in sorted({(int(a), int(b)) for a, b in zip(self.size[found[:, 1]], self.edits[found[:, 1]])}):
                some = found[(self.size[found[:, 1]] == size) & (self.edits[found[:, 1]] == edits)]
                for k in range(0, len(some), BATCH):
                    part = some[k : k + BATCH]
                    if once:
                        part = part[~seen[part[:, 0]]]
                    part = self.counted(part, size, edits, short, foff, band)
                    if not len(part):
                        continue
                    r, item, start, low = part.T
                    patterns = self.text[(self.first[item] + start)[:, None] + np.arange(size)]
                    # a window's diagonals begin where the item's do, further on by its start
                    got = banded_distances(patterns, folded, foff[r], foff[r + 1], low + start, 2 * band, edits)
                    seen[r[got[0]]] = True
                    for x, e_, s, e in zip(*(v.tolist() for v in got)):
                        yield (*self._region(int(r[x]), self.owner[int(item[x])], e_, s, e, buf, off, foff, at), int(item[x]), int(start[x]))

    def _pairs(self, hit: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, foff: np.ndarray, band: int, seen: np.ndarray | None) -> Iterator[np.ndarray]:
        """Candidates of all rows, from about ``PAIRS`` pairs of a q-gram and a place at a time.

        Rows of few pairs go together.  A row of more is cut by where a candidate's band begins in it, and a piece of it that
        can't be cut further by where its window begins in the benchmark; what lies ahead is looked at from both pieces.
        """
        n = hi - lo
        total = np.cumsum(n)
        first = 0
        while first < len(hit):
            done = total[first - 1] if first else 0
            last = int(np.searchsorted(total, done + PAIRS, "right"))
            last = len(hit) if last >= len(hit) else int(np.searchsorted(row, row[last], "left"))
            if last > first:
                yield from self._leaf(hit[first:last], row[first:last], lo[first:last], hi[first:last], foff, band)
            else:
                last = int(np.searchsorted(row, row[first], "right"))
                r = row[first]
                if seen is None or not seen[r]:
                    begin = -(len(self.text) + 4 * band)
                    work = [(begin, int(foff[r + 1] - foff[r]), 0, len(self.text))]
                    while work and not (seen is not None and seen[r]):
                        yield from self._piece(hit[first:last], int(r), lo[first:last], hi[first:last], foff, band, work)
            first = last

    def _piece(self, hit: np.ndarray, r: int, lo: np.ndarray, hi: np.ndarray, foff: np.ndarray, band: int, work: list[tuple[int, int, int, int]]) -> Iterator[np.ndarray]:
        """The candidates of the last piece of ``work`` (text from, to, benchmark from, to), or two halves of it instead."""
        x, y, a, b = work.pop()
        widest = int(self.size.max())
        reach = widest + 2 * band
        i, j = np.searchsorted(hit, [foff[r] + x, foff[r] + y + reach])
        if i == j:
            return
        lo, hi, part = lo[i:j], hi[i:j], hit[i:j]
        if a > 0 or b < len(self.text):
            lo, hi = self._between(lo, hi, a), self._between(lo, hi, b + widest)
        pairs = int((hi - lo).sum())
        if pairs > PAIRS:
            x = max(x, int(part[0] - foff[r]) - reach)
            if y - x > 2 * reach:
                work += [((x + y) // 2, y, a, b), (x, (x + y) // 2, a, b)]
                return
            if b - a > 4 * widest:
                work += [(x, y, (a + b) // 2, b), (x, y, a, (a + b) // 2)]
                return
        for found in self._leaf(part, np.full(len(part), r), lo, hi, foff, band):
            begin, window = found[:, 3] + found[:, 2], self.first[found[:, 1]] + found[:, 2]
            found = found[(begin >= x) & (begin < y) & (window >= a) & (window < b)]
            if len(found):
                yield found

    def _between(self, lo: np.ndarray, hi: np.ndarray, place: int) -> np.ndarray:
        """Per run of places ``lo`` to ``hi``, the first one at ``place`` or further on, by bisection of all runs at once."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            less = open_ & (self.place[np.minimum(mid, len(self.place) - 1)] < place)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)

    def _leaf(self, hit: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, foff: np.ndarray, band: int) -> Iterator[np.ndarray]:
        c = hi - lo
        span = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)
        if len(span):
            r, place = np.repeat(row, c), self.place[span]
            item = np.searchsorted(self.first, place, "right") - 1
            found = self.candidates(r, np.repeat(hit, c) - foff[r] - place + self.first[item], place, band)
            if len(found):
                yield found

    def _region(self, r: int, item: int, edits: int, s: int, e: int, buf: np.ndarray, off: np.ndarray, foff: np.ndarray, at: np.ndarray) -> tuple:
        s, e = max(s, 0), max(e, s + 1)
        s, e = int(at[foff[r] + s]), int(at[foff[r] + e - 1]) + 1
        while s > off[r] and buf[s] & 0xC0 == 0x80:  # whole characters
            s -= 1
        while e < off[r + 1] and buf[e] & 0xC0 == 0x80:
            e += 1
        return r, item, edits, s - int(off[r]), e - int(off[r])


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items on the driver, in blocks of a checked size."""
    rows = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total * 2 // block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect()]


def findings(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    q: int = Q, window: int = WINDOW, stride: int = STRIDE, edit_rate: float = EDIT_RATE, band: int = BAND,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and benchmark item found in it: key, ``item_id``, ``n_windows`` of the item found,
    ``edits`` (least of a window), ``start`` and ``end`` (bytes of the text, around all windows found).

    Every document is read once per block of the benchmark, whole; nothing is shuffled.  The index of a block is
    built once and broadcast, its size checked.  A null or empty text, an item without letters and digits and an
    empty benchmark give no rows; an item of under q folded bytes must occur as whole words.  Repeated rows give a row
    each.  What a text of any length takes is bounded: ``PAIRS`` seeds and ``BATCH`` candidates at a time.
    """
    if not q <= window < 1 << 16 or edit_rate * window > band:
        raise ValueError("window must be from q to 65535, and its edits at most band")
    kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item].dataType.simpleString()
    schema = f"{key} {kind}, item_id {item_kind}, n_windows long, edits long, start long, end long"
    out = None
    for items in blocks(benchmark, item, item_text, block_bytes):

        sent = docs.sparkSession.sparkContext.broadcast(Index(items, q, window, stride, edit_rate))

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for lo, _, buf, off in C.slices(batch.column(1)):
                    merged: dict[tuple[int, int], list[int]] = {}
                    windows: set[tuple[int, int, int, int]] = set()
                    for r, owner, edits, s, e, number, window in index.find(buf, off, band):
                        x = merged.setdefault((r, owner), [0, edits, s, e])
                        new = (r, owner, number, window) not in windows
                        windows.add((r, owner, number, window))
                        x[:] = [x[0] + new, min(x[1], edits), min(x[2], s), max(x[3], e)]
                    if merged:
                        keys = list(merged)
                        ids = batch.column(0).take(pa.array([lo + r for r, _ in keys]))
                        rest = list(zip(*merged.values()))
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array([o for _, o in keys]), *[pa.array(x, pa.int64()) for x in rest]],
                            names=[key, "item_id", "n_windows", "edits", "start", "end"],
                        )

        part = C.plain(docs, key, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          q: int = Q, window: int = WINDOW, stride: int = STRIDE, edit_rate: float = EDIT_RATE, band: int = BAND,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all columns, without a shuffle."""
    at, schema = docs.columns.index(text), docs.schema
    for items in blocks(benchmark, item, item_text, block_bytes):

        sent = docs.sparkSession.sparkContext.broadcast(Index(items, q, window, stride, edit_rate))

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for lo, hi, buf, off in C.slices(batch.column(at)):
                    keep = np.ones(hi - lo, dtype=bool)
                    for r, *_ in index.find(buf, off, band, once=True):
                        keep[r] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
