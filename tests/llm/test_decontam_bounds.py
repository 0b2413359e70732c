"""Decontamination of texts that share very many q-grams with the benchmark: bounded pieces, same findings."""

import random
import tracemalloc

import numpy as np
import pytest

from treeline.llm import decontam as D


def laid(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def corpus(words, items, size, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(words)]
    benchmark = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 14, 60])))) for i in range(items)]
    parts = []
    while sum(map(len, parts)) < size:
        parts.append(" ".join(rng.choices(vocabulary, k=40)))
        if rng.random() < 0.5:
            near = [rng.choice(vocabulary) if rng.random() < 0.08 else w for w in rng.choice(benchmark)[1].split()]
            parts.append(" ".join(near))
    return benchmark, " ".join(parts)


def found(index, buf, off):
    return {(r, owner, number, window) for r, owner, _, _, _, number, window in index.find(buf, off, D.BAND)}


@pytest.mark.parametrize("words, items, size", [(300, 40, 9000), (12, 6, 1500), (4, 3, 700)])
@pytest.mark.parametrize("pairs", [1, 300])
def test_pieces_find_the_same(monkeypatch, words, items, size, pairs):
    benchmark, text = corpus(words, items, size)
    index = D.Index(benchmark, D.Q, D.WINDOW, D.STRIDE, D.EDIT_RATE)
    buf, off = laid(text, "", text[: size // 3], "ab")
    monkeypatch.setattr(D, "PAIRS", 1 << 30)
    whole = found(index, buf, off)
    monkeypatch.setattr(D, "PAIRS", pairs)
    assert found(index, buf, off) == whole and whole
    rows = {r for r, *_ in whole}
    assert {r for r, *_ in index.find(buf, off, D.BAND, once=True)} == rows


@pytest.mark.parametrize("stride", [8, 5])
def test_every_window_within_the_edits_is_found(stride):
    """Blocks and counts lose no window that plain alignment finds, whether or not windows share their blocks."""
    benchmark, text = corpus(60, 5, 1200, seed=3)
    index = D.Index(benchmark, D.Q, D.WINDOW, stride, D.EDIT_RATE)
    buf, off = laid(text)
    folded = D.fold(buf, off)[0].tolist()
    want = set()
    for item, (_, t) in enumerate((i, x) for i, x in benchmark if len(x) >= D.Q):
        x = D.fold(*laid(t))[0].tolist()
        n = min(len(x), D.WINDOW)
        edits = min(int(D.EDIT_RATE * n + 1e-9), (n - D.Q) // D.Q)
        for s in sorted({*range(0, len(x) - n + 1, stride), len(x) - n}):
            row = list(range(n + 1))
            for c in folded:
                last, row = row, [0]
                for i in range(n):
                    row.append(min(last[i] + (x[s + i] != c), last[i + 1] + 1, row[i] + 1))
                if row[-1] <= edits:
                    want.add((item, s))
                    break
    got = {(number, window) for _, _, number, window in found(index, buf, off) if number >= 0}
    assert got == want and len(want) > 5


def test_memory_of_common_words():
    """100 KB of 300 common words against 300 KB of the same: the pairs would take gigabytes at once."""
    benchmark, text = corpus(300, 2000, 100_000, seed=5)
    index = D.Index(benchmark, D.Q, D.WINDOW, D.STRIDE, D.EDIT_RATE)
    buf, off = laid(text)
    tracemalloc.start()
    count = sum(1 for _ in index.find(buf, off, D.BAND, once=False))
    assert count > 0 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
