"""Shingle sets whose hashes differ in low bits only."""

import random

import numpy as np
import pytest

from treeline.llm import common as C
from treeline.llm import neardup


@pytest.mark.parametrize("bits", [6, 20])
def test_sets_are_distinct_whatever_their_hashes(monkeypatch, bits):
    plain = C.hash_grams
    monkeypatch.setattr(C, "hash_grams", lambda h, k: plain(h, k) & np.uint64((1 << bits) - 1))
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (400, 0, 3, 60, 900)]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    values, at = neardup.shingle_sets(buf, off, 2)
    for i, t in enumerate(texts):
        own = values[at[i] : at[i + 1]].tolist()
        words = np.frombuffer(t.encode(), dtype=np.uint8)
        starts, ends, _ = C.words(words, np.array([0, len(words)]))
        want = set(C.hash_grams(C.hash_words(words, starts, ends, lower=True), 2).tolist()) if len(starts) else set()
        assert sorted(own) == sorted(want) and len(own) == len(set(own))
