"""The language model's work a token, and that its quicker forms give what the plain ones do."""

import cProfile
import math
import pstats

import numpy as np
import pytest

from treeline.llm import common as C
from treeline.llm import lm

COUNTS = np.arange(92 * 32, 0, -1)


def made(n, seed=5):
    """Token numbers of documents whose lengths differ much; few numbers are frequent."""
    rng = np.random.default_rng(seed)
    return [np.minimum(rng.zipf(1.3, m), len(COUNTS)).astype(np.int32) - 1 for m in rng.integers(1, 60, n)]


def test_training_makes_few_calls():
    """Classes share their numpy calls, save for products with their own weights: a window's calls are bounded."""
    net = lm.Network.fresh(16, 92, 32, COUNTS)
    profile = cProfile.Profile()
    profile.enable()
    seen = lm.train(net, made(2000), 16, 512, 0.1)
    profile.disable()
    assert pstats.Stats(profile).total_calls < 0.27 * seen


@pytest.mark.parametrize("steep", [1, 40])
def test_log_probability_against_the_plain_network(steep):
    """Every document by itself, a token at a time; with steep output weights, logits need their maximum taken off."""
    net = lm.Network.fresh(16, 92, 32, COUNTS)
    for part in (net.to_class, net.class_bias, net.to_word, net.word_bias):
        part *= steep
    docs = made(90)
    at = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    got = lm.log_probability(net, np.concatenate(docs), at, block=512)
    wide = lm.Network(16, 92, 32, net.weights.astype(np.float64))

    def log_softmax(x):
        x = x - x.max()
        return x - math.log(np.exp(x).sum())

    def sigmoid(x):
        return 0.5 * (np.tanh(0.5 * x) + 1)

    for doc, value in zip(docs, got):
        h, want = np.zeros(16), 0.0
        for x in doc.tolist():
            c, w = divmod(x, 32)
            want += log_softmax(h @ wide.to_class + wide.class_bias)[c] + log_softmax(h @ wide.to_word[c] + wide.word_bias[c])[w]
            r, z = sigmoid(wide.inputs[x, :16] + h @ wide.gates[:, :16]), sigmoid(wide.inputs[x, 16:32] + h @ wide.gates[:, 16:])
            new = np.tanh(wide.inputs[x, 32:] + r * (h @ wide.state))
            h = new + z * (h - new)
        assert abs(value - want) < 1e-5 * abs(want)


def test_hashes_by_sums():
    """Running sums give each word's hash, whatever piece of bytes it lies in and however long it is."""
    texts = ["", "A b\tA", "x" * 700_000 + " Y", " ".join(f"W{i}" for i in range(90_000)), "é\n\nÉ "]
    buf = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, _ = C.words(buf, off)
    for lower in (False, True):
        want = C.hash_words(buf, starts, ends, lower=lower)
        for piece in (1, 1000, 1 << 18):
            assert (C.hash_words_by_sums(buf, starts, ends, lower=lower, piece=piece) == want).all()
    assert not len(C.hash_words_by_sums(buf[:0], starts[:0], ends[:0]))
