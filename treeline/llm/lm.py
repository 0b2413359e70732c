"""Language-model scoring: a gated recurrent network in numpy.

Tokens are words with A-Z lowered, and one end per document.  The network predicts, from the state after all
earlier tokens of the document, the class of the next token and then the token within its class (a
class-factored softmax); classes hold words of like frequency.  Words outside the shortlist enter and are
predicted as one of many buckets, by their hash; a bucket's words are told apart by their smoothed counts, so
every text has a probability.  Buckets grow with the vocabulary, by its square root.  Training is by truncated
backpropagation: the state is carried from window to window, gradients stay inside one.  Documents are dealt to
replicas by a hash of their id; each trains on its documents in the ids' order, and replicas are averaged by
tokens seen, for each of a few rounds, so the layout of the input doesn't change a score.  Scoring carries the
state through the whole document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm import common as C

#: Production parameters: hidden units, classes of the shortlist and tokens of a class, window, documents trained
#: at once, learning rate, rounds of averaging.
HIDDEN, CLASSES, PER_CLASS, WINDOW, STREAMS, RATE, ROUNDS = 16, 32, 32, 16, 512, 0.1, 2
#: Each round trains on one in so many training documents, chosen by a hash of the id: with as many rounds, on each once.
SHARE = 2
#: Training tokens for each replica: documents are dealt to replicas by a hash of the id, whatever the partitions.
REPLICA_TOKENS = 4_000_000
#: A window of few documents is up to so many times longer.
LONGEST = 4
#: Tokens whose softmaxes are computed at once, and documents scored side by side: what they need stays in a core's cache.
BLOCK, ABREAST = 1024, 2048
#: Where no state within -1 and 1 can make a logit beyond this, exponentials are taken without the maximum's subtraction.
MILD = 40
_POINT = 1 << 16  # replicas are summed in whole numbers, so that the order of the sum tells nothing
#: Words up to which the count table goes to the workers whole (16 bytes each); beyond, it is joined.
BROADCAST_WORDS = 8_000_000
END = 0x5EED_0E4D_0000_0001
SMOOTH = 0.1


def keep_memory() -> None:
    """Frees a block of 24 MB, after which glibc keeps freed arrays up to this size for the next ones.

    Otherwise each array beyond 128 kB is mapped and cleared anew, page by page; elsewhere this does nothing.
    """
    np.empty(24 << 20, dtype=np.uint8)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each row's end included, and where each row's begin (one more at the end)."""
    starts, ends, rows = C.words(buf, off)
    n = len(off) - 1
    counts = C.row_counts(rows, n)
    out = np.full(len(rows) + n, END, dtype=np.uint64)
    out[np.arange(len(rows)) + rows] = C.hash_words_by_sums(buf, starts, ends, lower=True)
    return out, np.concatenate([[0], np.cumsum(counts + 1)])


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is divisible by 10; a null key counts as an empty text (0)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(10)) == 0


def count_tokens(texts: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n`` over the column ``text`` of all rows; counted in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        word, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(C.signed(word)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for _, _, buf, off in C.slices(batch.column(0), 4 * C.SLICE_BYTES):
                more, times = np.unique(tokens(buf, off)[0], return_counts=True)
                both, at = np.unique(np.concatenate([word, more]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, times]), len(both)).astype(np.int64)
                word = both
                if len(word) > 1_000_000:
                    yield out()
                    word, n = word[:0], n[:0]
        yield out()

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Shortlist:
    """The most frequent tokens, by number; the numbers from ``size`` on are the buckets of all others."""

    words: np.ndarray  # sorted hashes
    numbers: np.ndarray
    size: int
    counts: np.ndarray  # by number
    mass: np.ndarray  # of each bucket's words and one unknown word, smoothed

    def number(self, unique: np.ndarray) -> np.ndarray:
        bucket = self.size + ((unique >> np.uint64(32)) % np.uint64(len(self.mass))).astype(np.int32)
        if not len(self.words):
            return bucket
        at = np.minimum(np.searchsorted(self.words, unique), len(self.words) - 1)
        return np.where(self.words[at] == unique, self.numbers[at], bucket).astype(np.int32)

    def rare_mass(self, number: np.ndarray) -> np.ndarray:
        """The mass of each number's bucket; 0 for tokens of the shortlist."""
        return np.where(number >= self.size, self.mass[np.maximum(number - self.size, 0)], 0.0)


def shortlist(counts: DataFrame, classes: int, per_class: int, words: int) -> Shortlist:
    """``classes`` classes of the most frequent tokens, and about ``sqrt(words)`` buckets in classes of their own."""
    size = classes * per_class
    n_buckets = per_class * max(1, -(-math.isqrt(words) // per_class))
    rows = counts.orderBy(F.col("n").desc(), "word").limit(size).collect()
    word = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    bucket = F.pmod(F.shiftrightunsigned("word", 32), F.lit(n_buckets)).cast("int").alias("bucket")
    rest, kinds = np.zeros(n_buckets, dtype=np.int64), np.zeros(n_buckets, dtype=np.int64)
    for r in counts.groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        rest[r["bucket"]], kinds[r["bucket"]] = r["n"], r["kinds"]
    own = ((word >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
    np.subtract.at(rest, own, n)
    np.subtract.at(kinds, own, 1)
    order = np.argsort(word)
    by_number = np.concatenate([n, np.zeros(size - len(n), dtype=np.int64), rest])
    return Shortlist(word[order], np.arange(len(word))[order].astype(np.int32), size, by_number, rest + SMOOTH * (kinds + 1))


def by_number(token: np.ndarray, kinds: int) -> np.ndarray:
    """The stable order of token numbers below ``kinds``; those of 16 bits are sorted by radix."""
    return np.argsort(token.astype(np.uint16) if kinds <= 1 << 16 else token, kind="stable")


_GRID = np.float32(1 << 24)


def exact(weights: np.ndarray) -> np.ndarray:
    """Weights of 4-byte floats for ``product``, rounded to multiples of a power of 2, about as fine as their floats.

    A sum of their products with states then has at most 53 bits, so its order, which BLAS chooses by a column's
    place, tells nothing: a score depends on its own text only.
    """
    if weights.dtype != np.float32:
        return weights
    unit = 2.0 ** (28 - math.frexp(float(np.abs(weights).max(initial=0)) * weights.shape[-1])[1])
    return np.rint(weights * np.float64(unit)) / (unit * float(_GRID))


def on_grid(states: np.ndarray) -> np.ndarray:
    return np.rint(states * _GRID).astype(np.float64)


def product(weights: np.ndarray, states: np.ndarray) -> np.ndarray:
    """``weights @ states``; without rounding before the end for weights made by ``exact``."""
    if weights.dtype == states.dtype:
        return weights @ states
    return (weights @ on_grid(states)).astype(states.dtype)


@dataclass
class Network:
    """A gated recurrent network with a class-factored output; all weights in one vector.

    States are (documents, units); inside, units lie along the first axis, so that whole rows are worked on.
    """

    hidden: int
    classes: int
    per_class: int
    weights: np.ndarray
    shapes: list[tuple[str, tuple[int, ...]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        h, v = self.hidden, self.classes * self.per_class
        self.shapes = [
            ("inputs", (v, 3 * h)), ("gates", (h, 2 * h)), ("state", (h, h)), ("to_class", (h, self.classes)),
            ("class_bias", (self.classes,)), ("to_word", (self.classes, h, self.per_class)), ("word_bias", (self.classes, self.per_class)),
        ]
        at = 0
        for name, shape in self.shapes:
            n = int(np.prod(shape))
            setattr(self, name, self.weights[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, hidden: int, classes: int, per_class: int, counts: np.ndarray) -> Network:
        """Small random weights and biases that predict the tokens' frequencies; the same for every fit."""
        h, v = hidden, classes * per_class
        n = v * 3 * h + 3 * h * h + h * classes + classes + classes * h * per_class + v
        net = cls(hidden, classes, per_class, np.random.default_rng(11).normal(0, 0.08, n).astype(np.float32))
        freq = (counts + 0.5).reshape(classes, per_class)
        net.class_bias[:] = np.log(freq.sum(1) / freq.sum())
        net.word_bias[:] = np.log(freq / freq.sum(1, keepdims=True))
        return net

    def recurrent(self) -> np.ndarray:
        """The weights that meet a state, a row for each unit of both gates and the candidate."""
        return np.ascontiguousarray(np.concatenate([self.gates, self.state], axis=1).T)

    def advance(self, x: np.ndarray, h: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after inputs ``x``, with what the backward pass needs: gates, candidate's share of the state, candidate.

        All have units along the first axis.
        """
        k = self.hidden
        met = product(recurrent, h)
        gates, lean = met[: 2 * k], met[2 * k :]
        gates += x[: 2 * k]
        np.negative(gates, out=gates)
        np.minimum(gates, 80, out=gates)  # its exponential is finite
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = gates[:k] * lean
        new += x[2 * k :]
        np.tanh(new, out=new)
        out = h - new
        out *= gates[k:]
        out += new
        return out, gates, lean, new

    def step(self, token: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after ``token``, with what the backward pass needs."""
        return tuple(a.T for a in self.advance(self.rows(token), h.T, self.recurrent()))

    def rows(self, token: np.ndarray) -> np.ndarray:
        """The inputs of tokens, units along the first axis."""
        return np.ascontiguousarray(np.take(self.inputs, token, axis=0, mode="clip").T)

    def output(self, h: np.ndarray, token: np.ndarray, grads: Network | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Natural log probabilities of ``token`` after states ``h``; with ``grads``, the states' gradients instead.

        Tokens are sorted by number, thus by class, and taken in blocks.  Softmaxes run over a whole block; only
        products with a class's own weights run by class.
        """
        k, n = self.hidden, len(token)
        order = by_number(token, len(self.inputs))
        cls, word = np.divmod(token[order], self.per_class)
        states = np.ones((k + 1, n), dtype=np.result_type(h, self.weights))  # a last unit of 1 meets the biases
        np.take(h.T.astype(states.dtype, copy=False), order, axis=1, out=states[:k], mode="clip")
        to_class = np.ascontiguousarray(np.concatenate([self.to_class, self.class_bias[None]]).T)
        to_word = np.ascontiguousarray(np.concatenate([self.to_word, self.word_bias[:, None]], axis=1).swapaxes(1, 2))
        mild = max(np.abs(w).sum(-1).max() for w in (to_class, to_word)) <= MILD
        kind, meeting = states.dtype, states
        if grads is None and kind == np.float32:
            to_class, to_word, meeting = exact(to_class), exact(to_word), on_grid(states)
        class_grads, word_grads = np.zeros_like(to_class), np.zeros_like(to_word if grads is not None else to_word[:0])
        edges = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        every = np.arange(min(n, BLOCK))
        out = np.empty(n if grads is None else (k, n), dtype=states.dtype)
        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            part, few = states[:, lo:hi], every[: hi - lo]
            own = [(c, max(edges[c], lo) - lo, min(edges[c + 1], hi) - lo) for c in range(cls[lo], cls[hi - 1] + 1) if edges[c] < edges[c + 1]]
            # classes and words lie along the first axis, so that sums over them run along whole rows
            across, inside = to_class @ meeting[:, lo:hi], np.empty((self.per_class, hi - lo), dtype=meeting.dtype)
            for c, i, j in own:
                np.matmul(to_word[c], meeting[:, lo + i : lo + j], out=inside[:, i:j])
            log, totals = 0, []
            across, inside = across.astype(kind, copy=False), inside.astype(kind, copy=False)
            for logits, chosen in ((across, cls[lo:hi]), (inside, word[lo:hi])):
                if not mild:
                    logits -= logits.max(0)
                if grads is None:
                    log = log + logits[chosen, few]
                np.exp(logits, out=logits)
                totals.append(np.add.reduce(logits, 0) if hi - lo > 1 else np.add.accumulate(logits, 0)[-1])  # a lone column in the same order
                if grads is not None:
                    logits[chosen, few] -= totals[-1]  # all gradients are divided by the totals below
            if grads is None:
                out[lo:hi] = log - np.log(totals[0] * totals[1])
                continue
            class_grads += across @ (part / totals[0]).T
            back, deep, share = (across.T @ self.to_class.T).T, out[:, lo:hi], part / totals[1]
            for c, i, j in own:
                word_grads[c] += inside[:, i:j] @ share[:, i:j].T
                np.matmul(self.to_word[c], inside[:, i:j], out=deep[:, i:j])
            deep /= totals[1]
            back /= totals[0]
            deep += back
        place = np.empty_like(order)
        place[order] = np.arange(n)
        result = np.take(out, place, axis=-1, mode="clip")
        if grads is None:
            return result, None
        grads.to_class += class_grads[:, :k].T
        grads.class_bias += class_grads[:, k]
        grads.to_word += word_grads[:, :, :k].swapaxes(1, 2)
        grads.word_bias += word_grads[:, :, k]
        return None, result.T

    def window(self, x: np.ndarray, h: np.ndarray, lengths: np.ndarray, grads: Network) -> np.ndarray:
        """One window of truncated backpropagation.  ``x`` is (time, stream), streams by length descending;
        ``lengths`` are the tokens each has here.  Adds gradients to ``grads`` and returns the new states."""
        k, t = self.hidden, len(x)
        active = [int(np.searchsorted(-lengths, -i, "left")) for i in range(t)]
        ends = np.concatenate([[0], np.cumsum(active)]).tolist()
        token = np.concatenate([x[i, : active[i]] for i in range(t)]).astype(np.int64)
        inputs, recurrent = self.rows(token), self.recurrent()
        now = h.T.copy()
        prior, new, lean = (np.empty((k, ends[-1]), dtype=now.dtype) for _ in range(3))
        gates = np.empty((2 * k, ends[-1]), dtype=now.dtype)
        for n, s, e in zip(active, ends, ends[1:]):
            prior[:, s:e] = now[:, :n]
            now[:, :n], gates[:, s:e], lean[:, s:e], new[:, s:e] = self.advance(inputs[:, s:e], prior[:, s:e], recurrent)
        _, back = self.output(prior.T, token, grads)
        back = back.T
        # how a state's gradient reaches the candidate, the gates and the candidate's share of the prior state
        r, z = gates[:k], gates[k:]
        to_new = (1 - z) * (1 - new * new)
        to_met = np.concatenate([to_new * lean * r * (1 - r), (prior - new) * z * (1 - z), to_new * r])
        down = np.ascontiguousarray(recurrent.T)
        d = np.zeros((k, ends[-1]), dtype=now.dtype)
        parts = to_met.reshape(3, k, ends[-1])
        for i in range(t - 1, 0, -1):
            n, s, e = active[i], ends[i], ends[i + 1]
            own = d[:, s:e]
            parts[:, :, s:e] *= own
            later = down @ to_met[:, s:e]
            later += own * z[:, s:e]
            later += back[:, s:e]
            d[:, ends[i - 1] : ends[i - 1] + n] = later
        parts[:, :, : ends[1]] *= d[:, : ends[1]]
        met = prior @ to_met.T
        grads.gates += met[:, : 2 * k]
        grads.state += met[:, 2 * k :]
        to_new *= d
        got, at = np.zeros((3 * k, len(grads.inputs)), dtype=now.dtype), token.astype(np.intp)
        for row, values in zip(got, (*to_met[: 2 * k], *to_new)):
            np.add.at(row, at, values)
        grads.inputs += got.T
        return now.T


def train(net: Network, docs: list[np.ndarray], window: int, streams: int, rate: float) -> int:
    """Trains ``net`` in place on token numbers of documents with AdaGrad; returns the tokens seen.

    Documents of like length are trained side by side; the state runs through the whole of each.
    """
    docs = sorted(docs, key=len, reverse=True)
    groups = [docs[i : i + streams] for i in range(0, len(docs), streams)]
    square, room = np.full_like(net.weights, 1e-3), np.empty_like(net.weights)
    grads = Network(net.hidden, net.classes, net.per_class, np.empty_like(net.weights))
    seen = 0
    for g in np.random.default_rng(len(groups)).permutation(len(groups)):
        group = groups[g]
        size = np.array([len(p) for p in group])
        x = np.zeros((size[0], len(group)), dtype=np.int32)
        for i, p in enumerate(group):
            x[: len(p), i] = p
        h = np.zeros((len(group), net.hidden), dtype=np.float32)
        t = 0
        while t < size[0]:
            n = int(np.searchsorted(-size, -t, "left"))
            span = min(max(streams * window // (2 * n), window), LONGEST * window)  # a window of few documents is longer
            here = np.minimum(size[:n] - t, span)
            grads.weights[:] = 0
            h = net.window(x[t : t + span, :n], h[:n], here, grads)
            t += span
            count = int(here.sum())
            step = grads.weights
            step /= max(count, 64)
            square += np.multiply(step, step, out=room)
            step *= rate
            step /= np.sqrt(square, out=room)
            net.weights -= step
            seen += count
    return seen


def log_probability(net: Network, flat: np.ndarray, at: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Natural log probability of each document, given all token numbers and where each document begins.

    Documents of like length advance side by side, longest first; the state runs through the whole of each.
    """
    sizes = np.diff(at)
    longest = np.argsort(-sizes, kind="stable")
    recurrent = exact(net.recurrent())
    result = np.empty(len(sizes))
    for lo in range(0, len(longest), ABREAST):
        order = longest[lo : lo + ABREAST]
        size, first, every = sizes[order], at[:-1][order], np.arange(len(order))
        out = np.zeros(len(order))
        h = np.zeros((net.hidden, len(order)), dtype=np.float32)
        states, targets, held, last = [], [], 0, int(size[0])
        for t, n in enumerate(np.searchsorted(-size, -np.arange(last), "left").tolist()):
            token = flat[first[:n] + t]
            h = h[:, :n]
            states.append(h)
            targets.append(token)
            held += n
            if held >= block or t + 1 == last:
                got, _ = net.output(np.concatenate(states, axis=1).T, np.concatenate(targets).astype(np.int64))
                np.add.at(out, np.concatenate([every[: len(m)] for m in targets]), got.astype(np.float64))  # in the order of a text
                states, targets, held = [], [], 0
            if t + 1 < last:
                h = net.advance(net.rows(token), h, recurrent)[0]
        result[order] = out
    return result


def fit(texts: DataFrame, short: Shortlist, rounds: int, share: int, replicas: int, streams: int = STREAMS, rate: float = RATE) -> Network:
    """Trains on ``texts`` (``id``, ``text``): each round, one in ``share`` rows, by a hash of the id."""
    classes = len(short.counts) // PER_CLASS
    net = Network.fresh(HIDDEN, classes, PER_CLASS, short.counts)
    bucket = F.pmod(F.xxhash64("id"), F.lit(share))
    replica = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(replicas)).alias("replica")
    for k in range(rounds):
        start = net.weights.copy()

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            keep_memory()
            own, docs, held, seen, now = Network(HIDDEN, classes, PER_CLASS, start.copy()), [], 0, 0, None

            def learn() -> None:
                nonlocal docs, held, seen
                seen += train(own, docs, WINDOW, streams, rate) if docs else 0
                docs, held = [], 0

            def result() -> Iterator[pa.RecordBatch]:
                learn()
                if seen:
                    value = np.rint(own.weights.astype(np.float64) * seen * _POINT).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(len(value))), pa.array(value), pa.array(np.full(len(value), seen))], names=["k", "x", "w"]
                    )

            for batch in batches:
                which = batch.column(0).to_numpy()
                edge = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(which)]])
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    if s < e and which[s] != now:
                        yield from result()
                        own, seen, now = Network(HIDDEN, classes, PER_CLASS, start.copy()), 0, which[s]
                    for _, _, buf, off in C.slices(batch.column(1).slice(s, e - s)):
                        token, at = tokens(buf, off)
                        unique, where = np.unique(token, return_inverse=True)
                        number = short.number(unique)[where]
                        docs += [number[at[i] : at[i + 1]] for i in range(len(off) - 1)]
                        held += len(number)
                        if held > REPLICA_TOKENS:
                            learn()
            yield from result()

        part = texts.filter(bucket == k % share).select(replica, "id", "text").repartition(replicas, "replica").sortWithinPartitions("replica", "id", "text")
        sums = part.select("replica", "text").mapInArrow(run, "k long, x long, w long").groupBy("k").agg(F.sum("x").alias("x"), F.sum("w").alias("w"))
        rows = sums.toArrow()
        if rows.num_rows:
            weights = np.zeros(len(start), dtype=np.float32)
            weights[rows["k"].to_numpy()] = rows["x"].to_numpy() / (rows["w"].to_numpy() * float(_POINT))
            net = Network(HIDDEN, classes, PER_CLASS, weights)
    return net


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, share: int = SHARE, streams: int = STREAMS,
    broadcast_words: int = BROADCAST_WORDS, replica_tokens: int = REPLICA_TOKENS,
) -> DataFrame:
    """One row per document: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Scores are log10 probabilities of whole texts.  A null or empty text is its end alone; repeated rows are
    scored each; with no training document, nothing is known and the network keeps its first weights.
    """
    plain = C.plain(docs, key, text)
    training = plain.filter(~held_out(F.col("id")))
    counts = C.cut(count_tokens(training))
    total, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = shortlist(counts, CLASSES, PER_CLASS, words)
    net = fit(training, short, rounds, share, max(1, -(-total // replica_tokens)), streams)
    weights = net.weights
    kind = docs.schema[key].dataType.simpleString()
    scale = total + SMOOTH * (words + 1)
    whole = words <= broadcast_words
    known = None
    if whole:
        got = counts.toArrow()
        word, n = got["word"].to_numpy().view(np.uint64), got["n"].to_numpy()
        order = np.argsort(word)
        known = docs.sparkSession.sparkContext.broadcast((word[order], n[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        model = Network(HIDDEN, len(short.counts) // PER_CLASS, PER_CLASS, weights)
        ids, number, size, columns = [], [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum(np.concatenate(size))])
            natural = log_probability(model, np.concatenate(number), at)
            n, n_known, base, other = (np.concatenate(c) for c in zip(*columns))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(n), pa.array(n_known), pa.array(base), pa.array(natural / np.log(10) + other)],
                names=["id", "n_tokens", "n_known", "base_score", "score"],
            )

        for batch in batches:
            for lo, hi, buf, off in C.slices(batch.column(1)):
                token, at = tokens(buf, off)
                unique, where = np.unique(token, return_inverse=True)
                short_number = short.number(unique)
                n = np.diff(at)
                n_known = base = other = np.zeros(len(n))
                if known is not None:
                    count = lookup(*known.value, unique)
                    n_known = np.add.reduceat((count > 0)[where].astype(np.int64), at[:-1])
                    base = np.add.reduceat(np.log10((count + SMOOTH) / scale)[where], at[:-1])
                    mass = short.rare_mass(short_number)
                    rare = np.where(mass > 0, np.log10((count + SMOOTH) / np.where(mass > 0, mass, 1.0)), 0.0)
                    other = np.add.reduceat(rare[where], at[:-1])
                ids.append(batch.column(0).slice(lo, hi - lo))
                number.append(short_number[where])
                size.append(n)
                columns.append((n, n_known.astype(np.int64), base, other))
                held += len(token)
                if held > 8_000_000:
                    yield out()
                    ids, number, size, columns, held = [], [], [], [], 0
        if ids:
            yield out()

    schema = "n_tokens long, n_known long, base_score double, score double"
    last = [F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"]
    if whole:
        return plain.mapInArrow(run, f"id {kind}, {schema}").select("id", held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", *last)
    return _joined(plain, counts, run, kind, schema, short, scale, last)


def lookup(word: np.ndarray, n: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """Counts of the words ``unique``; 0 where ``word`` (sorted) hasn't it."""
    if not len(word):
        return np.zeros(len(unique), dtype=np.int64)
    at = np.minimum(np.searchsorted(word, unique), len(word) - 1)
    return np.where(word[at] == unique, n[at], 0)


def _joined(plain: DataFrame, counts: DataFrame, run, kind: str, schema: str, short: Shortlist, scale: float, last: list) -> DataFrame:  # noqa: ANN001
    """The way for count tables too large to send: a document's distinct words meet their counts in a join."""
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in C.slices(batch.column(1)):
                token, at = tokens(buf, off)
                unique, where = np.unique(token, return_inverse=True)
                pair, times = np.unique(np.repeat(np.arange(hi - lo), np.diff(at)) * len(unique) + where, return_counts=True)
                cuts = np.searchsorted(pair // len(unique), np.arange(hi - lo + 1)).astype(np.int32)
                w = unique[pair % len(unique)]
                mass = short.rare_mass(short.number(w))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)]
                    + [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (C.signed(w), times.astype(np.int64), mass)],
                    names=["id", "row", "words", "times", "mass"],
                )

    marked = C.cut(plain.withColumn("row", F.monotonically_increasing_id()))
    scored = C.cut(
        marked.select("id", "text", "row").mapInArrow(_with_row(run), f"id {kind}, {schema}, row long")
    )
    bag = marked.select("id", "text", "row").mapInArrow(bags, f"id {kind}, row long, words array<long>, times array<long>, mass array<double>")
    flat = bag.select("row", F.explode(F.arrays_zip("words", "times", "mass")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"), F.col("x.mass").alias("mass"))
    met = flat.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    log = F.log10((F.col("n") + SMOOTH) / scale) * F.col("times")
    rare = F.when(F.col("mass") > 0, F.log10((F.col("n") + SMOOTH) / F.col("mass")) * F.col("times")).otherwise(0.0)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(log).alias("base"), F.sum(rare).alias("other")
    )
    out = scored.drop("n_known", "base_score").join(sums, "row").withColumn("score", F.col("score") + F.col("other"))
    return out.withColumnsRenamed({"known": "n_known", "base": "base_score"}).select("id", held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", *last)


def _with_row(run):  # noqa: ANN001, ANN202
    """``run`` with the column ``row`` carried along, in the same order."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.Array] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows.append(batch.column(2))
                yield batch.select(["id", "text"])

        at = 0
        for out in run(seen()):
            row = pa.concat_arrays(rows).slice(at, out.num_rows)
            at += out.num_rows
            yield out.append_column("row", row)

    return both
