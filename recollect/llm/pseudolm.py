"""Masked pseudo-likelihood: a window network predicts every word from both sides.

A word is told by its class, then by its way down a binary tree over the class's words. Both depend on the window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.batches import bounded, gathered

BUCKETS = 1 << 18  # words are counted by hash; also the bound of what reaches the driver
SINGLE, BANDS = 32, 32  # output classes: the most frequent buckets alone, the others in bands of equal mass
ROWS = 1024  # input vectors: the most frequent buckets, one for each band, one for the edge of a text
SIDE, DIM, HIDDEN = 2, 8, 24  # words on either side, size of a vector, hidden units
BLOCK = 8192
TREE_BATCHES = 32  # batches of words whose ways down the trees are learned together
TREE_RATE, TREE_START = 0.3, 10.0  # of their AdaGrad steps; the start keeps what is rarely seen near its share
UNITS = 7  # hidden units that the trees read
WIDE = UNITS + 1  # parameters of a cut; the others are added up as many at a time
PARAMS = (ROWS + BANDS + 1, DIM), (2 * SIDE * DIM, HIDDEN), (HIDDEN,), (HIDDEN, SINGLE + BANDS), (SINGLE + BANDS,)


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of the words of a text, A-Z lower-cased."""
    w = (text or "").encode().lower().split()
    return np.fromiter(map(zlib.crc32, w), np.int64, len(w)) % BUCKETS


@dataclass
class Vocabulary:
    """By bucket: input row, output class, log probability inside the class and place in the order of classes and counts.

    ``cum`` is the mass before each place, ``edge`` the first place of each band. A band is halved by mass until one
    word is left; a cut is named after the first place behind it, so every place but a band's first names one.
    """

    row: np.ndarray
    cls: np.ndarray
    inside: np.ndarray
    place: np.ndarray
    cum: np.ndarray
    edge: np.ndarray

    @cached_property
    def ways(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First step and steps of each place, then of every step: its cut and whether the word lies behind it (1) or before it (-1).

        Made anew in each process.
        """
        lo, hi = np.searchsorted(self.edge, np.arange(BUCKETS), "right") - 1, None
        lo, hi = np.where(lo >= 0, self.edge[lo], 0), np.where(lo >= 0, np.append(self.edge[1:], BUCKETS)[lo], 1)
        place = np.arange(BUCKETS)
        lo, hi = np.where(place < self.edge[0], place, lo), np.where(place < self.edge[0], place + 1, hi)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_ = np.flatnonzero(hi - lo > 1)
        lo, hi = lo[open_], hi[open_]
        while len(open_):
            cut = np.clip(np.searchsorted(self.cum, (self.cum[lo] + self.cum[hi]) / 2), lo + 1, hi - 1)
            behind = open_ >= cut
            steps.append((open_, cut, np.where(behind, 1, -1)))
            lo, hi = np.where(behind, cut, lo), np.where(behind, hi, cut)
            on = hi - lo > 1
            open_, lo, hi = open_[on], lo[on], hi[on]
        of, cut, side = (np.concatenate([np.zeros(0, int), *x]) for x in zip(*steps))
        by = np.argsort(of, kind="stable")
        n = np.bincount(of, minlength=BUCKETS)
        return (np.cumsum(n) - n).astype(np.int32), n.astype(np.int32), cut[by].astype(np.int32), side[by].astype(np.float32)

    @cached_property
    def odds(self) -> np.ndarray:
        """By cut, the log of the mass behind it over the mass before it: what an untrained tree goes by."""
        first, n, cut, side = self.ways
        lo, hi = np.full(BUCKETS, BUCKETS), np.zeros(BUCKETS, np.int64)
        place = np.repeat(np.arange(BUCKETS), n)
        np.minimum.at(lo, cut, place)
        np.maximum.at(hi, cut, place + 1)
        out, of = np.zeros(BUCKETS), np.unique(cut)
        out[of] = np.log(self.cum[hi[of]] - self.cum[of]) - np.log(self.cum[of] - self.cum[lo[of]])
        return out.astype(np.float32)

    def steps(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All steps of the ways to the ``words``: whose, at which cut, to which side."""
        first, n, cut, side = self.ways
        at = self.place[words]
        n = n[at]
        of = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(words)), n), cut[of], side[of]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ways", "odds")}

    @classmethod
    def of(cls, counts: np.ndarray) -> "Vocabulary":
        order = np.lexsort((np.arange(BUCKETS), -counts))
        smooth = counts + 0.5
        tail = order[SINGLE:]
        mass = np.cumsum(smooth[tail])
        band = np.minimum((BANDS * (mass - smooth[tail] / 2) / mass[-1]).astype(int), BANDS - 1)
        out = np.empty(BUCKETS, np.int64)
        out[order[:SINGLE]] = np.arange(SINGLE)
        out[tail] = SINGLE + band
        row = ROWS + np.maximum(out - SINGLE, 0)
        row[order[:ROWS]] = np.arange(ROWS)
        total = np.bincount(out, weights=smooth, minlength=SINGLE + BANDS)
        place = np.empty(BUCKETS, np.int32)
        place[order] = np.arange(BUCKETS)
        bands = np.flatnonzero(np.diff(band, prepend=-1)) + SINGLE
        return cls(row.astype(np.int32), out.astype(np.int32), np.log(smooth / total[out]).astype(np.float32),
                   place, np.concatenate([[0.0], np.cumsum(smooth[order])]), bands)


def word_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all words of all documents by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b["t"]:
                total += np.bincount(buckets(t), minlength=BUCKETS) if t and len(t) > 1 << 20 else 0
            small = [buckets(t) for t in b["t"] if not t or len(t) <= 1 << 20]
            if small:
                total += np.bincount(np.concatenate(small), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = bounded(docs).select(F.col(text).alias("t")).mapInPandas(run, "bucket bigint, n bigint")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def start(seed: int = 1) -> list[np.ndarray]:
    """Parameters of the classes, then of the cuts: weights of ``UNITS`` hidden units and, last, a number added to the cut's odds."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(0, 0.3 if k == 0 else s[0] ** -0.5, s) if len(s) == 2 else np.zeros(s) for k, s in enumerate(PARAMS)]
    return [p.astype(np.float32) for p in out] + [np.zeros((BUCKETS, WIDE), np.float32)]


def _windows(ids: list[np.ndarray], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Input rows of all texts with an edge between them, and where the words are."""
    edge = ROWS + BANDS
    size = sum(len(i) + SIDE for i in ids) + SIDE
    rows = np.full(size, edge, np.int32)
    place = np.empty(sum(len(i) for i in ids), np.int64)
    at, n = SIDE, 0
    for i in ids:
        rows[at : at + len(i)] = vocab.row[i]
        place[n : n + len(i)] = np.arange(at, at + len(i))
        at, n = at + len(i) + SIDE, n + len(i)
    return rows, place


_AROUND = np.array([k for k in range(-SIDE, SIDE + 1) if k])


def _logits(net: list[np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = net[0][around].reshape(len(around), -1)
    hidden = np.tanh(vectors @ net[1] + net[2])
    return vectors, hidden, hidden @ net[3] + net[4]


def _learn(net: list[np.ndarray], square: list[np.ndarray], around: np.ndarray, target: np.ndarray, rate: float) -> np.ndarray:
    """One AdaGrad step on a batch; the hidden units before it."""
    vectors, hidden, out = _logits(net, around)
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    out[np.arange(len(target)), target] -= 1
    out /= len(target)
    d_hidden = (out @ net[3].T) * (1 - hidden * hidden)
    d_vectors = (d_hidden @ net[1].T).reshape(-1, DIM)
    cell = around.reshape(-1, 1) * DIM + np.arange(DIM)
    d_rows = np.bincount(cell.ravel(), weights=d_vectors.ravel(), minlength=net[0].size).astype(np.float32).reshape(net[0].shape)
    grads = [d_rows, vectors.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ out, out.sum(axis=0)]
    for p, g, s in zip(net, grads, square):
        s += g * g
        p -= rate * g / (np.sqrt(s) + 1e-6)
    return hidden


def _read(hidden: np.ndarray) -> np.ndarray:
    """What the trees read of the hidden units, and a 1."""
    return np.concatenate([hidden[:, :UNITS], np.ones((len(hidden), 1), np.float32)], axis=1)


def _turns(tree: np.ndarray, vocab: Vocabulary, seen: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all steps to the ``words``: whose, at which cut, to which side, and the log odds of that side."""
    whose, cut, side = vocab.steps(words)
    return whose, cut, side, (np.einsum("ij,ij->i", tree[cut], seen[whose]) + vocab.odds[cut]) * side


def _learn_ways(tree: np.ndarray, square: np.ndarray, met: np.ndarray, vocab: Vocabulary, seen: np.ndarray, words: np.ndarray, rate: float) -> None:
    """One AdaGrad step of the trees on a batch; ``met`` counts the steps at each cut."""
    order = np.argsort(vocab.place[words])  # in this order equal cuts of one depth come one after the other
    whose, cut, side, odds = _turns(tree, vocab, seen := seen[order], words[order])
    if not len(cut):
        return
    first = np.flatnonzero(np.diff(whose, prepend=-1))
    depth = np.arange(len(whose)) - np.repeat(first, np.diff(first, append=len(whose)))
    by = np.argsort(depth.astype(np.int8), kind="stable")
    wrong = (-side / (1 + np.exp(np.minimum(odds, 30))))[by]
    cut = cut[by]
    at = np.flatnonzero(np.diff(cut, prepend=-1))
    of, n = cut[at], np.diff(at, append=len(by))
    grad = np.add.reduceat(seen[whose[by]] * wrong[:, None], at)
    square[of] += np.einsum("ij,ij->i", grad, grad) / WIDE
    tree[of] -= rate * grad / np.sqrt(square[of])[:, None]
    met[of] += n


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", rounds: int = 1, rate: float = 0.15) -> list[np.ndarray]:
    """Data-parallel training: each task learns from every word of its rows; the tasks'
    parameters are averaged, weighted by their words, those of a cut by the steps a task saw at it. The sums are made
    by Spark, parameter by parameter and cut by cut."""
    net = start()
    shapes = [p.shape for p in net]
    cuts = np.cumsum([p.size for p in net[:5]])
    slim, names = bounded(docs).select(F.col(text).alias("t")), [f"p{k}" for k in range(WIDE)]
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((net, vocab))

        def run(batches: Iterator[pd.DataFrame], sent: Broadcast = sent) -> Iterator[pd.DataFrame]:
            net, vocab = sent.value
            mine, square = [p.copy() for p in net], [np.full_like(p, 1e-3) for p in net[:5]]
            ways, met = np.full(BUCKETS, TREE_START, np.float32), np.zeros(BUCKETS, np.int64)
            n, held, size = 0, [], 0
            rng = np.random.default_rng(0)

            def flush() -> None:
                nonlocal n, size
                rows, place = _windows(held, vocab)
                word = np.concatenate(held) if held else np.zeros(0, np.int64)
                target = vocab.cls[word]
                pick, hidden = np.arange(len(target)), []
                rng.shuffle(pick)
                for a in range(0, len(pick), 256):
                    p = pick[a : a + 256]
                    hidden.append(_read(_learn(mine, square, rows[place[p][:, None] + _AROUND], target[p], rate)))
                    if len(hidden) == TREE_BATCHES or a + 256 >= len(pick):
                        p = pick[a + 256 - 256 * len(hidden) : a + 256]
                        _learn_ways(mine[5], ways, met, vocab, np.concatenate(hidden), word[p], TREE_RATE)
                        hidden.clear()
                n += len(pick)
                held.clear()
                size = 0

            for b in batches:
                for t in b["t"]:
                    held.append(buckets(t))
                    size += len(held[-1])
                    if size > 400_000:
                        flush()
            flush()
            if n:
                flat = np.concatenate([p.ravel() for p in mine[:5]]).astype(np.float64)
                cells = np.concatenate([flat, np.zeros(-len(flat) % WIDE)]).reshape(-1, WIDE)
                at = np.flatnonzero(met)
                sums = pd.DataFrame(np.concatenate([cells * n, mine[5][at].astype(np.float64) * met[at, None]]), columns=names)
                sums.insert(0, "i", np.concatenate([np.arange(len(cells)) - len(cells), at]))
                yield sums.assign(n=np.concatenate([np.full(len(cells), n), met[at]]))

        means = [(F.sum(c) / F.sum("n")).cast("float").alias(c) for c in names]
        sums = slim.mapInPandas(run, f"i bigint, {', '.join(f'{c} double' for c in names)}, n bigint").groupBy("i").agg(*means)
        sums = sums.toPandas()  # at most a row for every bucket
        if len(sums):
            sums = sums.sort_values("i")
            at, values = sums["i"].to_numpy(), sums[names].to_numpy(np.float32)
            flat = values[at < 0].ravel()[: cuts[-1]]
            tree = np.zeros(shapes[5], np.float32)
            tree[at[at >= 0]] = values[at >= 0]
            net = [p.reshape(s) for p, s in zip(np.split(flat, cuts[:-1]), shapes)] + [tree]
    return net


def log_probabilities(texts: list[str | None], net: list[np.ndarray], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log probability of each word given its window) of each text."""
    ids = [buckets(t) for t in texts]
    count = np.array([len(i) for i in ids], np.int64)
    total = np.zeros(len(ids))
    if not count.sum():
        return count, total
    rows, place = _windows(ids, vocab)
    word = np.concatenate(ids)
    cls = vocab.cls[word]
    logp = np.empty(len(word), np.float32)
    for a in range(0, len(word), BLOCK):
        p = place[a : a + BLOCK]
        _, hidden, out = _logits(net, rows[p[:, None] + _AROUND])
        out -= out.max(axis=1, keepdims=True)
        own = out[np.arange(len(p)), cls[a : a + BLOCK]]
        logp[a : a + BLOCK] = own - np.log(np.exp(out).sum(axis=1))
        order = np.argsort(vocab.place[word[a : a + BLOCK]])  # near places lie together
        whose, _, _, odds = _turns(net[5], vocab, _read(hidden)[order], word[a : a + BLOCK][order])
        logp[a + order] -= np.bincount(whose, weights=np.log1p(np.exp(-np.maximum(odds, -80))), minlength=len(p))
    np.add.at(total, np.repeat(np.arange(len(ids)), count), logp)
    return count, total


def score(docs: DataFrame, text: str = "text", model: tuple[list[np.ndarray], Vocabulary] | None = None) -> DataFrame:
    """Adds ``n_words``, ``log_prob`` (summed over all words) and ``mean_log_prob``.

    Word counts come from all documents and every document trains the network, so what is
    gathered grows with the corpus. Defined cases: null texts and texts without words have
    0 words, log probability 0 and a null mean; repeated rows score alike; the three columns
    are replaced; an empty table gives an empty result.
    """
    if model is None:
        vocab = Vocabulary.of(word_counts(docs, text))
        model = train(docs, vocab, text), vocab
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size, at most 17 MB

    @F.pandas_udf("struct<n:bigint,p:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, vocab = sent.value
        for texts in gathered(batches, 2 << 20):
            n, p = log_probabilities(texts, net, vocab)
            yield pd.DataFrame({"n": n, "p": p})

    rest = docs.drop(*[c for c in ("n_words", "log_prob", "mean_log_prob", "_s") if c != text])
    return bounded(rest).withColumn("_s", run(F.col(text))).withColumns({
        "n_words": F.col("_s.n"), "log_prob": F.col("_s.p"),
        "mean_log_prob": F.when(F.col("_s.n") > 0, F.col("_s.p") / F.col("_s.n")),
    }).drop("_s")
