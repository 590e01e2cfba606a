from __future__ import annotations

import math
import random

import numpy as np

from recollect.llm import pseudolm as lm
from tests.llm.helpers import clashing, odd_docs


def test_scores_match_a_plain_sum():
    texts = ["the cat sat on the mat", "A b", "", None, "one"]
    counts = np.bincount(np.concatenate([lm.buckets(t) for t in texts]), minlength=lm.BUCKETS)
    vocab, net = lm.Vocabulary.of(counts), lm.start(3)
    edge = lm.ROWS + lm.BANDS
    n, total = lm.log_probabilities(texts, net, vocab)
    for k, t in enumerate(texts):
        ids = lm.buckets(t)
        want = 0.0
        for i, b in enumerate(ids):
            near = [vocab.row[ids[i + d]] if 0 <= i + d < len(ids) else edge for d in (-2, -1, 1, 2)]
            hidden = np.tanh(np.concatenate([net[0][r] for r in near]) @ net[1] + net[2])
            out = hidden @ net[3] + net[4]
            peers = np.flatnonzero(vocab.cls == vocab.cls[b])
            want += out[vocab.cls[b]] - math.log(np.exp(out.astype(float)).sum())
            want += math.log((counts[b] + 0.5) / (counts[peers] + 0.5).sum())
        assert n[k] == len(ids) and abs(total[k] - want) < 1e-3


def corpus(spark, n=400):
    """Sentences of one order of words, so that both sides tell the word."""
    rng = random.Random(1)
    rows = []
    for k in range(n):
        rows.append((k, " ".join(f"s{a} v{a} o{a} end" for a in (rng.randrange(6) for _ in range(40)))))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_training_beats_an_untrained_network_and_word_order_counts(spark):
    docs = corpus(spark)
    vocab = lm.Vocabulary.of(lm.word_counts(docs))
    net = lm.train(docs, vocab, rounds=6)
    fresh = [r["text"] for r in docs.limit(5).collect()]
    mixed = [" ".join(random.Random(k).sample(t.split(), len(t.split()))) for k, t in enumerate(fresh)]
    good = lm.log_probabilities(fresh, net, vocab)[1].sum()
    assert good > lm.log_probabilities(fresh, lm.start(), vocab)[1].sum()
    assert good > lm.log_probabilities(mixed, net, vocab)[1].sum()


def test_counts_cover_all_documents(spark):
    docs = corpus(spark, 50)
    counts = lm.word_counts(docs)
    assert counts.sum() == 50 * 160
    assert counts[lm.buckets("END")[0]] == 50 * 40


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), ["n_words", "log_prob", "mean_log_prob"])
    got = lm.score(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    for k in (2, 3, 4):
        assert (by[k]["n_words"], by[k]["log_prob"], by[k]["mean_log_prob"]) == (0, 0.0, None)
    assert by[6]["n_words"] == 30_000 and by[6]["log_prob"] < 0
    same = [r["log_prob"] for r in got if r["doc_id"] == 1]
    assert abs(same[0] - same[1]) < 1e-6
    assert lm.score(docs.limit(0)).count() == 0


def test_words_of_every_place_train_in_one_round(spark):
    """Texts of a period of 4 words and a length of 160: each of the four slots is learned, with the query's rounds."""
    docs = corpus(spark)
    vocab = lm.Vocabulary.of(lm.word_counts(docs))
    net, fresh = lm.train(docs, vocab), lm.start()
    ids = [lm.buckets(r["text"]) for r in docs.limit(20).collect()]
    rows, place = lm._windows(ids, vocab)
    target = vocab.cls[np.concatenate(ids)]
    for slot in range(4):
        loss = []
        for n in (net, fresh):
            out = lm._logits(n, rows[place[slot::4][:, None] + lm._AROUND])[2].astype(float)
            own = out[np.arange(len(out)), target[slot::4]]
            loss.append((np.log(np.exp(out).sum(axis=1)) - own).mean())
        assert loss[0] < loss[1] - 0.5, (slot, loss)


def test_words_of_one_class_are_told_by_their_window(spark):
    """a rare word is predicted by its neighbours, not by a fixed share of its class; shares add up to 1."""
    rng = random.Random(3)
    rare = [f"r{k}" for k in range(40)]  # equally frequent, less than the 32 words around them
    rows = []
    for d in range(600):
        words = []
        for _ in range(40):
            k = rng.randrange(40)
            words += [f"left{k % 2}", rare[k], f"right{k % 2}", f"f{rng.randrange(28)}"]
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    vocab = lm.Vocabulary.of(lm.word_counts(docs))
    ids = np.array([lm.buckets(r)[0] for r in rare])
    mates = [(a, b) for i, a in enumerate(rare) for j, b in enumerate(rare) if i % 2 == 0 and j % 2 == 1 and vocab.cls[ids[i]] == vocab.cls[ids[j]]]
    assert mates
    net = lm.train(docs, vocab)
    fits = lm.log_probabilities([f"left0 {a} right0" for a, _ in mates], net, vocab)[1]
    not_ = lm.log_probabilities([f"left0 {b} right0" for _, b in mates], net, vocab)[1]
    assert (fits - not_).mean() > 0.3
    # given its class, the ways to all words of the class are a distribution, trained or not
    hidden = np.full((1, lm.HIDDEN), 0.5, np.float32)
    for c in set(vocab.cls[ids]):
        words = np.flatnonzero(vocab.cls == c)
        for tree in (net[5], np.zeros_like(net[5])):
            whose, _, _, odds = lm._turns(tree, vocab, np.repeat(lm._read(hidden), len(words), 0), words)
            logp = -np.bincount(whose, weights=np.logaddexp(0, -odds.astype(float)), minlength=len(words))
            assert abs(np.exp(logp).sum() - 1) < 1e-3
    assert np.allclose(logp, vocab.inside[words], atol=1e-3)


def test_steps_of_the_trees_follow_the_gradient():
    counts = np.bincount(np.arange(200), weights=np.arange(200)[::-1] + 1, minlength=lm.BUCKETS)
    vocab, rng = lm.Vocabulary.of(counts), np.random.default_rng(1)
    words, seen = rng.integers(40, 200, 50), lm._read(rng.normal(size=(50, lm.HIDDEN)).astype(np.float32))
    tree = (rng.normal(size=(lm.BUCKETS, lm.WIDE)) * 0.1).astype(np.float32)
    loss = lambda t: np.logaddexp(0, -lm._turns(t, vocab, seen, words)[3].astype(float)).sum()
    cut = int(vocab.steps(words)[1][3])
    after, square, met = tree.copy(), np.full(lm.BUCKETS, 1e12, np.float32), np.zeros(lm.BUCKETS, np.int64)
    lm._learn_ways(after, square, met, vocab, seen, words, 1e6)  # so large a start leaves the bare gradient
    for k in range(lm.WIDE):
        up, down = tree.copy(), tree.copy()
        up[cut, k] += 1e-2
        down[cut, k] -= 1e-2
        assert abs((tree - after)[cut, k] - (loss(up) - loss(down)) / 2e-2) < 1e-2
    assert met.sum() == len(vocab.steps(words)[0])
