from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from recollect.llm import langid
from tests.llm.helpers import clashing, odd_docs

SYLLABLES = {"de": "sch ung ein keit über ver".split(), "fr": "eau oui tion é è ment".split(), "en": "the ing wh ea th ed".split()}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    h, steps, n = 3, 5, 4
    table, rec = rng.normal(0, 0.5, (256, 3 * h)), rng.normal(0, 0.5, (h, 3 * h))
    x = rng.integers(0, 256, (steps, n)).astype(np.uint8)
    aim = rng.normal(size=(steps, n, h))

    def loss(t, r):
        return float((langid._forward(t, r, x).astype(np.float64) * aim).sum())

    keep = []
    langid._forward(table, rec, x, keep)
    d_table, d_rec = langid._backward(table, rec, x, keep, aim)
    for a, d in ((table, d_table), (rec, d_rec)):
        for _ in range(8):
            i = (int(x[rng.integers(steps), rng.integers(n)]) if a is table else int(rng.integers(h)), int(rng.integers(3 * h)))
            old, eps = a[i], 1e-3
            a[i] = old + eps
            up = loss(table, rec)
            a[i] = old - eps
            down = loss(table, rec)
            a[i] = old
            assert abs((up - down) / (2 * eps) - d[i]) < 2e-2


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, text(rng, lang), lang) for k, lang in enumerate(list(SYLLABLES) * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.train(*langid.training_sample(docs.where("doc_id % 4 <> 2")), steps=150)
    got = langid.label(docs.where("doc_id % 4 = 2"), net).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = langid.label(clashing(odd_docs(spark), ["lang_pred", "score"]), net).collect()
    und = {r["doc_id"] for r in odd if r["lang_pred"] == "und"}
    assert und == {2, 3, 4, 5} and all(r["score"] == 0.0 for r in odd if r["lang_pred"] == "und")
    assert len({(r["lang_pred"], r["score"]) for r in odd if r["doc_id"] == 1}) == 1
    assert langid.label(docs.limit(0), net).count() == 0


def test_blocks_do_not_change_a_result(monkeypatch):
    rng = random.Random(6)
    net = langid.train([text(rng, l) for l in SYLLABLES], list(SYLLABLES), steps=5)
    texts = [text(rng, "de", n) for n in (1, 30, 300)] + ["", "ü"]
    want = langid.predict(net, texts)
    monkeypatch.setattr(langid, "BLOCK", 3)
    assert np.allclose(langid.predict(net, texts), want, atol=1e-5)


def test_nothing_to_learn_from(spark):
    docs = odd_docs(spark)
    got = langid.identify(docs, docs.where(F.lit(False))).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    got = langid.identify(docs, docs.where("lang = 'de'")).collect()
    assert {r["lang_pred"] for r in got} == {"de", "und"}


def test_prediction_against_a_plain_forward_pass():
    """Position by position in plain Python, both ways, stretch by stretch."""
    import math

    rng = np.random.default_rng(4)
    h, langs = 4, ["a", "b", "c"]
    net = langid.Network(
        langs, [(rng.normal(0, 0.5, (256, 3 * h)).astype(np.float32), rng.normal(0, 0.5, (h, 3 * h)).astype(np.float32)) for _ in range(2)],
        rng.normal(0, 0.5, (2 * h, 3)).astype(np.float32), rng.normal(0, 0.5, 3).astype(np.float32))

    def states(table, rec, data):
        state, out = [0.0] * h, []
        for x in data:
            u = [sum(state[i] * float(rec[i][j]) for i in range(h)) for j in range(3 * h)]
            sig = lambda v: 1 / (1 + math.exp(-v))
            r = [sig(float(table[x][j]) + u[j]) for j in range(h)]
            z = [sig(float(table[x][h + j]) + u[h + j]) for j in range(h)]
            new = [math.tanh(float(table[x][2 * h + j]) + r[j] * u[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
            out.append(state)
        return out

    texts = ["plain words", "ß漢字 " * 30, "x" * 64, "y" * 65]
    got = langid.predict(net, texts)
    for k, t in enumerate(texts):
        data, total = t.encode(), [0.0] * 3
        for a in range(0, len(data), langid.STEPS):
            part = data[a : a + langid.STEPS].ljust(langid.STEPS, b"\0")
            forth, back = states(*net.dirs[0], part), states(*net.dirs[1], part[::-1])[::-1]
            for i, x in enumerate(part):
                if x:
                    both = forth[i] + back[i]
                    logit = [sum(both[j] * float(net.out[j][c]) for j in range(2 * h)) + float(net.bias[c]) for c in range(3)]
                    e = [math.exp(v) for v in logit]
                    total = [s + v / sum(e) for s, v in zip(total, e)]
        assert np.allclose(got[k], np.array(total) / sum(total), atol=1e-4)


def test_sample_of_a_language_that_most_rows_have(spark):
    rows = [(i, f"text number {i} of many words", "en") for i in range(4_000)] + [(5_000 + i, f"und noch {i}", "de") for i in range(30)]
    rows += [(9_000, "same", "fr")] * 50 + [(None, "no number", "fr"), (9_001, None, "fr"), (9_002, "123", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts, langs = langid.training_sample(docs, per_lang=100)
    assert {x: langs.count(x) for x in set(langs)} == {"en": 200, "de": 60, "fr": 4}
    assert langid.training_sample(docs, per_lang=100) == (texts, langs)
    assert langid.training_sample(docs.limit(0)) == ([], [])
