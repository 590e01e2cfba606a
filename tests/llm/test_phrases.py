from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.llm import phrases
from tests.llm.helpers import ODD, clashing, odd_docs

UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
        yield re.findall(r"[^ \t]+", piece)


def model(docs, least, depth, top):
    """From the definition: rows (lang, rank, phrase, a, l, r, n, score)."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = [p for p, c in counts.items() if len(p) > 1 and c >= least]
        inside = {}
        for p in cands:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside.get(p[i : i + k], 0), counts[p])
        rows = []
        for p in cands:
            a = counts[p]
            if inside.get(p, 0) >= a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def result(docs, **kw):
    got = phrases.collocations(docs, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()))


def corpus(seed, rows=120, words=12):
    rng = random.Random(seed)
    vocabulary = ["Of", "the", "École", "漢", "it's", "x" * 80, "x" * 79 + "y", "a-b", " ", "q"][:words] + [f"w{i}" for i in range(words)]
    out = []
    for i in range(rows):
        text = []
        for _ in range(rng.randrange(40)):
            text += rng.choice([["New", "york", "CITY"], rng.choices(vocabulary, k=rng.randrange(1, 7))])
            text.append(rng.choice(["", "", "", ",", ". ", "\n", "\t", "!"]))
        out.append((rng.choice(["en", "de", None]), " ".join(text)))
    return out


@pytest.mark.parametrize("seed,budget", [(1, 1 << 19), (2, 50), (3, 5)])
def test_equals_the_definition(spark, monkeypatch, seed, budget):
    """One group, many groups, and prefixes taken apart to the full depth."""
    monkeypatch.setattr(phrases, "LEAST_BUDGET", 1)
    monkeypatch.setattr(phrases, "CLASSES", 8)
    monkeypatch.setattr(phrases, "FINER", 3)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    assert result(df, least=6, budget=budget) == model(docs, 6, 5, 2_000)
    assert result(df, least=20, depth=3, top=5, budget=budget) == model(docs, 20, 3, 5)


def test_windows_over_the_ends_of_chunks_and_segments(spark, monkeypatch):
    docs = corpus(4, 30)
    df = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(phrases, "CHUNK", 7)
    monkeypatch.setattr(phrases, "SEGMENT", 31)
    parts = [(lang, w, first) for lang, data in phrases._by_lang(iter([df.fillna("und").toPandas()])) for _, w, first in phrases._documents(iter([]))]
    assert parts == []
    text = " ".join(t for _, t in docs).encode()
    cut = [h for _, _, _, hs, _ in phrases.word_hashes(text) for h in hs.tolist()]
    first = [x for *_, f in phrases.word_hashes(text) for x in f.tolist()]
    monkeypatch.setattr(phrases, "SEGMENT", 1 << 20)
    assert cut == [h for _, _, _, hs, _ in phrases.word_hashes(text) for h in hs.tolist()]
    assert first == [x for *_, f in phrases.word_hashes(text) for x in f.tolist()]
    every = lambda h: h == h
    small = [r for b in phrases._suffixes(lambda: every, lambda: every, 5)(iter([df.fillna("und").toPandas()])) for r in b.itertuples(index=False)]
    monkeypatch.setattr(phrases, "CHUNK", 1 << 18)
    whole = [r for b in phrases._suffixes(lambda: every, lambda: every, 5)(iter([df.fillna("und").toPandas()])) for r in b.itertuples(index=False)]

    def added(rows):
        out = Counter()
        for lang, key, n in rows:
            out[lang, key] += n
        return out

    assert added(small) == added(whole)


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), ["key", "n", "phrase", "hash", "_group"])
    assert result(docs, least=2) == model([(r[2], r[1]) for r in ODD], 2, 5, 2_000)
    assert result(docs.where("false"), least=2) == []


def test_products_beyond_64_bits(spark):
    words = spark.createDataFrame([("en", 4_000_000_000_000)], "lang string, n bigint")
    big = F.lit(3_000_000_000_000).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    assert int(words.select(big.cast("decimal(38,0)")).first()[0]) == 12 * 10**24
