from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from recollect.llm import packing
from tests.llm.helpers import odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def fill(lengths, capacity):
    """Most that one bin can hold of these items, by trying all subsets."""
    return max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= capacity)


def test_each_bin_has_the_least_slack():
    rng = random.Random(1)
    for _ in range(40):
        items = [rng.randrange(1, 30) for _ in range(9)]
        left = sorted(items)
        for times, used in packing.bin_slack_plan({n: items.count(n) for n in items}, 40):
            for _ in range(times):
                big = left.pop()
                assert sum(n * k for n, k in used) == big + fill(left, 40 - big)
                rest = [n for n, k in used for _ in range(k)]
                rest.remove(big)
                for n in rest:
                    left.remove(n)
        assert not left


def test_packing_is_whole_and_gapless(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, 0, 0, 20 if i % 3 == 0 else rng.randrange(1, 101), i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").withColumn("offset", F.lit("x"))
    got = packing.pack(df, 100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 100
    first_fit: list[int] = []
    for n in sorted((r[3] for r in rows), reverse=True):
        k = next((k for k, room in enumerate(first_fit) if room >= n), None)
        if k is None:
            first_fit.append(100 - n)
        else:
            first_fit[k] -= n
    assert len(bins) <= len(first_fit)


def test_ids_are_the_tokenizers_own(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ["Hello, WORLD!  don't\n\n\tstop 123 é É ΣΑΣ İ <|endoftext|> x<|startoftext|>y", "\u3000wide\u00a0 e \u0301x\x1fy \u2028z", "", None, "a" * 300 + " b" * 5000, " \n ", "It's\r\nI'LL we're", "x² ½ Ⅷ ①a ª́ ǅ ß ẞ", "A_b__c --- ###a### $1,234.56 a\u0301b \u0301", "\u0e01\u0e33 กำ ١٢ मराठी नि한국어 ｱ"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    got = packing.token_pieces(df, PATH).collect()
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, k * 4096, min(4096, len(ids) - k * 4096), zlib.crc32(ids[k * 4096 : (k + 1) * 4096].tobytes())) for k in range(-(-len(ids) // 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i) == want


def test_random_words_are_the_tokenizers_own(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "WORDS", 150)
    monkeypatch.setattr(packing, "TABLE_BITS", 12)
    rng, whole, mine = random.Random(3), Tokenizer.from_file(PATH), packing._WordIds(PATH)
    alphabet = "abcXYZéÉß²½_-.,'<|>#09 \n\t\u00a0\u0301\u0130\u03a3日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    for a in range(0, 3000, 100):
        for t, ids in zip(texts[a : a + 100], mine.encode(texts[a : a + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumns({"piece": F.lit("x"), "length": F.lit("x"), "sequence_id": F.lit("x")})
    cut = packing.token_pieces(docs, PATH)
    got = packing.pack(cut).collect()
    assert len(got) == cut.count()
    assert sum(r["length"] for r in got if r["doc_id"] == 6) == 30_001
    assert packing.pack(packing.token_pieces(docs.limit(0), PATH)).count() == 0
