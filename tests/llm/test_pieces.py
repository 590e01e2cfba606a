from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from recollect.llm import pieces
from tests.llm.helpers import clashing, odd_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, texts):
    for t, got in zip(texts, pieces.model(PATH).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t), t
        assert pieces.model(PATH).decode(got) == t.replace("▁", " ")


def test_odd_texts_as_the_library(library):
    same(library, ["", " ", "  a", "a  b", "a   ,b", " " * 40 + "x", "a" + " " * 33, "\x00", "a\x00b", "日本語 テキスト", "👍🏽 ok",
                   "e\u0301 é", "▁x ▁ y", "a" * 27, "a\n\n\tb", " \n ", "\ufeffx", "{}();  // --", "=" * 60, "x" * 3000])


def test_random_texts_as_the_library(library, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(pieces, "INDEX_CHARS", 500)
    alphabet = "abcdeéß日 \n\t.,;'-_0123ABZ▁\u3000👍"
    same(library, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(800)])


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 300)
    order = pieces.suffix_order(text, 16)
    padded = np.concatenate([text, np.zeros(16, int)])
    tails = [tuple(padded[i : i + 16]) for i in order]
    assert sorted(order.tolist()) == list(range(300)) and tails == sorted(tails)


def test_odd_rows(spark, library):
    docs = clashing(odd_docs(spark), ["ids", "decoded"])
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    for r in got:
        text = r["text"] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode(text)
        assert r["decoded"] == text.replace("▁", " ")
    for r in pieces.encode(docs, PATH, decoded="decoded").collect():
        assert r["decoded"] == (r["text"] or "").replace("▁", " ") == pieces.model(PATH).decode(r["ids"])
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).count() == 0
