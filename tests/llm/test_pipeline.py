from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, odd_docs
from tests.llm.test_langid import SYLLABLES
from tests.llm.test_simhash import jaccard

import __spark_entry__


def text(rng, lang):
    line = lambda: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(15)) + "."
    return "\n".join(line() for _ in range(8))


def test_stages_drop_what_they_should(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, text(rng, lang), lang, "s", 0) for k, lang in enumerate(list(SYLLABLES) * 30)]
    first = rows[0][1]
    words = first.split(" ")
    words[40] = "changed"
    assert jaccard(first, " ".join(words)) >= 0.8
    rows += [(200, first, "de", "s", 0), (201, " ".join(words), "de", "s", 0), (202, "1234 " * 80, "de", "s", 0), (203, "kurz.", "de", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
        if k < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert 202 not in ids and {200, 201, 203} <= ids
        if name == "quality_rules":
            assert ids == {*range(90), 200, 201}
        if name in ("near_duplicates", "sequences"):
            assert ids == set(range(90))


def test_stages_take_odd_rows_clashing_columns_and_empty_tables(spark, tmp_path):
    for n, start in enumerate((odd_docs(spark).withColumns({"score": F.lit(1), "kept": F.lit("x"), "cleaned": F.lit(2), "_root": F.lit(3)}), odd_docs(spark).limit(0))):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "sequences":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{n}_{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}_{name}")


def test_registered(spark):
    names = __spark_entry__.queries()
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= set(names)
    assert sum(n.startswith("op") for n in names) == 13
