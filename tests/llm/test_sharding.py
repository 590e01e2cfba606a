from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from recollect.llm import sharding
from tests.llm.helpers import odd_docs


def test_counts_and_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 == 0 else rng.choice("abcde")) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = sharding.stratified_shards(df, 7).collect()
    size = Counter(r["shard"] for r in got)
    assert max(size.values()) - min(size.values()) <= 1 and len(size) == 7
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(size[s]))
    for src, n in Counter(r[1] for r in rows).items():
        each = Counter(r["shard"] for r in got if r["source"] == src)
        assert all(abs(each[s] - n / 7) <= 2 for s in range(7))


def test_slices_do_not_change_the_order(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    want = sorted(map(tuple, sharding.stratified_shards(df, 4).collect()))
    monkeypatch.setattr(sharding, "LEAST_SLICES", 3)
    assert sorted(map(tuple, sharding.stratified_shards(df, 4).collect())) == want


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumns({"shard": F.lit(9), "slot": F.lit(9), "_h": F.lit(1)}).drop("_h")
    got = sharding.stratified_shards(docs, 3)
    assert sorted(got.columns) == sorted(docs.columns)
    rows = got.collect()
    assert len(rows) == 10 and sorted(Counter(r["shard"] for r in rows).values()) == [3, 3, 4]
    assert sharding.stratified_shards(docs.limit(0), 3).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id bigint, source string")
    assert [tuple(r[c] for c in ("shard", "slot")) for r in sharding.stratified_shards(one, 3).collect()] == [(0, 0)]
