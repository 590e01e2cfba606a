"""Searches that end early against the same search over every match."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import search
from recollect.operators.skew import ranked_in_slices, top_n


def store(spark, seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(15)] + ["héllo", "wörld", "common"]
    rows = [(i, f"u{i % 3}", " ".join(["common"] * (i % 2) + rnd.choices(words, k=rnd.randrange(1, 12))), rnd.randrange(5) / 10,
             rnd.choice(["active", "active", "active", "dormant"])) for i in range(n)]
    atoms = spark.createDataFrame(rows, "atom_id bigint, user_id string, content string, importance double, status string")
    queries = spark.createDataFrame([(q, f"u{q % 3}", " ".join(["common"] * (q % 2) + rnd.sample(words, 4))) for q in range(8)] + [(99, "u0", "nowhere")],
                                    "query_id bigint, user_id string, query string")
    return atoms, queries


def every_match(atoms, terms, k, users=None):
    hits = search.bm25_scores(atoms, terms, "atom_id", "content").join(
        atoms.filter("status = 'active'").select("atom_id", "user_id", "importance"), "atom_id")
    if users is not None:
        hits = hits.join(users, ["query_id", "user_id"], "left_semi")
    hits = hits.withColumn("score", F.round(F.col("importance") * 0.6, 6))
    return top_n(hits, ["query_id"], [F.desc("score"), F.desc("bm25"), F.asc("atom_id")], k).select("query_id", "atom_id", "rank", "score", "bm25")


@pytest.mark.parametrize("seed", [1, 2])
def test_heads_of_tokens_hold_the_best(spark, tmp_path, seed):
    atoms, queries = store(spark, seed)
    terms = search.query_terms(queries)
    users = queries.select("query_id", "user_id")
    search.write_index(atoms, str(tmp_path / "index"))
    kept = search.read_index(spark, str(tmp_path / "index"))
    for k in (1, 4, 30):
        want = sorted(map(tuple, every_match(atoms, terms, k).collect()))
        assert sorted(map(tuple, search.bm25_atoms(atoms, terms, k).collect())) == want
        assert sorted(map(tuple, search.bm25_atoms(atoms, terms, k, **kept).collect())) == want
        mine = sorted(map(tuple, search.bm25_atoms(atoms, terms, k, query_users=users).collect()))
        assert mine == sorted(map(tuple, every_match(atoms, terms, k, users).collect()))


def test_heads_are_few(spark):
    """A token that every atom has meets queries with k atoms and what ties with the last."""
    atoms, _ = store(spark, 3, 300)
    owned = atoms.select("atom_id", "user_id", F.col("atom_id").cast("double").alias("score"))
    post = atoms.select(F.lit("common").alias("token"), "atom_id")
    assert search._token_heads(post, owned, 7, False).count() == 7
    tied = owned.withColumn("score", F.floor(F.col("score") / 10))
    assert search._token_heads(post, tied, 7, False).count() == 10
    assert search._token_heads(post, owned, 7, True).count() == 21


def test_ranks_in_slices(spark):
    rnd = random.Random(4)
    rows = [(i, f"q{i % 2}", -rnd.randrange(20_000_000)) for i in range(400)] + [(1000 + i, "q0", -5) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, q string, by bigint")
    got = {(r["q"], r["id"]): r["rank"] for r in ranked_in_slices(df, "q", "by", ["id"], width=1_000).collect()}
    for q in ("q0", "q1"):
        order = sorted((b, i) for i, k, b in rows if k == q)
        assert [got[q, i] for _, i in order] == list(range(1, len(order) + 1))


def test_prefix_search_keeps_no_postings_of_all_texts(spark, monkeypatch):
    """Only terms and the diaries that hold a query's rarest term are kept, however long the texts are."""
    kept = []
    real = search.cut_lineage

    def counted(df):
        out = real(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(search, "cut_lineage", counted)
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(50)) + (" needle stack" if i == 3 else " stack"), 0.5) for i in range(20)]
    diaries = spark.createDataFrame(texts, "diary_id bigint, content string, importance double")
    queries = spark.createDataFrame([(1, "need sta")], "query_id bigint, query string")
    assert [(r["query_id"], r["diary_id"]) for r in search.diary_prefix(diaries, queries).collect()] == [(1, 3)]
    assert max(kept) <= 2
