"""Steps whose tasks, shuffles and results may not grow with one key, with the blocks or with the partitions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from recollect import session
from recollect.operators import dedup, graph, search, similarity


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df) -> list[str]:
    """Keys of the shuffles of a plan, ids left out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)]


def test_first_rows_are_cut_by_the_executors(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(session, "cut_lineage", lambda df, was=session.cut_lineage: asked.append(1) or was(df))
    df = spark.range(1000, numPartitions=8).orderBy(F.desc("id")).limit(5)
    assert [r[0] for r in session.first_rows(df)] == [999, 998, 997, 996, 995] and asked


def test_plain_blocks_grow_with_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_VISITS", -1)
    monkeypatch.setattr(similarity, "_PLAIN_BLOCK", 5)
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(400)], "id bigint, embedding array<double>")
    sent = similarity._dealt(df, 0.8).applyInPandas(lambda pdf: pdf[["id"]].head(0).assign(n=0) if pdf.empty else pdf[["id"]].assign(n=1), "id bigint, n bigint")
    assert sent.count() <= 400 * 2 * similarity._PLAIN_BLOCKS


def test_a_node_of_all_diaries_is_no_shuffle_key(spark, no_auto_broadcast):
    mentions = spark.createDataFrame([("a", d) for d in range(1, 50)] + [("b", 1), ("b", 1), ("c", 2), ("a", -1)], "from_node string, diary_id bigint")
    heads = spark.createDataFrame([("a",), ("b",)], "node_id string")
    told = search.linked_diaries(mentions, heads, ["node_id"])
    assert rows(told, "node_id", "diary_id") == sorted([("a", d) for d in range(1, 50)] + [("b", 1)], key=repr)
    assert exchanges(told).count("node_id") == 1  # the asked nodes, not the mentions


def test_a_frequent_token_of_the_index_is_dealt_over_tasks(spark, tmp_path):
    atoms = spark.createDataFrame([(i, f"always w{i}") for i in range(400)], "atom_id bigint, content string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    search.write_index(atoms, str(tmp_path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = spark.read.parquet(f"{tmp_path}/postings")
    hot = kept.filter("token = 'always'")
    assert hot.count() == 400 and kept.count() == 800
    assert hot.select(F.input_file_name()).distinct().count() > 1


def test_matches_of_a_row_are_added_up_where_its_postings_lie(spark, no_auto_broadcast):
    atoms = spark.createDataFrame([(i % 50, f"alpha w{i % 7} w{i % 3}") for i in range(60)], "atom_id bigint, content string")
    terms = spark.createDataFrame([(q, t) for q in range(3) for t in ("alpha", f"w{q}", "none")], "query_id bigint, token string")
    scores = search.bm25_scores(atoms, terms, "atom_id", "content")
    assert not [k for k in exchanges(scores) if "query_id" in k and "atom_id" in k]
    index = {"index": search.postings(atoms, "atom_id", "content"), "stats": search.corpus_stats(atoms, "content")}
    cols = ("query_id", "atom_id", "bm25")
    assert rows(scores, *cols) == rows(search.bm25_scores(atoms, terms, "atom_id", "content", **index), *cols)
    one = scores.filter("query_id = 0").count()
    assert one == 50  # every row holds the common token


def test_many_fillers_are_numbered_like_few(spark, monkeypatch):
    rnd = random.Random(6)
    atoms = spark.createDataFrame([(i, rnd.choice([None, 0.1, 0.2, 0.3]), rnd.choice(["active", "active", "dormant"])) for i in range(60)],
                                  "atom_id bigint, importance double, status string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    ranked = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (3, 59, 1)], "query_id bigint, atom_id bigint, rank int")
    for k in (20, 100):
        monkeypatch.setattr(search, "_FILLERS", 1 << 30)
        few = search.backfill(ranked, atoms, queries, k)
        want = rows(few, "query_id", "atom_id", "rank")
        monkeypatch.setattr(search, "_FILLERS", 0)
        many = search.backfill(ranked, atoms, queries, k)
        assert rows(many, "query_id", "atom_id", "rank") == want and many.schema == few.schema


def test_all_candidates_are_filled_in_and_ranked(spark, monkeypatch):
    """without a number every active atom is a candidate, and the whole ranking can be had."""
    atoms = spark.createDataFrame([(i, (i * 7 % 50) / 50, "active" if i % 5 else "dormant", f"u{i % 3}") for i in range(60)],
                                  "atom_id bigint, importance double, status string, user_id string")
    queries = spark.createDataFrame([(1, "u0"), (2, "u1"), (None, "u2")], "query_id bigint, user_id string")
    ranked = spark.createDataFrame([(1, 6, 1), (2, 7, 1)], "query_id bigint, atom_id bigint, rank int")
    filled = search.backfill(ranked, atoms, queries, None)
    assert rows(filled, "query_id", "atom_id", "rank") == rows(search.backfill(ranked, atoms, queries, 1000), "query_id", "atom_id", "rank")
    assert filled.groupBy("query_id").count().select("count").distinct().collect() == [(48,)]
    edges = spark.createDataFrame([("u0", "u1", "friend_of", 0.5)], "from_user string, to_user string, relation_type string, weight double")
    whole, cut = search.social_rerank(filled, atoms, queries, edges, None), search.social_rerank(filled, atoms, queries, edges, 1000)
    cols = ("query_id", "atom_id", "rank", "score")
    # rows of a null query meet no query, whatever the number
    assert whole.count() == 96 and rows(whole, *cols) == rows(cut, *cols)


def test_ties_meet_ranked_rows_without_a_shuffle_by_user(spark, no_auto_broadcast):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 20)], "query_id bigint, atom_id bigint, rank int")
    atoms = spark.createDataFrame([(i, f"u{i % 3}") for i in range(1, 20)], "atom_id bigint, user_id string")
    queries = spark.createDataFrame([(1, "u0")], "query_id bigint, user_id string")
    edges = spark.createDataFrame([("u0", "u1", "friend_of", 0.5)], "from_user string, to_user string, relation_type string, weight double")
    out = search.social_rerank(ranked, atoms, queries, edges, 3)
    assert "uid, owner" not in exchanges(out)
    assert [tuple(r) for r in out.orderBy("rank").select("atom_id", "score").collect()] == [(3, 1.155556), (1, 1.15), (4, 0.958333)]


def test_neighbors_count_an_edge_between_two_asked_nodes_once(spark, no_auto_broadcast):
    nodes = spark.createDataFrame([("entity:ab", "ab", "entity"), ("entity:abc", "abc", "entity"), ("entity:x", "x", "entity")], "node_id string, name string, type string")
    e = [("entity:ab", "entity:abc", "r", 1.0, "active")] * 2 + [("entity:x", "entity:ab", "r", 2.0, "active"), ("entity:x", "entity:x", "r", 3.0, "active")]
    edges = spark.createDataFrame(e, "from_node string, to_node string, relation_type string, weight double, status string")
    names = spark.createDataFrame([(1, "ab"), (2, "x"), (None, "ab")], "query_id bigint, name string")
    kept = graph.neighbors(nodes, edges, names)[1]
    assert rows(kept, "query_id", "weight") == sorted([(1, 1.0), (1, 2.0), (2, 2.0), (2, 3.0), (None, 1.0), (None, 2.0)], key=repr)
    assert "from_node" not in exchanges(kept) and "to_node" not in exchanges(kept)


def test_similar_pairs_are_not_shuffled_for_their_user(spark, no_auto_broadcast):
    atoms = spark.createDataFrame(
        [(1, "u", "one two three", [1.0, 0.1], "active"), (2, "u", "one two four", [1.0, 0.2], "active"), (3, "v", "one two three", [1.0, 0.1], "active"),
         (4, "u", "one two three", [1.0, 0.1], "active"), (5, "u", "nine ten", [1.0, 0.1], "active")],
        "atom_id bigint, user_id string, content string, embedding array<double>, status string").withColumn("importance", F.lit(0.5))
    out = dedup.similar_pairs(atoms, 0.5, 0.3)
    assert rows(out, "user_id", "l_id", "r_id") == [("u", 1, 2)]
    assert "l_id" not in exchanges(out)
    assert dict(dedup._copy_groups(atoms, dedup.text.words, hashed=True).dtypes)["tokens"] == "array<bigint>"
