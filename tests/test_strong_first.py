"""Routes that try the strongest rows before all others, against the same routes over every row."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recollect.operators import search


def first_k(scores, k, order=lambda p: (-p[1], p[0])):
    return [(i, r + 1, s) for r, (i, s) in enumerate(sorted(scores.items(), key=order)[:k])]


def got(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["atom_id"], r["rank"], r["score"]))
    return dict(out)


def graph(spark, seed, tied=False):
    rnd = random.Random(seed)
    atoms = [(i, f"u{i % 3}", f"text {i}", 0.5 if tied else rnd.choice([None] + [j / 20 for j in range(20)]), rnd.choice(["active"] * 4 + ["dormant"])) for i in range(150)]
    links = [(rnd.randrange(150), rnd.randrange(1, 90), 0.5 if tied else rnd.choice([None] + [j / 20 for j in range(20)])) for _ in range(400)]
    names = ["hot", "warm", "rare", "hotter"]
    mentions = [("entity:hot", d) for d in range(-1, 90)] + [("entity:warm", d) for d in range(1, 90, 4)] * 2 + [("entity:rare", 7), ("entity:other", 5)]
    vectors = {n: [rnd.gauss(0, 1) for _ in range(4)] for n in names}
    asked = [(1, "hot stuff"), (2, "rare"), (3, "warm rare"), (4, "nothing")]
    qv = {q: [rnd.gauss(0, 1) for _ in range(4)] for q, _ in asked}
    frames = dict(
        atoms=spark.createDataFrame(atoms, "atom_id bigint, user_id string, content string, importance double, status string"),
        links=spark.createDataFrame(links, "atom_id bigint, diary_id bigint, importance double"),
        nodes=spark.createDataFrame([(f"entity:{n}", n, "entity", vectors[n]) for n in names], "node_id string, name string, type string, embedding array<double>"),
        mentions=spark.createDataFrame(mentions, "from_node string, diary_id bigint"))
    queries = spark.createDataFrame([(q, t, qv[q]) for q, t in asked], "query_id bigint, query string, embedding array<double>")
    return frames, queries, (atoms, links, names, mentions, vectors, asked, qv)


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5


@pytest.mark.parametrize("seed, share, tied", [(1, 1 / 3, False), (3, 1 / 16, True)])
def test_graph_routes_hold_every_best_atom(spark, monkeypatch, seed, share, tied):
    monkeypatch.setattr(search, "_STRONG", share, raising=False)
    frames, queries, (atoms, links, names, mentions, vectors, asked, qv) = graph(spark, seed, tied)
    live = {a: imp for a, _, _, imp, st in atoms if st == "active"}
    reached = defaultdict(dict)  # node: atom: best link
    for n, d in set(mentions):
        for a, dd, imp in links:
            if d > 0 and d == dd and a in live and (imp is not None or a not in reached[n]):
                reached[n][a] = max(reached[n].get(a) or 0.0, imp) if imp is not None else None
    terms = search.query_terms(queries)
    for k in (2, 30):
        want = {}
        for q, t in asked:
            best = defaultdict(lambda: -1.0)
            for n in names:
                if any(w in n or w in "entity:" + n for w in t.split()):
                    for a, imp in reached["entity:" + n].items():
                        best[a] = max(best[a], -1.0 if imp is None else imp)
            if best:
                want[q] = [(a, r, None if s < 0 else s) for a, r, s in first_k(best, k)]
        assert got(search.graph_keyword_route(**frames, terms=terms, k=k)) == want
        route = got(search.graph_vector_route(**frames, queries=queries, k=k))
        for q, v in qv.items():
            best = {}
            for n in names:
                sim = round(cosine(vectors[n], v), 6)
                for a in reached["entity:" + n] if sim > 0 else ():
                    if live[a] is not None:
                        best[a] = max(best.get(a, -1.0), sim * live[a])
            found = [(a, s) for a, _, s in route.get(q, []) if s is not None]
            assert [a for a, _ in found] == [a for a, _, _ in first_k(best, k)]
            assert [s for _, s in found] == pytest.approx([s for _, _, s in first_k(best, k)], abs=2e-6)


def test_a_node_of_many_diaries_meets_few_links(spark, monkeypatch):
    """Of 400 atoms of one node about a sixteenth is added up and ranked."""
    seen = []
    monkeypatch.setattr(search, "top_n", lambda df, *a, was=search.top_n, **kw: seen.append(df.count()) or was(df, *a, **kw))
    atoms = spark.createDataFrame([(i, i / 400, "active") for i in range(1, 401)], "atom_id bigint, importance double, status string")
    links = atoms.select("atom_id", F.col("atom_id").alias("diary_id"), "importance")
    nodes = spark.createDataFrame([("entity:hot", "hot", "entity")], "node_id string, name string, type string")
    mentions = links.select(F.lit("entity:hot").alias("from_node"), "diary_id")
    terms = spark.createDataFrame([(1, "hot")], "query_id bigint, token string")
    out = got(search.graph_keyword_route(atoms, links, nodes, mentions, terms, 3))
    assert [a for a, _, _ in out[1]] == [400, 399, 398]
    assert max(seen) < 100


def test_graph_routes_read_the_mentions_once(spark):
    frames, queries, _ = graph(spark, 4)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    n = frames["mentions"].count()
    frames["mentions"] = frames["mentions"].mapInPandas(count, frames["mentions"].schema)
    frames["atoms"] = frames["atoms"].withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5), F.col("atom_id") / 100))
    search.multi_route(**frames, terms=search.query_terms(queries), query_vectors=queries.select("query_id", "embedding"), k=3).collect()
    assert read.value == n


@pytest.mark.parametrize("seed", [1, 2])
def test_keyword_route_scores_every_atom_that_can_win(spark, monkeypatch, seed):
    seen = []
    monkeypatch.setattr(search, "top_n", lambda df, *a, was=search.top_n, **kw: seen.append(df.count()) or was(df, *a, **kw))
    rnd = random.Random(seed)
    words = ["héllo", "wörld", "über", "alpha", "beta", "x", "Öl", "hé", "plain"]
    rows = [(i, f"u{i % 2}", " ".join(rnd.choices(words, k=rnd.randrange(1, 4))), rnd.choice([None, -0.2] + [j / 100 for j in range(100)] * 2), "active") for i in range(300)]
    atoms = spark.createDataFrame(rows, "atom_id bigint, user_id string, content string, importance double, status string")
    queries = {1: ["hé", "alpha", "ö"], 2: ["wörld", "über", "beta"], 3: ["alpha"], 4: ["bér"], 5: ["ber"]}
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id bigint, token string")
    for k in (3, 40):
        seen.clear()
        out = got(search.keyword_route(atoms, terms, k))
        for q, ts in queries.items():
            score = {}
            for a, _, text, imp, _ in rows:
                fts = any(t.isascii() and t in text.lower().split() for t in ts if len(t) > 1)
                like = sum(t in "".join(c.lower() if c.isascii() else c for c in text) for t in ts if not t.isascii() and len(t) > 1)
                if imp is not None and (fts or like):
                    score[a] = (round(imp * 0.7 + min((imp if fts else 0.0) + 0.3 * like, 1.0) * 0.3, 6), imp)
            want = sorted(score.items(), key=lambda p: (-p[1][0], -p[1][1], p[0]))[:k]
            assert [(a, s) for a, _, s in out.get(q, []) if s is not None] == [(a, s[0]) for a, s in want]
        assert k > 3 or seen[-1] < 200
    mine = spark.createDataFrame([(1, "u1"), (2, "u0")], "query_id bigint, user_id string")
    own = got(search.keyword_route(atoms, terms, 3, query_users=mine))
    assert {q: {a % 2 for a, _, _ in r} for q, r in own.items()} == {1: {1}, 2: {0}}
