"""Operators against brute force and plain-Python models on small data."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.operators import capture, context, dedup, graph, lifecycle, messages, provenance, search, similarity, skew, social, users
from recollect.sources import archive, tables

NOW = "2024-02-01 00:00:00"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- skew helpers

def test_top_n_two_stages(spark):
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id"), (F.col("id") * 7 % 2000).alias("v"))
    got = skew.top_n(df, ["k"], [F.desc("v"), F.asc("id")], 150)
    assert rows(got, "rank", "v") == [(i + 1, 1999 - i) for i in range(150)]


def test_prefix_rank_over_slices(spark):
    df = spark.range(100).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), "id")
    got = {(r["k"], r["id"]): r["rank"] for r in skew.prefix_rank(df, "k", "id", width=7).collect()}
    for k, keep in (("a", lambda i: i % 3 == 0), ("b", lambda i: i % 3 != 0)):
        assert [got[(k, i)] for i in range(100) if keep(i)] == list(range(1, sum(map(keep, range(100))) + 1))


def test_with_new_ids(spark):
    stored = spark.createDataFrame([(7,)], "atom_id bigint")
    new = spark.range(50).select((F.col("id") * 13 % 50).alias("seq"))
    got = rows(tables.with_new_ids(new, stored, "atom_id", ("seq",)), "seq", "atom_id")
    assert got == [(i, 8 + i) for i in range(50)]


# ---------------------------------------------------------------- retrieval

def test_rrf(spark):
    lists = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id bigint, atom_id bigint, rank int")
    other = spark.createDataFrame([(1, 10, 1)], "query_id bigint, atom_id bigint, rank int")
    got = rows(search.rrf([lists, other], 5), "rank", "atom_id")
    assert got == [(1, 10), (2, 20)]
    assert rows(search.rrf([lists.filter("false"), other.filter("false")], 5), "atom_id") == []
    many = spark.range(10).select(F.lit(1).cast("bigint").alias("query_id"), F.col("id").alias("atom_id"), (F.col("id") + 1).cast("int").alias("rank"))
    assert len(rows(search.rrf([many], 3), "atom_id")) == 3


def test_vector_search(spark):
    a = spark.createDataFrame([(1, "u", [.1, .2, .3], "m", "active", .5), (2, "u", [.4, .5, .6], "m", "active", .5), (3, "u", [.7, .8, .9], "m", "active", .5), (4, "u", [0., 0., 0.], "m", "active", .5)],
                              "atom_id bigint, user_id string, embedding array<double>, embedding_model string, status string, importance double")
    q = lambda v: spark.createDataFrame([(1, v)], "query_id bigint, embedding array<double>")
    assert rows(search.vector_atoms(a, q([.71, .81, .89]), 3), "rank", "atom_id")[0] == (1, 3)
    assert rows(search.vector_atoms(a, q([1., 0., 0., 0.]), 3), "atom_id") == []
    assert rows(search.vector_atoms(a, q([1., 0., 0.]), 3, model="other"), "atom_id") == []


def test_containment_is_ascii_caseless(spark):
    t = spark.createDataFrame([(1, "Le Éclair brillant"), (2, "ÉCLAIR"), (3, "这是测试框架文档"), (4, "none")], "id bigint, c string")
    n = spark.createDataFrame([("éclair",), ("Éclair",), ("测试框",), ("ill",)], "token string")
    got = rows(search.containing(t, "id", F.col("c"), n), "id", "token")
    assert got == [(1, "ill"), (1, "Éclair"), (2, "Éclair"), (3, "测试框")]


def test_best_segment(spark):
    df = spark.createDataFrame([("---\na: b\n---\n第一句话在这里。第二句提到咖啡和茶。第三句话结尾。没有关系的一句。", ["咖啡", "茶"])], "c string, k array<string>")
    assert df.select(provenance.best_segment(F.col("c"), F.col("k"))).first()[0] == "第一句话在这里。第二句提到咖啡和茶。第三句话结尾。"
    assert df.select(provenance.best_segment(F.col("c"), F.array().cast("array<string>"))).first()[0] == "第一句话在这里。"


def test_injection(spark):
    r = spark.createDataFrame([("mem", "likes tea", "sys", "hi", "Ann")], "memory_text string, persona_text string, system_prompt string, user_message string, user_name string")
    s = context.inject(r).first()
    assert s["system_prompt"] == "sys\n\n<memory>\n【长期记忆】\n关于你：\nlikes tea\n\nmem\n</memory>" and s["user_message"] == "hi"
    assert context.inject(r, context.PREFIX_USER, "{{user}}:{{content}}", False).first()["user_message"] == "Ann:关于你：\nlikes tea\n\nmem\n\nhi"
    assert context.inject(r, context.MANUAL).first()["system_prompt"] == "sys"


# ---------------------------------------------------------------- similarity

def test_set_pairs_match_brute_force(spark):
    rnd = random.Random(5)
    sets = [(i, f"u{i % 2}", sorted({f"t{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 9))})) for i in range(80)]
    df = spark.createDataFrame(sets, "id bigint, user_id string, tokens array<string>")
    for theta in (0.3, 0.6, 1.0):
        want = sorted((a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and a[1] == b[1]
                      and len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])) >= theta)
        assert rows(similarity.set_pairs(df, df, theta, ("user_id",)), "l_id", "r_id") == want


def test_set_pairs_with_crowded_tokens(spark, monkeypatch):
    """Tokens that a third of all sets begin with are dealt out in blocks; lengths from one token to many."""
    monkeypatch.setattr(similarity, "_SET_BLOCK", 4)
    rnd = random.Random(7)
    sets = [(i, sorted({f"hot{rnd.randrange(3)}"} | {f"t{rnd.randrange(9)}" for _ in range(rnd.randrange(0, 12))})) for i in range(90)]
    sets += [(100 + k, [f"long{j}" for j in range(k, 300 + k)]) for k in range(0, 90, 15)] + [(200, ["alone"]), (201, [])]
    df = spark.createDataFrame(sets, "id bigint, tokens array<string>")
    for theta in (0.25, 0.7, 1.0):
        want = {(a[0], b[0]): len(set(a[1]) & set(b[1])) / len(set(a[1]) | set(b[1])) for a in sets for b in sets if a[0] < b[0] and set(a[1]) | set(b[1])}
        want = sorted(k for k, j in want.items() if j >= theta)
        assert rows(similarity.set_pairs(df, df, theta), "l_id", "r_id") == want
        other = df.filter("id % 2 = 0").select((F.col("id") + 1000).alias("id"), "tokens")
        both = sorted((a[0], b[0] + 1000) for a in sets for b in sets if b[0] % 2 == 0 and set(a[1]) | set(b[1]) and len(set(a[1]) & set(b[1])) / len(set(a[1]) | set(b[1])) >= theta)
        assert rows(similarity.set_pairs(df, other, theta), "l_id", "r_id") == both


def test_vector_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_CELL_BLOCK", 7)
    monkeypatch.setattr(similarity, "_PIVOTS", 5)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 6))
    vs = [(f"p{i:03d}", (base[i % 8] + rng.normal(size=6) * .4).tolist()) for i in range(120)] + [("z1", [1.0, 0.0]), ("z2", [1.0, 0.1])]
    df = spark.createDataFrame(vs, "id string, embedding array<double>")
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else -1
    for theta in (0.5, 0.85, 0.95):
        want = sorted((a[0], b[0]) for a in vs for b in vs if a[0] < b[0] and cos(a[1], b[1]) >= theta)
        assert rows(similarity.vector_pairs(df, theta), "l_id", "r_id") == want


def test_least_similar_and_pruning(spark, monkeypatch):
    """Least partner against brute force; on clustered vectors the share of compared pairs falls as the table grows."""
    monkeypatch.setattr(similarity, "_CELL_BLOCK", 50)
    rng = np.random.default_rng(6)
    shares = []
    for n in (400, 4_000):
        centres = rng.normal(size=(n // 20, 16))
        m = np.repeat(centres, 20, axis=0) + rng.normal(size=(n, 16)) * .05
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, embedding array<double>")
        u = m / np.linalg.norm(m, axis=1)[:, None]
        sims = u @ u.T
        np.fill_diagonal(sims, -1)
        want = {i: round(float(r[r >= .9].min()), 9) for i, r in enumerate(sims) if (r >= .9).any()}
        assert {r["id"]: round(r["sim"], 9) for r in similarity.least_similar(df, .9).collect()} == want
        met, every = similarity.compared_pairs(df, .9)
        shares.append(met / every)
    print("share of pairs compared:", shares)
    assert shares[1] < shares[0] / 2 and shares[1] < 0.1


def _bm25(query, doc, corpus):
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    s = 0.0
    for t in query:
        tf = doc.count(t)
        if tf:
            df = sum(t in c for c in corpus)
            s += max(math.log((n - df + .5) / (df + .5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(doc) / avg))
    return round(s, 6)


def _scan_model(atoms, theta, jac):
    """Sequential game of the documentation: copies first, then near copies."""
    corpus = [a["t"] for a in atoms]
    status, wins = {}, {}

    def turn(a):
        return (-a["imp"], a["id"])

    def play(pool, partners):
        marked = set()
        for a in sorted(pool, key=turn):
            if a["id"] in marked:
                continue
            for b in partners(a):
                if b["id"] in marked or b["id"] == a["id"]:
                    continue
                lose, win = (b, a) if a["imp"] >= b["imp"] else (a, b)
                marked.add(lose["id"])
                status[lose["id"]] = "dormant"
                status.setdefault(win["id"], "active")
                wins[win["id"]] = wins.get(win["id"], 0) + 1
                wins.setdefault(lose["id"], 0)
                break
        return [a for a in pool if a["id"] not in marked]

    groups: dict = {}
    for a in atoms:
        groups.setdefault((a["user"], tuple(sorted(a["t"])), tuple(a["e"])), []).append(a)
    alive = []
    for g in groups.values():
        alive += play(g, lambda a, g=g: sorted(g, key=turn))

    def near(a):
        out = []
        for b in alive:
            if b["user"] != a["user"] or b["id"] == a["id"]:
                continue
            sa, sb = set(a["t"]), set(b["t"])
            cos = np.dot(a["e"], b["e"]) / np.linalg.norm(a["e"]) / np.linalg.norm(b["e"])
            if len(sa & sb) / len(sa | sb) >= jac and cos > theta:
                out.append(b)
        return sorted(out, key=lambda b: (-_bm25(sa_list(a), b["t"], corpus), b["id"]))

    def sa_list(a):
        return list(dict.fromkeys(a["t"]))

    play(alive, near)
    return {i: (status[i], wins[i]) for i in status}


def test_semantic_scan_matches_sequential_model(spark):
    for seed in (1, 2):
        rnd = random.Random(seed)
        atoms = []
        for i in range(40):
            t = [f"w{rnd.randrange(7)}" for _ in range(rnd.randrange(2, 6))]
            e = [float(rnd.randrange(1, 4)), float(rnd.randrange(1, 4))]
            atoms.append(dict(id=i, user=f"u{i % 2}", t=t, e=e, imp=rnd.randrange(1, 6) / 10))
        df = spark.createDataFrame([(a["id"], a["user"], " ".join(a["t"]), a["imp"], a["e"], "active", 0) for a in atoms],
                                   "atom_id bigint, user_id string, content string, importance double, embedding array<double>, status string, access_count bigint")
        got = {r["atom_id"]: (r["status"], r["wins"]) for r in dedup.semantic_scan(df, 0.9, 0.3).collect()}
        assert got == _scan_model(atoms, 0.9, 0.3)


def test_reinforce_fold(spark):
    rnd = random.Random(4)
    hits = [(1, s, rnd.random(), rnd.random()) for s in range(300)] + [(2, s, rnd.random() * .2, .1) for s in range(3)]
    a = spark.createDataFrame([(1, .1, .5, 0), (2, .3, .5, 4), (3, .97, .5, 1)], "atom_id bigint, importance double, confidence double, access_count bigint").withColumn(
        "expires_at", F.lit("2024-02-11").cast("timestamp"))
    h = spark.createDataFrame(hits, "atom_id bigint, seq bigint, judge double, confidence double")
    got = {r["atom_id"]: r for r in lifecycle.reinforce(a, h, NOW).collect()}
    imp, acc = .3, 4
    for _, _, j, _ in hits[300:]:
        imp, acc = min(.95, max(imp + max(.01, .05 / math.log2(acc + 2)), .7 * j + .3 * imp)), acc + 1
    assert abs(got[2]["importance"] - imp) < 1e-12 and got[2]["access_count"] == 7
    assert got[1]["importance"] == .95 and got[1]["access_count"] == 300
    assert got[3]["importance"] == .97
    days = (got[2]["expires_at"] - pd.Timestamp(NOW)).total_seconds() / 86400
    assert abs(days - 10 * 1.3 ** 3) < 1e-6


# ---------------------------------------------------------------- graph and ties

def test_edge_increments(spark):
    none = spark.createDataFrame([], "from_node string, to_node string, relation_type string, diary_id bigint, weight double")
    def add(state, *deltas):
        d = spark.createDataFrame([(a, b, r, 0, float(w), i) for i, (a, b, r, w) in enumerate(deltas)],
                                  "from_node string, to_node string, relation_type string, diary_id bigint, weight double, seq bigint")
        return graph.merge_edges(state, d)
    s = add(add(none, ("x", "y", "co_occur", 1), ("x", "y", "co_occur", 1)), ("x", "y", "co_occur", 3), ("b", "a", "co_occur", 2), ("a", "b", "co_occur", 1),
            ("a", "b", "mentions", 9), ("m", "n", "co_occur", 5), ("n", "m", "co_occur", -2))
    assert rows(s, "from_node", "to_node", "relation_type", "weight") == [("a", "b", "co_occur", 3.0), ("a", "b", "mentions", 9.0), ("m", "n", "co_occur", 3.0), ("x", "y", "co_occur", 5.0)]


def test_cooccurrence_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(graph, "_PAIR_BLOCK", 3)
    rnd = random.Random(9)
    held = {d: sorted(rnd.sample("abcdefghijkl", rnd.randrange(1, 9))) for d in range(1, 15)}
    held[20] = held[21] = held[1]
    m = spark.createDataFrame([(d, e) for d, es in held.items() for e in es], "diary_id bigint, from_node string")
    want: dict = {}
    for d, es in held.items():
        for i, a in enumerate(es):
            for b in es[i + 1:]:
                want[(a, b)] = want.get((a, b), 0) + 1
    assert rows(graph.cooccurrence(m), "from_node", "to_node", "weight") == sorted((a, b, float(n)) for (a, b), n in want.items())


def test_neighbors_by_any_name(spark):
    n = spark.createDataFrame([("entity:o'brien_(x)", "O'Brien (X)", "entity"), ("entity:b", "B", "entity"), ("date:1", "b", "date")], "node_id string, name string, type string")
    e = spark.createDataFrame([("entity:b", "entity:o'brien_(x)", "co_occur", 2.0, "active"), ("entity:b", "date:1", "belongs_to", .5, "dormant")],
                              "from_node string, to_node string, relation_type string, weight double, status string")
    q = spark.createDataFrame([(1, "O'Brien (X)"), (2, "nobody")], "query_id bigint, name string")
    nodes, edges = graph.neighbors(n, e, q)
    assert rows(nodes, "query_id", "node_id") == [(1, "entity:b"), (1, "entity:o'brien_(x)")]
    assert rows(edges, "query_id", "weight") == [(1, 2.0)]


def test_index_diary(spark):
    d = spark.createDataFrame([(1, "---\ndate: 2026-06-01\nmood: Happy\ntopics: [\"Work\"]\n---\n见 [[张三]] 和 [[Ann]]")], "diary_id bigint, content string")
    u = spark.createDataFrame([("u_1", ["Ann"])], "uid string, names array<string>")
    nodes, edges = graph.index_diaries(d, u)
    assert {r["node_id"] for r in nodes.collect()} == {"diary:diary_1", "entity:张三", "user:ann", "date:20260601", "emotion:happy", "topic:work"}
    assert rows(edges, "relation_type", "weight") == [("belongs_to", .5)] * 3 + [("co_occur", 1.0)] + [("mentions", 1.0)] * 2


def _relations_model(events):
    rel, block = {}, set()
    for actor, target, action, kind in events:
        pair = tuple(sorted((actor, target)))
        shut = (actor, target) in block or (target, actor) in block
        e = rel.get((pair, kind))
        live = e is not None and e[2] in ("pending", "active")
        if action == "claim" and not shut and not (live and e[0] != actor):
            rel[(pair, kind)] = [actor, target, "pending", .1]
        elif action in ("confirm", "reject") and e and e[2] == "pending" and e[1] == actor:
            e[2], e[3] = ("active", .7) if action == "confirm" else ("rejected", e[3])
        elif action == "remove" and e:
            e[2] = "rejected"
        elif action == "block":
            for k in ("friend_of", "family_of", "trusted_by"):
                if (pair, k) in rel:
                    rel[(pair, k)][2] = "blocked"
            block.add((actor, target))
        elif action == "unblock":
            block.discard((actor, target))
        elif action == "co_occur":
            f = rel.get((pair, "friend_of"))
            if not (f and f[2] in ("pending", "active")):
                rel[(pair, "friend_of")] = [actor, target, "passive", .05]
    out = [(a, b, k[1], s, w) for k, (a, b, s, w) in rel.items()] + [(a, b, "blocked_by", "active", 1.0) for a, b in block]
    return sorted(out)


def test_relations_match_model_over_slices(spark, monkeypatch):
    monkeypatch.setattr(social, "_LOG_SLICE", 25)
    rnd = random.Random(8)
    acts = ["claim", "claim", "confirm", "reject", "block", "unblock", "co_occur", "remove"]
    ev = []
    for i in range(300):
        a, b = rnd.sample(["a", "b", "c"], 2)
        ev.append((a, b, rnd.choice(acts), rnd.choice(["friend_of", "family_of"])))
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ev)], "seq bigint, actor string, target string, action string, relation_type string")
    got = rows(social.relations_from_events(df), "from_user", "to_user", "relation_type", "status", "weight")
    assert got == _relations_model(ev)


def test_relation_lifecycle(spark):
    def after(*ev):
        df = spark.createDataFrame([(i, a, b, x, "friend_of") for i, (a, b, x) in enumerate(ev)], "seq bigint, actor string, target string, action string, relation_type string")
        return social.relations_from_events(df)
    e = after(("a", "b", "claim"))
    assert rows(e, "status", "weight", "cap") == [("pending", .1, .4)]
    e = after(("a", "b", "claim"), ("b", "a", "confirm"), ("a", "b", "co_occur"))
    assert rows(e, "status", "weight", "cap") == [("active", .7, 1.0)]
    assert .02 <= social.decay(e, 14).first()["weight"] < .7
    e = after(("a", "b", "claim"), ("b", "a", "block"), ("a", "b", "claim"))
    assert rows(social.accessible(e), "uid", "other") == [("a", "a"), ("b", "b")]
    assert rows(after(("a", "b", "co_occur")), "status", "weight") == [("passive", .05)]


# ---------------------------------------------------------------- people, capture, archive

def test_identity_upsert_and_merge(spark):
    none_u = spark.createDataFrame([], "uid string, names array<string>, confidence double, created_at timestamp, updated_at timestamp")
    none_i = spark.createDataFrame([], "uid string, platform_ids map<string,array<string>>, first_seen timestamp, last_seen timestamp, verified boolean, source string")
    seen = spark.createDataFrame([(1, "qq", "1", "Ann"), (2, "qq", "2", "Bob"), (3, "qq", "1", "Anna"), (4, "qq", "1", "Ann")], "seq bigint, platform string, platform_id string, name string")
    u, i = users.upsert(none_u, none_i, seen, NOW)
    u, i = users.upsert(u, i, spark.createDataFrame([(5, "qq", "1", "Annie")], seen.schema), NOW)
    names = {tuple(r["names"]): r["uid"] for r in u.collect()}
    assert set(names) == {("Ann", "Anna", "Annie"), ("Bob",)}
    keep, drop = names[("Ann", "Anna", "Annie")], names[("Bob",)]
    p = spark.createDataFrame([(keep, ["x"], [keep]), (drop, ["y"], [drop])], "uid string, tags array<string>, known_ids array<string>")
    u2, i2, p2 = users.merge(u, i, p, spark.createDataFrame([(keep, drop)], "keep_uid string, drop_uid string"), NOW)
    got = {r["uid"]: r for r in u2.collect()}
    assert sorted(got[keep]["names"]) == ["Ann", "Anna", "Annie", "Bob"] and got[drop]["names"] == [f"已合并至{keep}"]
    assert [(r["uid"], r["platform_ids"]) for r in i2.collect()] == [(keep, {"qq": ["1", "2"]})]
    assert {r["uid"]: sorted(r["tags"]) for r in p2.collect()}[keep] == ["x", "y"]


def test_persona_delta(spark):
    d = json.dumps({"delete": ["old "], "modify": [{"old": "tea", "new": "coffee"}], "add": ["runs"], "tags": ["a"]})
    df = spark.createDataFrame([("likes old tea\n\nok", d), ("keep", "no json")], "summary string, delta string")
    got = [tuple(r) for r in users.apply_delta(df).select("new_summary", "new_tags").collect()]
    assert got == [("likes coffee\nok\n- runs", ["a"]), ("keep", None)]


def test_parse_answers(spark):
    ok = '{"diary": "今天和张三打球了", "atoms": [{"content": "张三打球", "type": "episodic"}]}'
    cases = [ok, f"```json\n{ok}\n```", json.dumps(json.loads(ok), indent=1, ensure_ascii=False), '{"diary": "只有日记内容没有结束', '{"diary": "x y", "atoms": [{"type": "factual"}]}',
             "这是一段没有任何结构的回答，但是它足够长，可以当作日记正文来使用，所以会被保留下来。", "短"]
    df = spark.createDataFrame(list(enumerate(cases)), "id bigint, raw string")
    got = [(r["level"], r["diary"], [a["content"] for a in r["atoms"]]) for r in capture.parse_responses(df).orderBy("id").collect()]
    assert got[0] == (1, "今天和张三打球了", ["张三打球"]) and got[1] == got[0]
    assert got[2] == (2, "今天和张三打球了", ["张三打球"])
    assert got[3] == (1, "只有日记内容没有结束", [])
    assert got[4] == (1, "x y", [])
    assert got[5][0] == 3 and got[5][1] == cases[5]
    assert got[6] == (None, None, [])


def test_step_chain(spark):
    atom = capture.ATOM
    raw = [("昨天完成了工作", None, .5, ["张三"], None, "片段"), ("用户喜欢喝茶", None, .5, [], None, None), ("明天去散步", None, .5, [], None, None), ("abc", None, .5, [], None, None)]
    df = spark.createDataFrame([(1, "u_1", "", .8, raw)], f"unit_id bigint, user_id string, diary string, judge_importance double, raw_atoms array<{atom}>").withColumn("diary_date", F.lit("2024-01-01").cast("date"))
    out = capture.run_steps(df, capture.default_steps(NOW, max_atoms=2)).first()
    assert out["diary"] == "与张三的对话。"
    assert [(a["content"], a["atom_type"], a["importance"]) for a in out["atoms"]] == [("昨天完成了工作", "episodic", .8), ("用户喜欢喝茶", "preference", .8)]
    assert out["atoms"][0]["diary_snippet"] == "片段"


def test_owner_and_tags(spark):
    u = spark.createDataFrame([("u_1", ["Ann"]), ("u_0123456789ab", ["Bob"])], "uid string, names array<string>")
    a = spark.createDataFrame([(1, 0, "u_1", ["Ann", "Bob"]), (1, 1, "u_1", ["Zoe"])], "unit_id bigint, pos int, user_id string, own_entities array<string>")
    assert rows(capture.choose_owner(a, u), "pos", "user_id") == [(0, "u_0123456789ab"), (1, "u_1")]
    t = spark.createDataFrame([(1, "u_1", "hello"), (2, "u_1", "[10:00] u_0123456789ab: hi"), (3, "u_9999", "x")], "unit_id bigint, user_id string, text string")
    assert [r[1] for r in rows(capture.tag_transcripts(t, u), "unit_id", "text")] == ["[Ann]: hello", "[10:00] Bob: hi", "[用户9999]: x"]


def test_archive_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "2026-06-01", "first\n---\nline", True), (2, "2026-06-01", "second", True), (3, "2026-06-02", "third", True)], "diary_id bigint, date string, content string, archived boolean").withColumn("date", F.col("date").cast("date"))
    archive.export(d, str(tmp_path / "cold"), NOW)
    cut = d.withColumn("content", F.substring("content", 1, 2))
    back = archive.restore(cut, archive.read(spark, str(tmp_path / "cold")))
    assert rows(back, "diary_id", "content", "archived") == [(1, "first\n---\nline", False), (2, "second", False), (3, "third", False)]


def test_context_windows(spark):
    m = spark.createDataFrame([(i, "s", "user" if i % 2 else "assistant", f"m{i}", "u_1", "Ann") for i in range(1, 9)], "msg_id bigint, session_id string, role string, content string, sender_id string, sender_name string").withColumn("ts", F.lit(NOW).cast("timestamp"))
    w = spark.createDataFrame([("s", 3)], "session_id string, last_consolidated_msg_id bigint")
    assert rows(messages.context_since(m, w, 3), "msg_id") == [(4,), (5,), (6,)]
    assert rows(messages.context_since(m, w.filter("false"), 3), "msg_id") == [(6,), (7,), (8,)]
    assert messages.recent_context(m, 2, NOW).first()["context"] == "[00:00] Ann: m7\n[00:00] Bot: 我: m8"
    assert rows(messages.unprocessed(m, w), "messages", "rounds") == [(5, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_batch(spark, seed):
    rng = random.Random(seed)
    texts = [(i, " ".join(rng.sample("aa bb cc dd ee ff".split(), rng.randint(2, 5)))) for i in range(40)] + [(40, ""), (41, "")]
    kept, want = [], {}
    for i, t in texts:
        a = set(t.split())
        hit = next((j for j, b in kept if a and len(a & b) / len(a | b) >= .6), None)
        if hit is None:
            kept.append((i, a))
        else:
            want[i] = hit
    got = dedup.repeats_in_batch(spark.createDataFrame(texts, "new_id bigint, content string"))
    assert {r["new_id"]: r["first_id"] for r in got.collect()} == want


def test_vector_blocks_equal_one_block(spark, monkeypatch):
    rng = random.Random(1)
    make = lambda n, d: [(i, [float(rng.randint(-2, 2)) for _ in range(d + i % 2)]) for i in range(n)]
    items = spark.createDataFrame(make(60, 3) + [(60, None)], "atom_id bigint, embedding array<double>")
    asked = spark.createDataFrame(make(20, 3) + [(20, None)], "query_id bigint, embedding array<double>")
    run = lambda: sorted(tuple(r) for r in search.vector_topk(items, asked, 4, "atom_id", floor=0.0).collect())
    one = run()
    monkeypatch.setattr(search, "_VECTOR_BLOCK", 3)
    monkeypatch.setattr(search, "_VECTOR_SLICE", 7)
    assert run() == one and one


def test_set_pairs_check_vectors_inside_the_tasks(spark, monkeypatch):
    """Ids of two types, blocks whose hashed parts can be empty, cosines above a number."""
    monkeypatch.setattr(similarity, "_SET_BLOCK", 3)
    rnd = random.Random(3)
    sets = [(i, sorted({f"t{rnd.randrange(6)}" for _ in range(3)}), [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(30)]
    df = spark.createDataFrame(sets, "id bigint, tokens array<string>, v array<double>")
    other = df.select(F.concat(F.lit("n"), "id").alias("id"), "tokens", "v")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = sorted((a[0], f"n{b[0]}") for a in sets for b in sets if len(set(a[1]) & set(b[1])) / len(set(a[1]) | set(b[1])) >= 0.5 and cos(a[2], b[2]) > 0.2)
    assert rows(similarity.set_pairs(df, other, 0.5, vectors=("v", 0.2)), "l_id", "r_id") == want


def test_vector_pairs_in_plain_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_VISITS", -1)
    monkeypatch.setattr(similarity, "_PLAIN_BLOCK", 20_000)
    rnd = random.Random(4)
    vecs = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(vecs, "id bigint, embedding array<double>")
    x = np.array([v for _, v in vecs])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] >= 0.5)
    assert rows(similarity.vector_pairs(df, 0.5), "l_id", "r_id") == want
