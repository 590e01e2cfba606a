"""Components of a pair graph, play inside them, spacing over slices, relation logs in halves."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.operators import components, dedup, social
from recollect.streaming import triggers


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def model_groups(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    out = {}
    for a, b in links:
        if a != b:
            out.setdefault(find(a), set()).update((a, b))
    return sorted(sorted(v) for v in out.values())


def groups(df):
    out = {}
    for node, root in df.collect():
        out.setdefault(root, set()).add(node)
        assert root is not None
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize("held", [200_000, 20])
def test_connected(spark, monkeypatch, held):
    """In one task and by contraction: a chain, a star, random links, loops and repeats."""
    monkeypatch.setattr(components, "TASK_LINKS", held)
    rng = random.Random(held)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + k) for k in range(200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    links += [(5, 5), (9000, 9000), (1, 0), (1, 0)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert groups(components.connected(df)) == model_groups(links)
    names = df.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b"))
    assert groups(components.connected(names)) == sorted(sorted(f"n{x}" for x in g) for g in model_groups(links))
    assert components.connected(df.limit(0)).count() == 0


def plain_play(importance, partners):
    marked, out = set(), []
    for v in sorted(importance, key=lambda x: (-importance[x], x)):
        if v not in marked:
            other = next((r for _, r in sorted(partners.get(v, [])) if r not in marked), None)
            if other is not None:
                w, x = (v, other) if importance[v] >= importance[other] else (other, v)
                marked.add(x)
                out.append((w, x))
    return sorted(out)


def game(spark, rng, nodes, pairs):
    importance = {n: rng.randrange(1, 8) / 10 for n in nodes}
    edges = [(a, b, rng.randrange(5) / 2) for x, y in pairs for a, b in ((x, y), (y, x))]
    partners = {}
    for a, b, s in edges:
        partners.setdefault(a, []).append((-s, b))
    return importance, partners, edges


@pytest.mark.parametrize("held,seed", [(200_000, 1), (30, 2), (8, 3)])
def test_play_in_one_task_by_components_and_in_rounds(spark, monkeypatch, held, seed):
    monkeypatch.setattr(components, "TASK_LINKS", held)
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(100 + i, 101 + i) for i in range(30)}
    nodes = sorted({x for p in pairs for x in p})
    importance, partners, edges = game(spark, rng, nodes, pairs)
    df = spark.createDataFrame(edges, "l_id bigint, r_id bigint, bm25 double")
    got = dedup._play(spark.createDataFrame(list(importance.items()), "id bigint, importance double"), df)
    want = plain_play(importance, partners)
    wins = {(r["atom_id"], r["status"], r["wins"]) for r in got.collect()}
    assert {a for a, s, _ in wins if s == "dormant"} == {x for _, x in want}
    won = {}
    for w, _ in want:
        won[w] = won.get(w, 0) + 1
    assert {(a, n) for a, s, n in wins if s == "active"} == set(won.items())


def test_a_chain_of_near_copies_takes_few_jobs(spark):
    n = 5_000
    importance = {i: 1 - i / 10_000 for i in range(n)}
    edges = [(a, b, 1.0) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))]
    df = spark.createDataFrame(pd.DataFrame(edges, columns=["l_id", "r_id", "bm25"]))
    nodes = spark.createDataFrame(list(importance.items()), "id bigint, importance double")
    got, jobs = jobs_of(spark, "chain", lambda: dedup._play(nodes, df).filter("status = 'dormant'").count())
    assert got == n // 2 and jobs <= 20


def test_a_chain_beyond_one_task_goes_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 400)
    n = 600
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "l_id bigint, r_id bigint")
    rounds, real = [], dedup._first_block
    monkeypatch.setattr(dedup, "_first_block", lambda *a: rounds.append(1) or real(*a))
    got = {r["id"]: r["first_id"] for r in dedup._kept_in_rounds(pairs).collect()}
    assert got == {i: i - 1 for i in range(1, n, 2)}
    assert len(rounds) <= 8  # six blocks of a hundred, where the chain has 300 links


@pytest.mark.parametrize("held", [200_000, 15, 6])
def test_repeats_are_decided_in_order(spark, monkeypatch, held):
    monkeypatch.setattr(components, "TASK_LINKS", held)
    rng = random.Random(held)
    texts = [(i, " ".join(rng.sample("aa bb cc dd ee ff gg".split(), rng.randint(2, 5)))) for i in range(50)]
    kept, want = [], {}
    for i, t in texts:
        a = set(t.split())
        hit = next((j for j, b in kept if len(a & b) / len(a | b) >= 0.6), None)
        if hit is None:
            kept.append((i, a))
        else:
            want[i] = hit
    got = dedup.repeats_in_batch(spark.createDataFrame(texts, "new_id bigint, content string"))
    assert {r["new_id"]: r["first_id"] for r in got.collect()} == want


# ---------------------------------------------------------------- spacing


def plain_walk(times, gap):
    last, out = None, []
    for t, i in sorted(times):
        if last is None or t - last >= gap:
            out.append(i)
            last = t
    return out


@pytest.mark.parametrize("slice_,seed", [(100_000, 1), (13, 2), (4, 3)])
def test_spacing(spark, monkeypatch, slice_, seed):
    """One slice, many, and more jumps than one task follows; equal times, gaps of any size, a hot key."""
    monkeypatch.setattr(triggers, "_SLICE", slice_)
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(4_000)) for i in range(300)] + [(1000 + i, "a", 500) for i in range(40)]
    rows += [(2000, "z", 7)]
    df = spark.createDataFrame(rows, "id bigint, user_id string, s bigint").select("id", "user_id", F.timestamp_seconds("s").alias("ts"))
    df = df.unionByName(spark.createDataFrame([(9999, "a")], "id bigint, user_id string").withColumn("ts", F.lit(None).cast("timestamp")))
    for gap in (1, 25, 700, 10_000):
        assert sorted(r["id"] for r in triggers.spaced(df, gap).collect()) == sorted(plain_walk([(t, i) for i, _, t in rows], gap))
    want = sorted(x for u in ("a", "b", None, "z") for x in plain_walk([(t, i) for i, k, t in rows if k == u], 60))
    assert sorted(r["id"] for r in triggers.spaced(df, 60, "user_id").collect()) == want
    assert triggers.spaced(df.limit(0), 60).count() == 0


def test_a_dense_log_is_no_group(spark, monkeypatch):
    """100,000 events inside one gap, and some after: no slice is much larger than asked."""
    monkeypatch.setattr(triggers, "_SLICE", 10_000)
    sizes = []
    real = triggers._exits

    def seen(steps, slices):
        out = real(steps, slices)
        sizes.extend(r["count"] for r in out.groupBy("part").count().collect())
        return out

    monkeypatch.setattr(triggers, "_exits", seen)
    df = spark.range(120_000).select("id", F.timestamp_micros(F.col("id") * 500_000).alias("ts"))  # two a second
    got = [r["id"] for r in triggers.spaced(df, 50_000).orderBy("id").collect()]
    assert got == [0, 100_000]
    assert sum(sizes) == 120_000 and max(sizes) < 3 * 10_000


# ---------------------------------------------------------------- relation logs


def test_machine_is_small_and_closed():
    states, after = social._machine()
    assert len(states) < 128 and len(after) == 14 * len(states) and states[0] == (None, None, None, None, False, False)
    for e, action in enumerate(social._ACTIONS):
        for forward in (False, True):
            for s, state in enumerate(states):
                assert states[after[(2 * e + forward) * len(states) + s]] == social._after(state, action, forward)


def test_a_busy_pair_is_folded_in_halves(spark, monkeypatch):
    """The same relations whatever the slices, and no group of more than a slice or two tables."""
    rng = random.Random(12)
    acts = ["claim", "claim", "confirm", "reject", "block", "unblock", "co_occur", "remove"]
    ev = [(i, *rng.choice([("a", "b"), ("b", "a"), ("a", "b"), ("c", "a")]), rng.choice(acts), rng.choice(["friend_of", "family_of"])) for i in range(0, 4_000, 3)]
    df = spark.createDataFrame(ev, "seq bigint, actor string, target string, action string, relation_type string")
    monkeypatch.setattr(social, "_LOG_SLICE", 10_000)
    want = sorted(map(str, social.relations_from_events(df).collect()))
    for slice_ in (7, 100, 1_500):
        monkeypatch.setattr(social, "_LOG_SLICE", slice_)
        assert sorted(map(str, social.relations_from_events(df).collect())) == want
    assert social.relations_from_events(df.limit(0)).count() == 0
