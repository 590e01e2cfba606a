from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from recollect.llm import prefixtrie
from recollect.llm.queries import op12_prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def model(rows):
    """Every node from the definition: (conv_id, depth) -> the other columns."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    lists = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c in lists:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = lists.get(c - c % 100, [])[:h] + lists[c][h:]
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p],
                                        hashlib.sha256(ends.encode()).hexdigest())
    return out


def result(spark, rows, tmp_path):
    spark.createDataFrame(rows, TURNS).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    got = op12_prefix_trie(spark, str(tmp_path)).collect()
    assert len({(r["conv_id"], r["depth"]) for r in got}) == len(got)
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}


def talk(rng, convs, most, words=2):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab"[:words]) * rng.randrange(1, 3)) for c in convs for t in range(rng.randrange(most))]


@pytest.mark.parametrize("share,least", [(1 / 64, 256), (1 / 64, 1), (1 / 1000, 1)])
def test_equals_the_definition(spark, tmp_path, monkeypatch, share, least):
    """Whole subtrees within tasks, level by level, and both."""
    monkeypatch.setattr(prefixtrie, "SHARE", share)
    monkeypatch.setattr(prefixtrie, "LEAST_GROUP", least)
    monkeypatch.setattr(prefixtrie, "WORK", 20)
    rng = random.Random(least)
    rows = talk(rng, [*range(0, 60), *range(95, 160), *range(300, 320)], 9)
    rows += [(500 + k, t, "user", "same") for k in range(30) for t in range(4)]  # copies
    rows += [(700, t, "user", str(t % 3)) for t in range(90)] + [(701, t, "user", str(t % 3)) for t in range(80)]  # long ones
    assert result(spark, rows, tmp_path) == model(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (2, 5, None, "x"), (None, 1, "user", "lost"), (3, 0, "ab", "c"),
            (4, 0, "a", "bc"), (-7, 0, "user", "\U0001f44dß"), (202, 0, "user", "only"), (5, 0, "user", "w " * 50_000)]
    assert result(spark, rows, tmp_path) == model(rows)
    assert result(spark, [], tmp_path) == {}


def test_conversations_without_turns_are_members_of_the_root(spark, tmp_path):
    # base 100 does not exist: where crc32 % 6 covers all own turns nothing is left
    rows = [(c, 0, "user", "x") for c in range(101, 140)]
    want = model(rows)
    assert want[101, 0][5] != hashlib.sha256(b"").hexdigest()
    assert result(spark, rows, tmp_path) == want


def test_extra_columns_and_order_of_rows_do_not_matter(spark):
    rows = talk(random.Random(3), range(20), 6)
    plain = spark.createDataFrame(rows, TURNS)
    more = plain.orderBy(F.rand(1)).withColumns({"path": F.lit("x"), "digest": F.lit(1), "turns": F.lit(2)})
    a, b = (sorted(map(str, prefixtrie.prefix_trie(prefixtrie.turn_lists(df))[0].collect())) for df in (plain, more))
    assert a == b


def test_hash_of_many_members_is_taken_run_by_run(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "LISTED", 7)
    ids = list(range(-5, 300, 3))
    members = spark.createDataFrame([(b"k", i) for i in ids] + [(b"z", 9)], "digest binary, conv_id bigint").repartition(4)
    got = {bytes(r[0]): r[1] for r in prefixtrie.end_hashes(members).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"z": hashlib.sha256(b"9").hexdigest()}
