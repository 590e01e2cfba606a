"""Triggers: batch against plain Python, streams against batch."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from recollect.streaming import triggers, upkeep

MSG = "msg_id bigint, session_id string, sender_id string, ts timestamp"


def log(spark, n=200, sessions=3, seed=1, step=25):
    rnd = random.Random(seed)
    t, rows = pd.Timestamp("2024-01-01"), []
    for i in range(1, n + 1):
        t += pd.Timedelta(minutes=rnd.choice([1, 2, step, 90]))
        s = rnd.randrange(sessions)
        rows.append((i, f"s{s}", f"u{s % 2}", t.to_pydatetime()))
    return rows, spark.createDataFrame(rows, MSG)


def _greedy(times, gap):
    last, out = None, []
    for i, t in times:
        if last is None or (t - last).total_seconds() >= gap:
            out.append(i)
            last = t
    return out


def test_spaced_over_slices(spark, monkeypatch):
    monkeypatch.setattr(triggers, "_SLICE", 17)
    rows, df = log(spark)
    ev = df.select(F.col("msg_id").alias("id"), F.col("sender_id").alias("user_id"), "ts")
    for gap in (60, 1800, 20000):
        assert sorted(r["id"] for r in triggers.spaced(ev, gap).collect()) == _greedy([(r[0], r[3]) for r in rows], gap)
    want = sorted(sum((_greedy([(r[0], r[3]) for r in rows if r[2] == u], 7200) for u in ("u0", "u1")), []))
    assert sorted(r["id"] for r in triggers.spaced(ev, 7200, "user_id").collect()) == want


def test_idle_units(spark):
    rows, df = log(spark, seed=2)
    want = []
    for s in ("s0", "s1", "s2"):
        unit, last, n, groups = -1, None, 0, []
        for r in (r for r in rows if r[1] == s):
            if last is None or (r[3] - last).total_seconds() >= 3600:
                groups.append(0)
            groups[-1] += 1
            last = r[3]
        want += [(s, i, n) for i, n in enumerate(groups) if n >= 2]
    got = sorted((r["session_id"], r["unit_no"], r["n"]) for r in triggers.idle_units(df).collect())
    assert got == sorted(want)


def _run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive


def test_count_stream_equals_batch(spark, tmp_path):
    rows, df = log(spark, n=160, sessions=2, step=3, seed=3)
    df = df.withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, msg_id)"))
    src = str(tmp_path / "in")
    df.repartitionByRange(4, "msg_id").write.parquet(src)
    stream = triggers.message_stream(spark, src, MSG, maxFilesPerTrigger="4")
    _run(triggers.consolidation_stream(stream, rounds=5), "units", tmp_path)
    got = sorted((r["session_id"], r["unit_no"], r["first_msg_id"], r["last_msg_id"]) for r in spark.table("units").filter("reason = 'count'").collect())
    none = spark.createDataFrame([], "session_id string, last_consolidated_msg_id bigint")
    batch = triggers.count_units(df, none, 5).collect()
    assert got == sorted((r["session_id"], r["unit_no"], r["first_msg_id"], r["last_msg_id"]) for r in batch)


def test_idle_stream_fires_after_silence(spark, tmp_path):
    src = str(tmp_path / "in")
    early = [(i, "s0", "u0", (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)).to_pydatetime()) for i in range(3)]
    later = [(9, "s1", "u0", pd.Timestamp("2024-01-01 06:00:00").to_pydatetime())]
    last = [(10, "s1", "u0", pd.Timestamp("2024-01-01 12:00:00").to_pydatetime())]
    for i, part in enumerate((early, later, last)):
        spark.createDataFrame(part, MSG).coalesce(1).write.mode("append").parquet(src)
    stream = triggers.message_stream(spark, src, MSG, maxFilesPerTrigger="1")
    _run(triggers.consolidation_stream(stream), "idle", tmp_path)
    got = [(r["session_id"], r["reason"], r["n"], r["last_msg_id"]) for r in spark.table("idle").collect()]
    assert ("s0", "idle", 3, 2) in got


def test_silence_inside_the_data_parts_units(spark, tmp_path):
    src = str(tmp_path / "in")
    at = [0, 1, 2, 300, 301, 302, 900]
    rows = [(i, "s0", "u0", (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()) for i, m in enumerate(at)]
    spark.createDataFrame(rows, MSG).coalesce(1).write.parquet(src)
    _run(triggers.consolidation_stream(triggers.message_stream(spark, src, MSG)), "silence", tmp_path)
    got = sorted((r["first_msg_id"], r["last_msg_id"], r["reason"], r["n"]) for r in spark.table("silence").collect())
    assert got == [(0, 2, "idle", 3), (3, 5, "idle", 3)]


def test_rate_limit_stream(spark, tmp_path):
    rows, df = log(spark, n=60)
    src = str(tmp_path / "in")
    df.select(F.col("msg_id").alias("id"), F.col("sender_id").alias("user_id"), "ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id bigint, user_id string, ts timestamp").parquet(src)
    _run(triggers.spaced_stream(stream, 7200), "spaced", tmp_path)
    want = sorted(sum((_greedy([(r[0], r[3]) for r in rows if r[2] == u], 7200) for u in ("u0", "u1")), []))
    assert sorted(r["id"] for r in spark.table("spaced").collect()) == want


def test_retention_and_graph_sinks(spark, tmp_path):
    keep = upkeep.retention_sink(str(tmp_path / "m"), MSG, 2)
    _rows, df = log(spark, n=12)
    keep(df.filter("msg_id <= 6"), 0)
    keep(df.filter("msg_id > 6"), 1)
    keep(df.filter("msg_id > 6"), 1)  # a replay changes nothing
    got = upkeep.rows_of(spark, str(tmp_path / "m"), MSG)
    assert got.groupBy("sender_id").count().filter("count > 2").isEmpty() and got.count() == 4
    users = spark.createDataFrame([("u_1", ["Ann"])], "uid string, names array<string>")
    sink = upkeep.graph_sink(str(tmp_path / "g"), users, "2024-02-01 00:00:00")
    sink(spark.createDataFrame([(1, "[[Ann]] [[B]]")], "diary_id bigint, content string"), 0)
    sink(spark.createDataFrame([(2, "[[Ann]] [[B]]")], "diary_id bigint, content string"), 1)
    e = upkeep.rows_of(spark, str(tmp_path / "g" / "edges"), upkeep.EDGE_STATE)
    assert e.filter("relation_type = 'co_occur'").first()["weight"] == 2.0
    n = {r["node_id"]: r["count"] for r in upkeep.rows_of(spark, str(tmp_path / "g" / "nodes"), upkeep.NODE_STATE).collect()}
    assert n["user:ann"] == 2 and n["diary:diary_2"] == 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    """A batch of one sender rewrites one bucket of eight; replays and gaps in the batch ids change nothing."""
    root = str(tmp_path / "m")
    rows = [(i, "s", f"u{i % 40}", pd.Timestamp("2024-01-01").to_pydatetime()) for i in range(200)]
    sink = upkeep.retention_sink(root, MSG, 3, buckets=8)
    written = lambda batch: len(list((tmp_path / "m" / "data" / f"batch={batch}").glob("bucket=*")))
    state = lambda: sorted((r["sender_id"], r["msg_id"]) for r in upkeep.rows_of(spark, root, MSG).collect())
    sink(spark.createDataFrame(rows, MSG), 3)
    assert written(3) == 8
    sink(spark.createDataFrame([(500, "s", "u7", rows[0][3]), (501, "s", "u7", rows[0][3])], MSG), 10)
    once = state()
    assert written(10) == 1 and [m for u, m in once if u == "u7"] == [167, 500, 501] and len(once) == 120
    sink(spark.createDataFrame([(500, "s", "u7", rows[0][3]), (501, "s", "u7", rows[0][3])], MSG), 10)
    assert state() == once
    assert len(upkeep.superseded(spark, root)) == 1
    sink(spark.createDataFrame([], MSG), 11)
    assert state() == once
