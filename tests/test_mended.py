"""Cases that once lost or doubled data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.operators import reports, state, users
from recollect.sources import archive

NOW = "2026-06-15 12:00:00"


def test_chained_merges_keep_everything(spark):
    u = spark.createDataFrame([("A", ["a"], .5, None, None), ("B", ["b"], .5, None, None), ("C", ["c"], .5, None, None)],
                              "uid string, names array<string>, confidence double, created_at timestamp, updated_at timestamp")
    i = spark.createDataFrame([(k, {"qq": [k.lower()]}, None, None, False, "x") for k in "ABC"],
                              "uid string, platform_ids map<string,array<string>>, first_seen timestamp, last_seen timestamp, verified boolean, source string")
    p = spark.createDataFrame([(k, [k.lower()], None) for k in "ABC"], "uid string, tags array<string>, known_ids array<string>")
    m = spark.createDataFrame([("B", "A"), ("C", "B")], "keep_uid string, drop_uid string")
    u2, i2, _ = users.merge(u, i, p, m, NOW)
    assert {r["uid"]: r["names"] for r in u2.collect()}["C"] == ["a", "b", "c"]
    assert [(r["uid"], r["platform_ids"]) for r in i2.collect()] == [("C", {"qq": ["a", "b", "c"]})]


@pytest.mark.parametrize("circle", [[("A", "B"), ("B", "A")], [("A", "B"), ("B", "C"), ("C", "A")]])
def test_merges_in_a_circle_are_refused(spark, circle):
    with pytest.raises(ValueError):
        users.final_keepers(spark.createDataFrame(circle, "keep_uid string, drop_uid string"), rounds=6)


def test_two_updates_of_a_key_stay_one_row(spark):
    rows = spark.createDataFrame([(1, "old", 0.1), (2, "two", 0.2)], "atom_id bigint, content string, importance double")
    ups = spark.createDataFrame([(1, "first", 0.9, 1), (1, "last", None, 2)], "atom_id bigint, content string, importance double, seq int")
    got = sorted(map(tuple, state.apply_updates(rows, ups, "atom_id", state.ATOM_FIELDS).collect()))
    assert got == [(1, "last", 0.9), (2, "two", 0.2)]


def test_two_vectors_of_a_person_stay_one_row(spark):
    p = spark.createDataFrame([("A", None, None, None)], "uid string, persona_embedding array<double>, embedding_model string, updated_at timestamp")
    v = spark.createDataFrame([("A", [1.0], 1), ("A", [0.5], 2)], "uid string, embedding array<double>, seq int")
    assert [r["persona_embedding"] for r in users.save_embeddings(p, v, "m", NOW).collect()] == [[0.5]]


def test_archive_keeps_lines_that_look_like_marks(spark, tmp_path):
    text = "before\n## entry 7\nafter\n\\## entry 8\nend"
    d = spark.createDataFrame([(1, "2026-06-01", text, True)], "diary_id bigint, date string, content string, archived boolean").withColumn("date", F.col("date").cast("date"))
    for _ in range(2):  # a second try replaces the first
        archive.export(d, str(tmp_path / "cold"), NOW)
    assert [tuple(r) for r in archive.read(spark, str(tmp_path / "cold")).collect()] == [(1, text)]


def test_dates_are_all_there(spark):
    d = spark.sql("SELECT date_add(DATE '2026-01-01', CAST(id AS INT)) AS date FROM range(150)")
    assert reports.dates(d).count() == 150 and reports.dates(d, 3).count() == 3
