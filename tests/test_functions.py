"""Value tables for the column functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recollect.functions import diary, facts, text, times
from recollect.operators import lifecycle, quality

NOW = "2024-02-01 10:00:00"  # a Thursday


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(*[e.alias(f"x{i}") for i, e in enumerate(exprs)]).first()


@pytest.mark.parametrize("fact, kind, confidence", [
    ("明天下午去开会", "planned", 0.85),
    ("昨天讨论了方案", "episodic", 0.80),
    ("用户喜欢喝咖啡", "preference", 0.82),
    ("他们是同事", "relational", 0.80),
    ("北京是首都", "factual", 0.78),
    ("做了一件事", "episodic", 0.75),
    ("一个词", "factual", 0.65),
])
def test_classify(spark, fact, kind, confidence):
    got = one(spark, fact, facts.classify(F.col("c")))[0]
    assert (got["atom_type"], got["confidence"]) == (kind, confidence)


@pytest.mark.parametrize("fact, when", [
    ("今天见面", dt.datetime(2024, 2, 1, 10)),
    ("昨天见面", dt.datetime(2024, 1, 31, 10)),
    ("明天见面", dt.datetime(2024, 2, 2, 10)),
    ("大后天见面", dt.datetime(2024, 2, 3, 10)),
    ("周五见面", dt.datetime(2024, 2, 2, 10)),
    ("下周五见面", dt.datetime(2024, 2, 2, 10)),
    ("下周周五见面", dt.datetime(2024, 2, 9, 10)),
    ("上周见面", dt.datetime(2024, 1, 25, 10)),
    ("5月30日见面", dt.datetime(2024, 5, 30)),
    ("1月3日见面", dt.datetime(2025, 1, 3)),
    ("2月31日见面", None),
    ("随便说了一句话", None),
    ("", None),
])
def test_event_time(spark, fact, when):
    assert one(spark, fact, facts.event_time(F.col("c"), NOW))[0] == when


@pytest.mark.parametrize("kind, ttl, age, low, high", [
    ("exponential", 30, 15, .499, .501), ("linear", 30, 15, .5, .5), ("step", 30, 25, 1, 1), ("step", 30, 30, 1, 1),
    ("step", 30, 31, .05, .05), ("linear", 30, 60, 0, 0), ("linear", 0, .5, .5, .5), ("linear", 30, -5, 1, 1), ("exponential", 30, 365, 1e-12, .01),
    ("other", 30, 15, .499, .501),
])
def test_decay(spark, kind, ttl, age, low, high):
    got = one(spark, kind, lifecycle.decay_score(F.col("c"), F.lit(float(ttl)), F.lit(float(age))))[0]
    assert low <= got <= high


@pytest.mark.parametrize("kind, importance, ttl, days, decay", [
    ("episodic", .5, 0, 30, "exponential"), ("factual", 1.0, 0, 270, "exponential"), ("planned", .5, 0, 7, "step"),
    ("relational", .5, 0, 90, "linear"), ("episodic", .5, 10, 10, "exponential"), ("episodic", 7.0, 10, 15, "exponential"),
])
def test_expiry(spark, kind, importance, ttl, days, decay):
    s, d = one(spark, kind, lifecycle.ttl_seconds(F.col("c"), F.lit(importance), F.lit(float(ttl))), lifecycle.type_decay(F.col("c")))
    assert (s, d) == (days * 86400, decay)


def test_keywords(spark):
    k = lambda t: one(spark, t, text.keywords(F.col("c")))[0]
    assert k("Hello WORLD hello") == ["hello", "world"]
    assert k("测试框架") == ["测试", "试框", "框架"]
    assert k("a b") == ["a", "b"]
    assert k("什么 x") == ["x"]
    many = " ".join(f"w{i}" for i in range(40))
    assert len(k(many)) == 40
    assert len(one(spark, many, text.keywords(F.col("c"), 15))[0]) == 15


def test_tokens(spark):
    t = lambda s: one(spark, s, text.index_tokens(F.col("c")), text.token_set(F.col("c")), text.bigram_set(F.col("c")))
    assert t("Go go a 用户 x1")[0] == ["go", "go", "用户", "x1"]
    assert t("a b c d")[0] == ["ab", "bc", "cd"]
    assert t("a b c d")[1] == ["ab", "bc", "cd"]
    assert t("a b")[1] is None
    assert t("abab")[2] == ["ab", "ba"]
    assert t("été déjà")[0] == ["été", "déjà"]


def test_names_and_links(spark):
    got = one(spark, "见 [[ A b ]] 和 [[C]] [[ A b ]]", text.wikilinks(F.col("c")))[0]
    assert got == ["A b", "C"]
    assert one(spark, " Big（X）：  Y ", text.canonical_name(F.col("c")))[0] == "big(x):_y"


def test_front_matter(spark):
    c = "---\ndate: 2024-01-05\nmood: \"happy\"\ntopics: [\"x\", \"y\"]\nplaces:\n- a\n- 'b c'\n---\n\nbody\n"
    fm, body, inline, block = one(spark, c, diary.front_matter(F.col("c")), diary.body_of(F.col("c")), diary.front_list(F.col("c"), "topics"), diary.front_list(F.col("c"), "places"))
    assert fm["date"] == "2024-01-05" and fm["mood"] == "happy"
    assert body == "body" and inline == ["x", "y"] and block == ["a", "b c"]
    fm, body = one(spark, "---\nbroken", diary.front_matter(F.col("c")), diary.body_of(F.col("c")))
    assert fm == {} and body == "---\nbroken"


def test_moods(spark):
    s, m, l = one(spark, " Angry ", diary.mood_to_sentiment(F.col("c")), diary.sentiment_to_mood(F.lit("positive")), diary.mood_label(F.col("c")))
    assert (s, m, l) == ("negative", "happy", "生气")


def test_times(spark):
    at = lambda t: times.message_tag(F.lit(t).cast("timestamp"), NOW)
    assert list(one(spark, "", at("2024-02-01 09:05:00"), at("2024-01-30 09:05:00"), at("2024-01-01 00:00:00"))) == ["[09:05]", "[01-30 09:05]", "[01-01]"]
    tag = lambda d: times.date_tag(F.lit(d), NOW)
    assert list(one(spark, "", tag("2024-02-01"), tag("2024-01-31"), tag("2023-12-05"), tag("soon"))) == ["今日", "昨天", "12-05", "soon"]
    assert list(one(spark, "2026/6/1", times.normal_date(F.col("c")), times.epoch_seconds(F.lit("1970-01-01T00:01:00Z")), times.epoch_seconds(F.lit("12.5")))) == ["2026-06-01", 60.0, 12.5]


def test_quality(spark):
    g, r = quality.has_generic_terms(F.col("c")), quality.has_real_name(F.col("c"))
    assert one(spark, "The User said", g)[0] and not one(spark, "Anna said", g)[0]
    assert one(spark, "张三说好", r)[0] and not one(spark, "hello", r)[0]
    q = lambda *a: one(spark, "", quality.atoms_quality(F.array(*[F.lit(x) for x in a]).cast("array<string>")))[0]
    assert q("long enough") == "normal" and q("abc") == "low" and q() == "low"
