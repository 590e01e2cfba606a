"""Tracing recalled facts back to the diary passages they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.functions.diary import body_of
from recollect.operators.skew import top_n


def best_segment(content: Column, words: Column, limit: int = 200) -> Column:
    """The sentence with the most keywords (first on ties) with its neighbours, cut to ``limit``."""
    def count(seg: Column, keys: Column) -> Column:
        return text.let(F.lower(seg), lambda low: F.size(F.filter(keys, lambda k: F.contains(low, k))))

    def around(segs: Column, counts: Column) -> Column:
        at = F.when(F.array_max(counts) > 0, F.array_position(counts, F.array_max(counts))).otherwise(F.lit(1)).cast("int")
        first = F.greatest(F.lit(1), at - 1)
        return F.array_join(F.slice(segs, first, F.least(F.size(segs), at + 1) - first + 1), "")

    def pick(segs: Column, keys: Column) -> Column:
        best = text.let(F.transform(segs, lambda s: count(s, keys)), lambda counts: around(segs, counts))
        chosen = F.when(F.size(keys) == 0, F.element_at(segs, 1)).otherwise(best)
        return F.when(F.size(segs) > 0, F.substring(chosen, 1, limit))

    return text.let(text.segments(body_of(content)), lambda segs: text.let(F.transform(words, F.lower), lambda keys: pick(segs, keys)))


def trace(ranked: DataFrame, atoms: DataFrame, links: DataFrame, diaries: DataFrame, queries: DataFrame, per_query: int = 2,
          said_keywords: int | None = 15) -> DataFrame:
    """``(query_id, diary_id, pos, date, snippet)`` of the best linked diaries of recalled atoms.

    A snippet is chosen by all keywords of the query and the first ``said_keywords`` of the fact.
    """
    hit = ranked.select("query_id", "atom_id").join(links.select("atom_id", "diary_id", "importance"), "atom_id")
    best = top_n(hit.groupBy("query_id", "diary_id").agg(F.max("importance").alias("imp")), ["query_id"],
                 [F.desc("imp"), F.asc("diary_id")], per_query, "pos")
    # which atom speaks is settled by lengths and ids; only the chosen texts are fetched
    sizes = atoms.select("atom_id", F.length("content").alias("_size"))
    speaker = hit.join(best, ["query_id", "diary_id"], "left_semi").join(sizes, "atom_id").groupBy("query_id", "diary_id").agg(
        F.max_by("atom_id", F.struct("_size", "importance", -F.col("atom_id"))).alias("atom_id"))
    said = speaker.join(atoms.select("atom_id", F.col("content").alias("said")), "atom_id").drop("atom_id")
    d = diaries.select("diary_id", "date", F.col("content").alias("diary"))
    rows = best.join(said, ["query_id", "diary_id"]).join(d, "diary_id").join(queries.select("query_id", "query"), "query_id")
    words = F.array_union(text.keywords(F.col("query")), text.keywords(F.col("said"), said_keywords))
    return rows.select("query_id", "diary_id", "pos", "date", best_segment(F.col("diary"), words).alias("snippet")).filter(
        F.col("snippet").isNotNull())
