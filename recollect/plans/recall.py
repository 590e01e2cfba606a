"""End-to-end recall: many requests in, ranked atoms with provenance and prompt text out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators import search
from recollect.session import cut_lineage


def recall(queries: DataFrame, atoms: DataFrame, links: DataFrame, nodes: DataFrame, mentions: DataFrame,
           edges: DataFrame, query_vectors: DataFrame | None = None, k: int = 5, candidates: int = 50, **index) -> DataFrame:
    """``queries(query_id, user_id, query)`` to ``(query_id, atom_id, rank, score)``."""
    asked = queries.filter(F.length(F.trim("query")) > 0)
    terms = search.query_terms(asked)
    fused = cut_lineage(search.multi_route(atoms, links, nodes, mentions, terms, query_vectors, candidates, **index))
    filled = search.backfill(fused, atoms, asked, candidates)
    return cut_lineage(search.social_rerank(cut_lineage(filled), atoms, asked, edges, k))


def hybrid(queries: DataFrame, diaries: DataFrame, k: int = 5, **recall_args) -> DataFrame:
    """Recalled atoms and found diaries side by side, tagged by ``kind``."""
    a = recall(queries, k=k, **recall_args).select("query_id", F.lit("atom").alias("kind"), F.col("atom_id").alias("id"), "rank")
    d = search.diary_prefix(diaries, queries, k).select("query_id", F.lit("diary").alias("kind"), F.col("diary_id").alias("id"), "rank")
    return a.unionByName(d)


def by_keywords(requests: DataFrame, **recall_args) -> DataFrame:
    """Recall for keyword lists: ``requests(query_id, user_id, keywords ARRAY<STRING>)``."""
    q = requests.select("query_id", "user_id", F.array_join("keywords", " ").alias("query"))
    return recall(q, **recall_args)


def widened_queries(requests: DataFrame, messages: DataFrame, last_n: int) -> DataFrame:
    """Query text from the session's last messages plus the current text."""
    from recollect.operators.messages import last_contents

    ctx = last_contents(messages, last_n)
    return requests.join(ctx, "session_id", "left").withColumn(
        "query", F.trim(F.concat_ws(" ", F.col("context"), F.col("query")))).drop("context")


def agent_view(ranked: DataFrame, atoms: DataFrame) -> DataFrame:
    """What an agent tool sees of recalled atoms, with importance as a percentage."""
    a = atoms.select("atom_id", "content", "atom_type", "importance", "diary_date", "confidence")
    pct = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("importance") * 100))
    return ranked.join(a, "atom_id").withColumn("score_percentage", F.round(pct, 6))
