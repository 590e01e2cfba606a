"""Retrieval over atoms, diaries and graph nodes for many queries at once.

Inputs keyed by ``query_id``; every operator returns ranked rows per query, so
routes can be fused by rank. Nothing here loops over queries on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.operators.skew import placed, ranked_in_slices, top_n
from recollect.session import BROADCAST_BYTES, broadcast_if_small, cut_lineage, estimated_bytes

# BM25 constants of the full-text index.
K1, B = 1.2, 0.75
# Tasks that the postings of one token are dealt to; (query, row) scores that one task adds up.
_TOKEN_PARTS, _TASK_SCORES = 64, 250_000
# Rows that are filled up from one array of a query.
_FILLERS = 10_000
# Share of the rows of the highest importance that are tried before all others.
_STRONG = 1 / 16
# Queries of a block, items of a slice: what one task multiplies at a time.
_VECTOR_BLOCK, _VECTOR_SLICE = 2048, 16384


# ---------------------------------------------------------------- index side


def postings(docs: DataFrame, doc_id: str, content: str, tokenizer: text.Tokenizer = text.words,
             vocabulary: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``(doc_id, token, tf, doc_len)``; with ``parts`` the rows of a document lie in one task.

    With a ``vocabulary`` only its tokens are exploded past the scan, so a query
    run shuffles a small part of the text. Without it the result is the index to
    write once, bucketed by token.
    """
    # length and token travel together, so a text is tokenised once
    sized = text.let(text.index_tokens(F.col(content), tokenizer), lambda t: F.transform(
        t, lambda w: F.struct(F.size(t).alias("doc_len"), w.alias("token"))))
    rows = docs.select(doc_id, F.inline(sized))
    if vocabulary is not None:
        rows = rows.join(broadcast_if_small(vocabulary.select("token").distinct()), "token", "left_semi")
    if parts is not None:
        rows = _dealt_by_row(rows, doc_id, parts)
    return rows.groupBy(doc_id, "token").agg(
        F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len")
    )


def corpus_stats(docs: DataFrame, content: str, tokenizer: text.Tokenizer = text.words) -> DataFrame:
    """One row: number of indexed rows and mean length."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg(F.size(text.index_tokens(F.col(content), tokenizer))).alias("avg_len"),
    )


def write_index(atoms: DataFrame, folder: str, batch: int = 0) -> None:
    """Keeps the postings and totals of a batch of rows under ``folder``, sorted by token; writing a batch again replaces it.

    A token goes to up to ``_TOKEN_PARTS`` files, so one that nearly every row holds is no single task.
    """
    part = F.pmod(F.xxhash64("atom_id"), F.lit(_TOKEN_PARTS))
    post = postings(atoms, "atom_id", "content").repartition(F.col("token"), part).sortWithinPartitions("token")
    post.write.mode("overwrite").parquet(f"{folder}/postings/batch={batch}")
    lengths = F.size(text.index_tokens(F.col("content")))
    atoms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(lengths), F.lit(0)).alias("len")).write.mode("overwrite").parquet(
        f"{folder}/totals/batch={batch}")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``index`` and ``stats`` of all batches kept under ``folder``, as the text routes and ``recall`` take them."""
    totals = spark.read.parquet(f"{folder}/totals")
    return {"index": spark.read.parquet(f"{folder}/postings").drop("batch"),
            "stats": totals.agg(F.sum("n").alias("n_docs"), (F.sum("len") / F.sum("n")).alias("avg_len"))}


def idf(df_col: Column, n_docs: Column) -> Column:
    raw = F.log((n_docs - df_col + 0.5) / (df_col + 0.5))
    return F.greatest(raw, F.lit(1e-6))


def term_weight(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def query_terms(queries: DataFrame, content: str = "query", limit: int | None = None,
                tokenizer: text.Tokenizer = text.words) -> DataFrame:
    """``(query_id, pos, token)`` keyword rows: all keywords, or the first ``limit`` of a query."""
    return queries.select(
        "query_id", F.posexplode(text.keywords(F.col(content), limit, tokenizer)).alias("pos", "token")
    )


# ---------------------------------------------------------------- BM25


def _asked_postings(docs: DataFrame, terms: DataFrame, doc_id: str, content: str, tokenizer: text.Tokenizer,
                    index: DataFrame | None, stats: DataFrame | None, parts: int | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Postings of the asked tokens (dealt by row, if to ``parts``), ``(query_id, token, df)`` and a struct of the corpus totals."""
    vocabulary = terms.select("token").distinct()
    if index is not None:
        post = index.join(broadcast_if_small(vocabulary), "token", "left_semi")
        post = post if parts is None else _dealt_by_row(post, doc_id, parts)
    else:
        post = postings(docs, doc_id, content, tokenizer, vocabulary, parts)
    st = stats if stats is not None else corpus_stats(docs, content, tokenizer)
    freq = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # query terms with their document frequency: at most one row per query keyword
    weighted = terms.select("query_id", "token").distinct().join(freq, "token")
    return post, weighted, st.select(F.struct("n_docs", "avg_len")).scalar()


def _bm25_sum(matches: DataFrame, doc_id: str, one: Column, *more: str) -> DataFrame:
    """``(query_id, doc_id, bm25)`` from ``matches`` of postings and weighted terms, rounded to 6 places."""
    w = idf(F.col("df"), one["n_docs"]) * term_weight(F.col("tf"), F.col("doc_len"), one["avg_len"])
    return matches.select("query_id", doc_id, *more, w.alias("w")).groupBy("query_id", doc_id, *more).agg(F.round(F.sum("w"), 6).alias("bm25"))


def bm25_scores(docs: DataFrame, terms: DataFrame, doc_id: str, content: str,
                tokenizer: text.Tokenizer = text.words, index: DataFrame | None = None,
                stats: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, bm25)`` of an OR query, rounded to 6 places.

    ``docs`` is every indexed row (statistics count dormant and forgotten rows
    too, because a soft delete leaves the index alone).

    Terms that can be broadcast meet the postings where these lie, dealt by row: a
    query's matches in a row are added up in one task, without a shuffle of matches.
    """
    asked = terms.select("query_id", "token").distinct()
    if estimated_bytes(asked) > BROADCAST_BYTES // 2:
        post, weighted, one = _asked_postings(docs, terms, doc_id, content, tokenizer, index, stats)
        return _bm25_sum(post.join(weighted, "token"), doc_id, one)
    scores = docs.count() * asked.select("query_id").distinct().count()
    post, weighted, one = _asked_postings(docs, terms, doc_id, content, tokenizer, index, stats, -(-scores // _TASK_SCORES))
    return _bm25_sum(post.join(F.broadcast(weighted), "token"), doc_id, one)


def _dealt_by_row(rows: DataFrame, doc_id: str, parts: int) -> DataFrame:
    """Rows of a document in one task, of at least ``parts``; few are left to the session's number."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(doc_id) if parts <= usual else rows.repartition(parts, doc_id)


def _strong(rows: DataFrame, by: str) -> DataFrame:
    """The rows of the highest ``by``, about a share of ``_STRONG``, and all that tie with the last."""
    edge = rows.agg(F.percentile_approx(by, 1 - _STRONG)).first()[0]
    return rows.filter(F.lit(False) if edge is None else F.col(by) >= F.lit(edge))


def _token_heads(post: DataFrame, owned: DataFrame, k: int, by_user: bool) -> DataFrame:
    """``(token, *owned)``: of each token's atoms (of each user's) the ``k`` of the highest ``score`` and all that tie with the last.

    Whatever orders equal scores, a query's first ``k`` lie among the heads of its tokens:
    fewer than ``k`` atoms of any of its tokens can score higher. A token with ``k`` atoms
    among the strongest of all has its heads there, so only the other tokens' postings meet all atoms.
    """
    def heads(post: DataFrame, owned: DataFrame) -> DataFrame:
        own = ["token", "user_id"] if by_user else ["token"]
        ranked = post.select("token", "atom_id").join(owned, "atom_id").withColumn(
            "_r", F.rank().over(Window.partitionBy(*own).orderBy(F.desc("score"))))
        return ranked.filter(F.col("_r") <= k).drop("_r")

    if by_user:
        return heads(post, owned)
    owned = cut_lineage(owned)
    first = cut_lineage(heads(post, broadcast_if_small(_strong(owned, "score"))))
    through = cut_lineage(first.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select("token"))
    rest = heads(post.join(broadcast_if_small(through), "token", "left_anti"), owned)
    return first.join(broadcast_if_small(through), "token", "left_semi").unionByName(rest)


def _important_first(atoms: DataFrame, terms: DataFrame, k: int, weight: float, query_users: DataFrame | None,
                     tokenizer: text.Tokenizer = text.words, index: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Mode ``reference`` of :func:`bm25_atoms`, ended early: only heads of tokens meet queries and are scored."""
    post, weighted, one = _asked_postings(atoms, terms, "atom_id", "content", tokenizer, index, stats)
    post = cut_lineage(post)
    weighted = cut_lineage(terms.select("query_id", "token").distinct().join(
        post.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token"))
    owned = atoms.filter(F.col("status") == "active").select("atom_id", "user_id", F.round(F.col("importance") * weight, 6).alias("score"))
    heads = _token_heads(post, owned, k, query_users is not None)
    cand = heads.join(weighted.select("query_id", "token"), "token").drop("token").distinct()
    if query_users is not None:
        cand = cand.join(query_users, ["query_id", "user_id"], "left_semi")
    # a query's heads again: of the candidates only the first k scores, with ties, can stay
    cand = cand.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("_r") <= k).drop("_r", "user_id")
    matches = cand.join(weighted, "query_id").join(post, ["token", "atom_id"])
    hits = _bm25_sum(matches, "atom_id", one, "score")
    return top_n(hits, ["query_id"], [F.desc("score"), F.desc("bm25"), F.asc("atom_id")], k).select("query_id", "atom_id", "rank", "score", "bm25")


def bm25_atoms(atoms: DataFrame, terms: DataFrame, k: int, mode: str = "reference",
               imp_weight: float = 0.6, rank_weight: float = 0.4, query_users: DataFrame | None = None,
               pool: int | None = None, **index) -> DataFrame:
    """Top ``k`` active atoms per query, importance blended with rank.

    Every match is considered; the modelled system looks at the best ``pool=3 * k`` by BM25 only.

    ``mode='reference'`` keeps the observable order of the modelled system, whose
    rank part is always zero (importance, then BM25); ``'normalized'`` divides by
    the best score. ``query_users(query_id, user_id)`` restricts to those users.
    In the first mode the search ends early, see :func:`_important_first`.
    """
    if mode == "reference" and pool is None:
        return _important_first(atoms, terms, k, imp_weight, query_users, **index)
    hits = bm25_scores(atoms, terms, "atom_id", "content", **index)
    live = atoms.filter(F.col("status") == "active").select("atom_id", "user_id", "importance")
    hits = hits.join(live, "atom_id")
    if query_users is not None:
        hits = hits.join(query_users, ["query_id", "user_id"], "left_semi")
    return _blend(_pool(hits, "atom_id", pool), k, "atom_id", F.col("importance"), mode, imp_weight, rank_weight, terms.select("query_id"))


def _pool(hits: DataFrame, doc_id: str, pool: int | None) -> DataFrame:
    """All hits, or the best ``pool`` of a query by BM25."""
    return hits if pool is None else top_n(hits, ["query_id"], [F.desc("bm25"), F.asc(doc_id)], pool, "_rank").drop("_rank")


def _blend(cand: DataFrame, k: int, doc_id: str, importance: Column, mode: str, wi: float, wr: float, asked: DataFrame | None = None) -> DataFrame:
    """``asked(query_id)`` tells whether one row a query can be broadcast."""
    if mode == "reference":
        score = importance * wi
    else:
        best = cand.groupBy("query_id").agg(F.max("bm25").alias("_best"))
        few = asked is not None and estimated_bytes(asked.distinct()) <= BROADCAST_BYTES // 2
        cand = cand.join(F.broadcast(best) if few else best, "query_id")
        score = importance * wi + F.col("bm25") / F.col("_best") * wr
    cand = cand.withColumn("score", F.round(score, 6))
    out = top_n(cand, ["query_id"], [F.desc("score"), F.desc("bm25"), F.asc(doc_id)], k)
    return out.select("query_id", doc_id, "rank", "score", "bm25")


def bm25_ranked(atoms: DataFrame, terms: DataFrame, limit: int | None = None, **index) -> DataFrame:
    """Rank-only form: all active matches by BM25, or the first ``limit`` per query.

    All matches of a query are ranked in slices of the score, so a query that matches
    every atom is no single task.
    """
    hits = bm25_scores(atoms, terms, "atom_id", "content", **index)
    live = atoms.filter(F.col("status") == "active").select("atom_id")
    order = [F.desc("bm25"), F.asc("atom_id")]
    hits = hits.join(live, "atom_id")
    if limit is not None:
        return top_n(hits, ["query_id"], order, limit)
    # descending score as an ascending whole number: the scores have six places
    turned = cut_lineage(hits.withColumn("_by", -F.round(F.col("bm25") * 1_000_000).cast("long")))
    return ranked_in_slices(turned, "query_id", "_by", ["atom_id"]).drop("_by")


def diary_prefix(diaries: DataFrame, queries: DataFrame, k: int = 5, mode: str = "reference",
                 pool: int | None = None) -> DataFrame:
    """Diaries containing, for every query term, a token that starts with it; ``pool`` as in :func:`bm25_atoms`.

    Tokens are expanded to their prefixes (no longer than the longest term) where the texts
    lie and meet the terms there. Only diaries that hold the rarest term of a query are scored.
    """
    q = queries.select("query_id", F.array_distinct(
        text.runs(F.lower("query"))).alias("_t"))
    q = q.filter(F.size("_t") > 0).select("query_id", F.size("_t").alias("n_terms"), F.explode("_t").alias("term"))
    terms = cut_lineage(q.select("term").distinct())
    longest = terms.agg(F.coalesce(F.max(F.length("term")), F.lit(1))).first()[0]
    held = diaries.select("diary_id", text.runs(F.lower("content")).alias("_t")).filter("_t IS NOT NULL")
    said = held.select("diary_id", "_t", F.size("_t").alias("doc_len"))
    # rows of one diary are one text
    twice = cut_lineage(diaries.groupBy("diary_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("diary_id").alias("_id"), F.lit(True).alias("_twice")))
    if not twice.isEmpty():
        marked = said.join(broadcast_if_small(twice), F.col("diary_id").eqNullSafe(F.col("_id")), "left")
        one_row = marked.filter("_twice").groupBy("diary_id").agg(F.flatten(F.collect_list("_t")).alias("_t"), F.first("doc_len").alias("doc_len"))
        said = marked.filter("_twice IS NULL").select(said.columns).unionByName(one_row)
    rows, told = diaries.agg(F.count(F.lit(1)), F.count("content")).first()
    lengths = said.agg(F.sum("doc_len")).first()[0] or 0
    one = F.struct(F.lit(rows).alias("n_docs"), F.lit(lengths / max(told, 1)).alias("avg_len"))

    def heads(tokens: Column) -> Column:
        return F.flatten(F.transform(tokens, lambda t: F.transform(
            F.sequence(F.lit(1), F.least(F.length(t), F.lit(longest))), lambda i: F.substring(t, F.lit(1), i))))

    def holding(wanted: DataFrame) -> DataFrame:
        """``(diary_id, term)``: the wanted terms that begin a token of a diary, once each, without a shuffle of the texts."""
        each = said.select("diary_id", F.explode(F.array_distinct(heads(F.array_distinct("_t")))).alias("term"))
        return each.join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi")

    freq = cut_lineage(holding(terms).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    known = cut_lineage(q.join(freq, "term"))
    # a hit holds the rarest term of its query; queries with a term that nothing begins with have none
    rarest = known.groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("_a"), F.count(F.lit(1)).alias("_k"), F.first("n_terms").alias("n_terms"))
    rarest = cut_lineage(rarest.filter("_k = n_terms").select("query_id", F.col("_a.term").alias("term")))
    cand = cut_lineage(holding(rarest).join(rarest, "term").select("query_id", "diary_id"))
    met = broadcast_if_small(cand.select("diary_id").distinct())
    # a phrase's frequency in a diary is the sum over the tokens the prefix covers
    per_term = said.join(met, "diary_id", "left_semi").select("diary_id", "doc_len", F.explode(heads(F.col("_t"))).alias("term")).join(
        broadcast_if_small(terms), "term", "left_semi").groupBy("term", "diary_id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
    w = idf(F.col("df"), one["n_docs"]) * term_weight(F.col("tf"), F.col("doc_len"), one["avg_len"])
    hits = (
        cand.join(known.withColumnRenamed("query_id", "_q"), F.col("query_id").eqNullSafe(F.col("_q"))).join(per_term, ["term", "diary_id"]).groupBy("query_id", "diary_id")
        .agg(F.round(F.sum(w), 6).alias("bm25"), F.count(F.lit(1)).alias("_n"), F.first("n_terms").alias("n_terms"))
        .filter(F.col("_n") == F.col("n_terms"))
    )
    hits = hits.join(diaries.select("diary_id", "importance"), "diary_id")
    imp = F.when(F.coalesce(F.col("importance"), F.lit(0.0)) == 0, 0.5).otherwise(F.col("importance"))
    return _blend(_pool(hits, "diary_id", pool), k, "diary_id", imp, mode, 0.6, 0.4)


# ---------------------------------------------------------------- containment


def containing(rows: DataFrame, row_id: str, content: Column, needles: DataFrame, needle: str = "token",
               names: bool = False) -> DataFrame:
    """``(row_id, needle)`` for rows whose text contains the needle (ASCII case-blind).

    In running text a needle is a word, so it can only lie inside one letter/digit
    run: the distinct runs are matched first, over a character-gram equi-join, and
    the texts then meet only the runs that matched, without being shuffled. Where every
    needle has a character beyond ASCII, only runs with one are looked at. With
    ``names`` the fields are short and taken whole, and a needle may hold any
    characters.
    """
    def beyond_ascii(c: Column) -> Column:
        return F.octet_length(c) > F.length(c)

    least = 1 if names else 2
    n = needles.select(needle).distinct().filter(F.length(needle) >= least).withColumn(
        "_folded", text.ascii_lower(F.col(needle))).withColumn("_g", F.substring("_folded", 1, 3))
    low = text.ascii_lower(content)
    parts = F.array(low) if names else F.array_distinct(text.runs(low))
    if not names and n.filter(~beyond_ascii(F.col(needle))).isEmpty():
        parts = F.when(beyond_ascii(content), F.array_distinct(F.filter(text.runs(low), beyond_ascii)))
    said = rows.select(row_id, F.explode(parts).alias("_run"))
    vocab = said.select("_run").distinct()
    grams = F.array_distinct(F.concat(*[text.overlapping(F.col("_run"), k) for k in range(least, 4)]))
    near = vocab.select("_run", F.explode(grams).alias("_g")).join(n, "_g")
    matched = cut_lineage(near.filter(F.contains("_run", "_folded")).select("_run", needle).distinct())
    return said.join(broadcast_if_small(matched), "_run").select(row_id, needle).distinct()


def keyword_route(atoms: DataFrame, terms: DataFrame, k: int, query_users: DataFrame | None = None, mode: str = "complete",
                  index: DataFrame | None = None, **stats) -> DataFrame:
    """ASCII keywords by the text index, other keywords by containment (+0.3 a hit), blended with importance.

    Every match counts; of atoms that only the index finds, and of atoms that hold other
    keywords, those that can be among a query's first ``k`` are scored. ``mode='reference'``
    cuts as the modelled system does: the ``k`` most important of the best ``3k`` by BM25,
    and ``k`` rows of any other keyword.
    """
    terms = terms.filter(F.length("token") >= 2).select("query_id", "token").distinct()
    ascii_terms = terms.filter(text.is_ascii_word(F.col("token")))
    other = terms.filter(~text.is_ascii_word(F.col("token")))
    live = atoms.filter(F.col("status") == "active")
    owned = live.select("atom_id", "user_id", "importance")
    like = containing(live, "atom_id", F.col("content"), other)
    if mode == "reference":
        fts = bm25_atoms(atoms, ascii_terms, k, query_users=query_users, pool=3 * k, index=index, **stats)
        like = like.join(owned, "atom_id")
        if query_users is None:
            # the cut does not depend on the query: take it once per keyword
            like = top_n(like, ["token"], [F.desc("importance"), F.asc("atom_id")], k).join(other, "token")
        else:
            each = like.join(other, "token").join(query_users, ["query_id", "user_id"], "left_semi")
            like = top_n(each, ["query_id", "token", "user_id"], [F.desc("importance"), F.asc("atom_id")], k)
    else:
        said = index if index is not None else atoms.select(
            "atom_id", F.explode(text.index_vocabulary(F.col("content"))).alias("token"))
        post = said.select("atom_id", "token").join(broadcast_if_small(ascii_terms.select("token").distinct()), "token", "left_semi")
        # rows of one atom are one text; the parts of a kept index hold other atoms
        post = cut_lineage(post if index is not None else post.distinct())
        like = like.join(other, "token").groupBy("query_id", "atom_id").agg(F.count(F.lit(1)).alias("_like"))
        like = _possible(cut_lineage(like), owned, k, query_users)
        # without a hit of the other kind the score is the importance: heads of tokens are enough
        heads = _token_heads(post, owned.withColumn("score", F.round("importance", 6)), k, query_users is not None)
        beside = like.select("query_id", "atom_id").join(ascii_terms, "query_id").join(post, ["token", "atom_id"])
        fts = heads.join(ascii_terms, "token").select("query_id", "atom_id").unionByName(beside.select("query_id", "atom_id")).distinct()
    both = fts.select("query_id", "atom_id", F.lit(True).alias("_fts"), F.lit(0).alias("_like")).unionByName(
        like.select("query_id", "atom_id", F.lit(False).alias("_fts"), "_like" if mode != "reference" else F.lit(1).alias("_like")))
    agg = both.groupBy("query_id", "atom_id").agg(F.bool_or("_fts").alias("_fts"), F.sum("_like").alias("_like")).join(owned, "atom_id")
    if query_users is not None:
        agg = agg.join(query_users, ["query_id", "user_id"], "left_semi")
    agg = agg.withColumn("score", _keyword_score(F.when(F.col("_fts"), F.col("importance")).otherwise(0.0)))
    return top_n(agg, ["query_id"], [F.desc("score"), F.desc("importance"), F.asc("atom_id")], k).select(
        "query_id", "atom_id", "rank", "score")


def _keyword_score(indexed: Column) -> Column:
    """Importance blended with the hits: ``indexed`` is the share of the text index."""
    return F.round(F.col("importance") * 0.7 + F.least(indexed + 0.3 * F.col("_like"), F.lit(1.0)) * 0.3, 6)


def _possible(like: DataFrame, owned: DataFrame, k: int, query_users: DataFrame | None) -> DataFrame:
    """The rows of ``like(query_id, atom_id, _like)`` whose score can be among a query's first ``k``, whatever the text index adds."""
    rows = like.join(owned, "atom_id")
    if query_users is not None:
        rows = rows.join(query_users, ["query_id", "user_id"], "left_semi")
    with_, without = _keyword_score(F.col("importance")), _keyword_score(F.lit(0.0))
    rows = cut_lineage(rows.select("query_id", "atom_id", "_like", F.least(with_, without).alias("_low"), F.greatest(with_, without).alias("_high")))
    edge = top_n(rows, ["query_id"], [F.desc("_low"), F.asc("atom_id")], k).filter(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("_low").alias("_edge"))
    # a query of fewer rows, or whose k-th has no importance, keeps all
    kept = rows.join(broadcast_if_small(cut_lineage(edge)), F.col("query_id").eqNullSafe(F.col("_q")), "left").filter("_edge IS NULL OR _high >= _edge")
    return cut_lineage(kept.select("query_id", "atom_id", "_like").distinct())


# ---------------------------------------------------------------- vectors


def vector_topk(items: DataFrame, queries: DataFrame, k: int, item_id: str, vec: str = "embedding",
                eps: float = 1e-10, floor: float | None = None, weight: str | None = None) -> DataFrame:
    """Exact cosine top ``k`` of ``items`` per query, ``(query_id, item_id, rank, score)``.

    With ``weight``, a column of the items, the order is by cosine times weight, which
    comes as a column ``weighted``.

    One block of queries is sent to the tasks, and items stay where they are. More
    queries meet the items in groups of (slice of the items, block of the queries) of
    bounded size. Either way one matrix product emits the ``k`` best of each query, so
    the shuffle behind it carries ``k`` rows per query and slice. Items of another
    dimension or with a vanishing norm are skipped.
    """
    q_type, id_type = dict(queries.dtypes)["query_id"], dict(items.dtypes)[item_id]
    asked = queries.select("query_id", F.col(vec).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    by = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    src = items.select(item_id, F.col(vec).cast("array<double>").alias("v"), by.alias("w")).filter("v IS NOT NULL")
    schema = f"query_id {q_type}, {item_id} {id_type}, score double, weighted double"
    blocks = max(1, -(-asked.count() // _VECTOR_BLOCK))
    if blocks == 1:
        held = asked.toPandas()  # at most one block

        def batches_of(batches):
            for pdf in batches:
                yield _best(pdf, held, item_id, k, eps, floor)

        found = src.mapInPandas(batches_of, schema)
    else:
        slices = max(1, -(-src.count() // _VECTOR_SLICE))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = src.select("*", F.pmod(F.xxhash64(item_id), F.lit(slices)).cast("int").alias("_s"), every(blocks).alias("_b"))
        right = asked.select("*", every(slices).alias("_s"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_b"))
        found = left.groupBy("_s", "_b").cogroup(right.groupBy("_s", "_b")).applyInPandas(
            lambda x, q: _best(x, q, item_id, k, eps, floor), schema)
    best = top_n(found, ["query_id"], [F.desc("weighted"), F.asc(item_id)], k)
    return best.select("query_id", item_id, "rank", "score", *(["weighted"] if weight else []))


def _best(items: pd.DataFrame, asked: pd.DataFrame, item_id: str, k: int, eps: float, floor: float | None) -> pd.DataFrame:
    """The ``k`` best items of each query by cosine rounded to six places times the item's weight, ties to the smaller id."""
    out = [pd.DataFrame({"query_id": [], item_id: [], "score": [], "weighted": []})]
    dims, asked_dims = items["v"].map(len).to_numpy(), asked["v"].map(len).to_numpy()
    for dim in np.intersect1d(dims, asked_dims):
        ids, x, own = _units(items[dims == dim], item_id, eps)
        qids, q, _ = _units(asked[asked_dims == dim], "query_id", eps)
        if not len(ids):
            continue
        order = np.unique(ids, return_inverse=True)[1]
        m = min(k, len(ids))
        for a in range(0, len(qids), 256):
            sims = q[a : a + 256] @ x.T
            score = np.round(sims if floor is None else np.maximum(sims, floor), 6)
            worth = score * own
            edge = np.partition(worth, len(ids) - m, axis=1)[:, len(ids) - m, None]
            r, c = np.nonzero(worth >= edge)
            by = np.lexsort((order[c], -worth[r, c], r))
            r, c = r[by], c[by]
            ok = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c = r[ok], c[ok]
            out.append(pd.DataFrame({"query_id": qids[a + r], item_id: ids[c], "score": score[r, c], "weighted": worth[r, c]}))
    return pd.concat(out[1:] or out)


def _units(rows: pd.DataFrame, key: str, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, unit vectors and weights (1 without a column ``w``)."""
    m = np.vstack(rows["v"].to_numpy()).astype(float)
    norm = np.linalg.norm(m, axis=1)
    ok = norm >= eps
    own = rows["w"].to_numpy() if "w" in rows else np.ones(len(rows))
    return rows[key].to_numpy()[ok], m[ok] / norm[ok, None], own[ok]


def vector_atoms(atoms: DataFrame, queries: DataFrame, k: int, user_id: str | None = None,
                 model: str | None = None, prefilter: bool = False) -> DataFrame:
    """Vector search over active atoms; ``prefilter`` keeps the ``20k`` most important rows first."""
    live = atoms.filter((F.col("status") == "active") & F.col("embedding").isNotNull())
    if user_id is not None:
        live = live.filter(F.col("user_id") == user_id)
    if model is not None:
        live = live.filter(F.col("embedding_model") == model)
    if prefilter:
        live = live.orderBy(F.desc("importance"), F.asc("atom_id")).limit(20 * k)
    return vector_topk(live, queries, k, "atom_id")


def vector_nodes(nodes: DataFrame, queries: DataFrame, k: int, newest: int | None = None, model: str | None = None) -> DataFrame:
    """Vector search over entity, topic and user nodes (all, or the ``newest``); negative similarities count as 0."""
    live = _searched(nodes)
    if model is not None:
        live = live.filter(F.col("embedding_model") == model)
    if newest is not None:
        live = live.orderBy(F.desc("updated_at"), F.asc("node_id")).limit(newest)
    return vector_topk(live, queries, k, "node_id", eps=1e-9, floor=0.0)


def _searched(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type").isin("entity", "topic", "user") & F.col("embedding").isNotNull())


# ---------------------------------------------------------------- graph routes


def nodes_of_keywords(nodes: DataFrame, terms: DataFrame, per_keyword: int | None = None) -> DataFrame:
    """``(token, node_id)``: nodes whose name or id contains a keyword, all or the first ``per_keyword`` by id."""
    kinds = nodes.filter(F.col("type").isin("entity", "user", "topic", "emotion"))
    # one text holding both fields; the separator cannot occur inside a keyword
    joined = F.concat_ws("\n", F.col("name"), F.col("node_id"))
    found = containing(kinds, "node_id", joined, terms.filter(F.length("token") >= 2), names=True)
    return found if per_keyword is None else top_n(found, ["token"], [F.asc("node_id")], per_keyword).select("node_id", "token")


def match_nodes(nodes: DataFrame, terms: DataFrame, per_keyword: int | None = None) -> DataFrame:
    """``(query_id, node_id)``: nodes whose name or id contains a keyword of the query."""
    found = nodes_of_keywords(nodes, terms, per_keyword)
    return found.join(terms.select("query_id", "token").distinct(), "token").select("query_id", "node_id").distinct()


def linked_diaries(mentions: DataFrame, heads: DataFrame, keys: list[str], newest: int | None = None) -> DataFrame:
    """Distinct diaries mentioned by the head nodes per key set, all or the ``newest``."""
    told = mentions.filter(F.col("diary_id") > 0).select(F.col("from_node").alias("node_id"), "diary_id")
    # a node that nearly every diary mentions would be one task's of a shuffle by node
    told = told.join(broadcast_if_small(heads.select("node_id").distinct()), "node_id", "left_semi").distinct()
    if newest is None and keys == ["node_id"]:
        return told
    if newest is None:
        return heads.join(told, "node_id").select(*keys, "diary_id").distinct()
    # the newest of a key set lie among the newest of each of its nodes
    told = top_n(told, ["node_id"], [F.desc("diary_id")], newest, "_newest").drop("_newest")
    hit = heads.join(told, "node_id")
    return top_n(hit.select(*keys, "diary_id").distinct(), keys, [F.desc("diary_id")], newest, "diary_rank")


def atoms_of_diaries(atoms: DataFrame, links: DataFrame, diaries: DataFrame, keys: list[str], k: int,
                     by: str = "link_importance") -> DataFrame:
    """The ``k`` best active atoms linked to the diaries of a key set, best link per atom, by link or atom importance."""
    live = atoms.filter(F.col("status") == "active").select("atom_id", F.col("importance").alias("atom_importance"))
    hit = diaries.select(*keys, "diary_id").join(links.select("atom_id", "diary_id", "importance"), "diary_id").join(live, "atom_id")
    best = hit.groupBy(*keys, "atom_id").agg(F.max("importance").alias("link_importance"), F.first("atom_importance").alias("atom_importance"))
    return top_n(best, keys, [F.desc(by), F.asc("atom_id")], k)


def _reach(atoms: DataFrame, links: DataFrame, mentions: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What graph routes over ``nodes(node_id)`` share, each read once.

    ``(node_id, node)`` numbers the nodes, ``(node, diary_id)`` are their mentions and
    ``(diary_id, atom_id, link_importance, atom_importance)`` the links of active atoms.
    """
    heads = cut_lineage(nodes.select("node_id").distinct().withColumn("node", F.monotonically_increasing_id()))
    told = mentions.filter(F.col("diary_id") > 0).select(F.col("from_node").alias("node_id"), "diary_id")
    told = cut_lineage(told.join(broadcast_if_small(heads), "node_id").select("node", "diary_id"))
    live = atoms.filter(F.col("status") == "active").select("atom_id", F.col("importance").alias("atom_importance"))
    linked = links.select("atom_id", "diary_id", F.col("importance").alias("link_importance")).join(live, "atom_id")
    return heads, told, cut_lineage(linked)


def _best_of_nodes(reach: tuple[DataFrame, DataFrame, DataFrame], nodes: DataFrame, k: int, by: str) -> DataFrame:
    """``(node_id, atom_id, link_importance, atom_importance, rank)``: the ``k`` best atoms of each of the ``nodes``.

    The strongest links are tried first, where the mentions lie. A node with ``k`` atoms
    among them is through; the mentions of the others, which are rare, meet all links.
    """
    heads, told, linked = reach
    heads = cut_lineage(heads.join(broadcast_if_small(nodes.select("node_id").distinct()), "node_id", "left_semi"))

    def found(heads: DataFrame, linked: DataFrame) -> DataFrame:
        mine = told.join(broadcast_if_small(heads.select("node")), "node", "left_semi")
        best = mine.join(broadcast_if_small(linked), "diary_id").groupBy("node", "atom_id").agg(
            F.max("link_importance").alias("link_importance"), F.max("atom_importance").alias("atom_importance"))
        return top_n(best, ["node"], [F.desc(by), F.asc("atom_id")], k)

    first = cut_lineage(found(heads, _strong(linked, by)))
    through = cut_lineage(first.filter(F.col("rank") == k).select("node"))
    rest = found(cut_lineage(heads.join(broadcast_if_small(through), "node", "left_anti")), linked)
    both = first.join(broadcast_if_small(through), "node", "left_semi").unionByName(rest)
    return both.join(broadcast_if_small(heads), "node").drop("node")


def graph_keyword_route(atoms: DataFrame, links: DataFrame, nodes: DataFrame, mentions: DataFrame, terms: DataFrame, k: int,
                        mode: str = "complete") -> DataFrame:
    """Atoms linked to diaries that mention the nodes a query names, by their best link.

    All nodes and diaries count. An atom among a query's ``k`` best is among the ``k``
    best of the node that gives its best link, so each node, then each keyword, is cut
    to ``k`` rows before queries are joined. ``mode='reference'`` takes ten nodes a
    keyword and the newest 30 diaries of a query.
    """
    if mode == "reference":
        diaries = linked_diaries(mentions, match_nodes(nodes, terms, 10), ["query_id"], 30)
        out = atoms_of_diaries(atoms, links, diaries, ["query_id"], k)
        return out.select("query_id", "atom_id", "rank", F.round("link_importance", 6).alias("score"))
    named = cut_lineage(nodes_of_keywords(nodes, terms))
    return _graph_keyword(_reach(atoms, links, mentions, named), named, terms, k)


def _graph_keyword(reach: tuple[DataFrame, DataFrame, DataFrame], named: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """:func:`graph_keyword_route` over all of the nodes ``named(node_id, token)``."""
    order = [F.desc("score"), F.asc("atom_id")]
    per_node = _best_of_nodes(reach, named, k, "link_importance")
    best = F.max("score").alias("score")
    reached = named.join(per_node.select("node_id", "atom_id", F.round("link_importance", 6).alias("score")), "node_id")
    per_token = top_n(reached.groupBy("token", "atom_id").agg(best), ["token"], order, k).drop("rank")
    asked = terms.select("query_id", "token").distinct()
    return top_n(per_token.join(asked, "token").groupBy("query_id", "atom_id").agg(best), ["query_id"], order, k).select(
        "query_id", "atom_id", "rank", "score")


def graph_vector_route(atoms: DataFrame, links: DataFrame, nodes: DataFrame, mentions: DataFrame, queries: DataFrame,
                       k: int, nearest: int | None = None, mode: str = "complete") -> DataFrame:
    """Atoms of near nodes by similarity times importance, best node per atom; nodes of similarity 0 are not near.

    All nodes count: they are searched in the order of similarity times their most
    important atom, a block at a time, until that product falls below a query's ``k``-th
    score; only queries that are not through go on to a block four times as large. A
    node's ``k`` most important atoms hold its share of any query's best ``k``.
    ``nearest`` stops at so many nodes by similarity; ``mode='reference'`` at ``3k`` of the
    newest 500, with three atoms from the newest 30 diaries of each.
    """
    order = [F.desc("score"), F.asc("atom_id")]
    if mode == "reference" or nearest is not None:
        cut = mode == "reference"
        near = vector_nodes(nodes, queries, nearest or 3 * k, 500 if cut else None).select("query_id", "node_id", F.col("score").alias("sim"))
        near = cut_lineage(near if cut else near.filter(F.col("sim") > 0))
        # diaries and atoms of a node do not depend on the query: do each node once
        diaries = linked_diaries(mentions, near.select("node_id").distinct(), ["node_id"], 30 if cut else None)
        per = atoms_of_diaries(atoms, links, diaries, ["node_id"], 3 if cut else k, "link_importance" if cut else "atom_importance")
        eff = near.join(per, "node_id").groupBy("query_id", "atom_id").agg(F.max(F.col("sim") * F.col("atom_importance")).alias("score"))
        eff = eff.withColumn("score", F.round("score", 6)) if cut else eff
        return top_n(eff, ["query_id"], order, k).select("query_id", "atom_id", "rank", F.round("score", 6).alias("score"))
    kinds = _searched(nodes)
    return _graph_vector(_reach(atoms, links, mentions, kinds), kinds, queries, k)


def _graph_vector(reach: tuple[DataFrame, DataFrame, DataFrame], kinds: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """:func:`graph_vector_route` over all nodes of ``kinds``."""
    order = [F.desc("score"), F.asc("atom_id")]
    per = cut_lineage(_best_of_nodes(reach, kinds, k, "atom_importance").select("node_id", "atom_id", "atom_importance", "rank"))
    first = per.filter("rank = 1").select("node_id", F.col("atom_importance").alias("_top"))
    heads = cut_lineage(kinds.join(first, "node_id").select("node_id", "embedding", "_top"))
    total, open_, block, through = heads.count(), queries, 3 * k, []
    while True:
        near = vector_topk(heads, open_, block, "node_id", eps=1e-9, floor=0.0, weight="_top").filter(F.col("score") > 0)
        near = cut_lineage(near)
        eff = near.join(per.drop("rank"), "node_id").groupBy("query_id", "atom_id").agg(F.max(F.col("score") * F.col("atom_importance")).alias("score"))
        found = cut_lineage(top_n(eff, ["query_id"], order, k))
        if block >= total:
            through.append(found)
            break
        kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
        last = near.filter(F.col("rank") == block).select("query_id", F.col("weighted").alias("_last"))
        more = cut_lineage(last.join(kth, "query_id", "left").filter("_kth IS NULL OR _last >= _kth").select("query_id"))
        through.append(found.join(more, "query_id", "left_anti"))
        if more.isEmpty():
            break
        open_, block = open_.join(more, "query_id", "left_semi"), block * 4
    out = through[0]
    for t in through[1:]:
        out = out.unionByName(t)
    return out.select("query_id", "atom_id", "rank", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- fusion


def rrf(routes: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked ``(query_id, atom_id, rank)`` lists."""
    union = routes[0].select("query_id", "atom_id", "rank")
    for r in routes[1:]:
        union = union.unionByName(r.select("query_id", "atom_id", "rank"))
    fused = union.groupBy("query_id", "atom_id").agg(
        F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"), F.min("rank").alias("_best"))
    return top_n(fused, ["query_id"], [F.desc("score"), F.asc("_best"), F.asc("atom_id")], k).select(
        "query_id", "atom_id", "rank", "score")


def multi_route(atoms: DataFrame, links: DataFrame, nodes: DataFrame, mentions: DataFrame, terms: DataFrame,
                query_vectors: DataFrame | None, k: int, doc_routes: Sequence[DataFrame] = (), graph_routes: Sequence[DataFrame] = (),
                **index) -> DataFrame:
    """Document routes and graph routes fused inside each family, then across.

    A route yields at most ``2k`` rows per query; each is cut from its lineage, so
    the fusion steps that read it several times do not run it again. The graph routes
    read the mentions and links once between them. A caller's own
    routes, ``(query_id, atom_id, rank)`` in ``doc_routes`` and ``graph_routes``, join
    their family; of each query's rows the first ``2k`` count.
    """
    terms = cut_lineage(terms)
    doc = [keyword_route(atoms, terms, 2 * k, **index)]
    named = cut_lineage(nodes_of_keywords(nodes, terms))
    asked_nodes = named.select("node_id")
    if query_vectors is not None:
        kinds = cut_lineage(_searched(nodes))
        asked_nodes = asked_nodes.unionByName(kinds.select("node_id"))
    reach = _reach(atoms, links, mentions, asked_nodes)
    graph = [_graph_keyword(reach, named, terms, 2 * k)]
    if query_vectors is not None:
        asked = query_vectors.join(terms.select("query_id").distinct(), "query_id", "left_semi")
        doc.append(vector_atoms(atoms, asked, 2 * k))
        graph.append(_graph_vector(reach, kinds, asked, 2 * k))
    doc += [r.filter(F.col("rank") <= 2 * k) for r in doc_routes]
    graph += [r.filter(F.col("rank") <= 2 * k) for r in graph_routes]
    doc, graph = [cut_lineage(r) for r in doc], [cut_lineage(r) for r in graph]
    return rrf([rrf(doc, k), rrf(graph, k)], k)


def backfill(ranked: DataFrame, atoms: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    """Fill each query up to ``k``, or with all, of the globally most important active atoms.

    Many fillers are placed once for all queries, and a query's rows are numbered in slices
    of these places, so neither the fillers nor a query's rows are one task's.
    """
    live = atoms.filter(F.col("status") == "active")
    if k is None or k > _FILLERS:
        return _backfill_many(ranked, live, queries, k)
    best = live.orderBy(F.desc("importance"), F.desc("atom_id")).limit(k).select(
        "atom_id", F.col("importance"))
    # at most k rows, so one pair per (query, filler) is k rows a query
    filler = best.agg(F.collect_list(F.struct("importance", "atom_id")).alias("f"))
    each = queries.select("query_id").withColumn("f", filler.select("f").scalar()).select("query_id", F.inline("f"))
    extra = each.join(ranked.select("query_id", "atom_id"), ["query_id", "atom_id"], "left_anti")
    both = ranked.select("query_id", "atom_id", F.lit(0).alias("_src"), F.col("rank").cast("double").alias("_o")).unionByName(
        extra.select("query_id", "atom_id", F.lit(1).alias("_src"), (-F.col("importance")).alias("_o")))
    return top_n(both, ["query_id"], [F.asc("_src"), F.asc("_o"), F.desc("atom_id")], k).select("query_id", "atom_id", "rank")


def _backfill_many(ranked: DataFrame, live: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    best = live.select("atom_id", "importance")
    n = best.count()
    best = best if k is None or n <= k else best.orderBy(F.desc("importance"), F.desc("atom_id")).limit(k)
    best = placed(best, [F.desc_nulls_first("importance"), F.desc("atom_id")], "_by").select("atom_id", "_by")
    asked = queries.select("query_id")
    # fillers are dealt before they meet the queries, so that their product is
    fillers = n if k is None else min(n, k)
    dealt = best.repartition(max(1, -(-fillers * asked.count() // _TASK_SCORES)), "atom_id")
    each = dealt.crossJoin(broadcast_if_small(asked))
    extra = each.join(broadcast_if_small(ranked.select("query_id", "atom_id")), ["query_id", "atom_id"], "left_anti")
    first = F.col("rank").cast("bigint") - F.lit(1 << 40)  # before all fillers
    both = ranked.select("query_id", "atom_id", first.alias("_by")).unionByName(extra.select("query_id", "atom_id", "_by"))
    keyed = both.withColumn("_q", F.struct("query_id"))  # a query without an id is one as well
    numbered = ranked_in_slices(keyed, "_q", "_by", [F.desc("atom_id")])
    return (numbered if k is None else numbered.filter(F.col("rank") <= k)).select("query_id", "atom_id", "rank")


def friend_weights(edges: DataFrame) -> DataFrame:
    """``(uid, friend, weight)`` in both directions, largest raw weight of a ``friend_of`` edge."""
    f = edges.filter(F.col("relation_type") == "friend_of").select("from_user", "to_user", "weight")
    both = f.select(F.col("from_user").alias("uid"), F.col("to_user").alias("friend"), "weight").unionByName(
        f.select(F.col("to_user").alias("uid"), F.col("from_user").alias("friend"), "weight"))
    return both.groupBy("uid", "friend").agg(F.max("weight").alias("weight"))


def social_rerank(ranked: DataFrame, atoms: DataFrame, queries: DataFrame, edges: DataFrame, k: int | None, alpha: float = 0.3) -> DataFrame:
    """Relevance by position times ``1 + alpha * tie`` (self 1, friend weight, else 0).

    Every ranked row is scored; ``k`` is how many of each query come back, ``None`` all of them.
    """
    owner = atoms.select("atom_id", F.col("user_id").alias("owner"))
    size = ranked.groupBy("query_id").agg(F.max("rank").alias("n"))
    who = queries.select("query_id", F.col("user_id").alias("uid"))
    # a query's or a user's rows are not gathered if these tables are small
    few = estimated_bytes(who) <= BROADCAST_BYTES // 2
    small = F.broadcast if few else (lambda d: d)
    rows = ranked.select("query_id", "atom_id", "rank").join(small(size), "query_id").join(owner, "atom_id").join(small(who), "query_id")
    asked = queries.select(F.col("user_id").alias("uid")).distinct()
    ties = cut_lineage(friend_weights(edges).join(asked, "uid", "left_semi").withColumnRenamed("friend", "owner"))
    rows = rows.join(broadcast_if_small(ties), ["uid", "owner"], "left")
    relevance = F.when(F.col("n") > 1, 1.0 - (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(1.0)
    tie = F.when(F.col("uid") == "", 0.0).when(F.col("owner") == F.col("uid"), 1.0).otherwise(F.coalesce("weight", F.lit(0.0)))
    rows = rows.withColumn("score", F.round(relevance * (1.0 + alpha * tie), 6)).withColumn("_pos", F.col("rank")).drop("rank")
    if k is None:
        # a query's rows are numbered in slices of their score, the highest first
        keyed = rows.withColumn("_q", F.struct("query_id")).withColumn("_by", F.round(F.col("score") * -1_000_000).cast("bigint"))
        return ranked_in_slices(keyed, "_q", "_by", [F.asc("_pos")]).select("query_id", "atom_id", "rank", "score")
    return top_n(rows, ["query_id"], [F.desc("score"), F.asc("_pos")], k).select("query_id", "atom_id", "rank", "score")
