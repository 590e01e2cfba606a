"""Counts, timelines and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect import schemas
from recollect.operators.skew import top_n


def atom_stats(atoms: DataFrame) -> DataFrame:
    """Per user: total of any status, active total and active count per type."""
    active = F.col("status") == "active"
    per_type = [F.count_if(active & (F.col("atom_type") == t)).alias(t) for t in schemas.ATOM_TYPES]
    return atoms.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"), *per_type)


def timeline(atoms: DataFrame, top: int = 3) -> DataFrame:
    """Per user and date: count, mean importance, accesses and the most important texts."""
    rows = atoms.filter(F.col("status") == "active")
    exact = F.col("importance").cast("decimal(18,9)")  # the mean must not depend on the order of addition
    days = rows.groupBy("user_id", "diary_date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(exact), 2).cast("double").alias("avg_importance"),
        F.sum("access_count").alias("accesses"))
    best = top_n(rows.select("user_id", "diary_date", "atom_id", "importance", "content"), ["user_id", "diary_date"],
                 [F.desc("importance"), F.asc("atom_id")], top)
    texts = best.groupBy("user_id", "diary_date").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "atom_id", F.substring("content", 1, 100).alias("text")))).alias("top_atoms"))
    return days.join(texts, ["user_id", "diary_date"])


def day_atoms(atoms: DataFrame, user_id: str, date: str) -> DataFrame:
    return atoms.filter((F.col("user_id") == user_id) & (F.col("diary_date") == F.lit(date).cast("date"))
                        & (F.col("status") == "active")).orderBy(F.desc("importance"), "atom_id")


def graph_overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "key", "n")
    e = edges.filter(F.col("status") == "active").groupBy(F.col("relation_type").alias("key")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "key", "n")
    return n.unionByName(e)


def system(personas: DataFrame, diaries: DataFrame, atoms: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals: each table is aggregated to one number and the numbers are pivoted."""
    parts = [
        personas.agg(F.count_distinct("uid").alias("n")).select(F.lit("users").alias("k"), "n"),
        diaries.agg(F.count(F.lit(1)).alias("n")).select(F.lit("diaries").alias("k"), "n"),
        atoms.agg(F.count_if(F.col("status") == "active").alias("n")).select(F.lit("atoms").alias("k"), "n"),
        nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("k"), "n"),
        edges.agg(F.count_if(F.col("status") == "active").alias("n")).select(F.lit("edges").alias("k"), "n"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("users", "diaries", "atoms", "nodes", "edges")])


def lifecycle(atoms: DataFrame, diaries: DataFrame | None = None, user_id: str | None = None) -> DataFrame:
    rows = atoms if user_id is None else atoms.filter(F.col("user_id") == user_id)
    out = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    if diaries is not None:
        out = out.unionByName(diaries.agg(F.count_if("archived").alias("n")).select(F.lit("archived_diaries").alias("status"), "n"))
    return out


def months(diaries: DataFrame) -> DataFrame:
    return diaries.select(F.year("date").alias("year"), F.month("date").alias("month")).distinct().orderBy(
        F.desc("year"), F.desc("month"))


def dates(diaries: DataFrame, limit: int | None = None) -> DataFrame:
    """Dates that hold a diary: all of them, or the newest ``limit``, newest first."""
    all_ = diaries.select("date").distinct()
    return all_ if limit is None else all_.orderBy(F.desc("date")).limit(limit)


def today_counts(atoms: DataFrame, diaries: DataFrame, today: str) -> DataFrame:
    d = F.lit(today).cast("date")
    a = atoms.agg(F.count_if((F.col("status") == "active") & (F.col("diary_date") == d)).alias("atoms_today"))
    return a.withColumn("diaries", diaries.agg(F.count(F.lit(1)).alias("n")).scalar())


def social_edge_counts(edges: DataFrame) -> DataFrame:
    """Social edges touching each user."""
    e = edges.filter(F.col("relation_type").isin(*schemas.SOCIAL_RELATIONS))
    ends = e.select(F.col("from_user").alias("uid")).unionByName(e.select(F.col("to_user").alias("uid")))
    return ends.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))


def speaker_counts(transcripts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct speakers of ``[..] name: `` lines that are not the bot."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\[[^\]]+\] (.+?):\s"), F.lit(1))
    people = F.array_distinct(F.filter(F.transform(found, lambda n: F.trim(n)), lambda n: ~F.startswith(F.lower(n), F.lit("bot"))))
    return transcripts.withColumn("speakers", F.size(people))


def rebuild_candidates(diaries: DataFrame, links: DataFrame, atoms: DataFrame) -> DataFrame:
    """Diaries longer than 20 characters with at most one link, unless one active atom already sums them up."""
    n = links.groupBy("diary_id").agg(F.count(F.lit(1)).alias("links"))
    d = diaries.join(n, "diary_id", "left").withColumn("links", F.coalesce("links", F.lit(0))).filter(
        (F.col("links") <= 1) & (F.length("content") > 20))
    live = atoms.filter(F.col("status") == "active").select("atom_id", F.length("content").alias("_len"))
    held = links.join(live, "atom_id").groupBy("diary_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_len").alias("_len"))
    j = d.join(held, "diary_id", "left")
    summed = (F.col("_n") == 1) & (F.col("_len") < 0.8 * F.length("content"))
    return j.filter(~F.coalesce(summed, F.lit(False))).drop("_n", "_len")


def audit(atoms: DataFrame, index: DataFrame) -> DataFrame:
    """One row: stored and indexed atoms, id gaps, atoms without a date."""
    a = atoms.agg(F.count(F.lit(1)).alias("atoms"), F.max("atom_id").alias("max_id"),
                  F.count_if(F.col("diary_date").isNull()).alias("undated"))
    indexed = index.select("atom_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return a.withColumn("indexed", indexed).withColumn("id_gaps", F.col("max_id") > 1.5 * F.col("atoms"))
