"""Cold text export of diaries and the way back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = "## entry "


def export(diaries: DataFrame, path: str, now: str) -> None:
    """Diaries as text under ``year=/month=/date=``, entries in date and id order.

    Range partitioning keeps the order over files and lets a day with very many
    entries span several of them. A run writes its own folder and replaces what an
    earlier try of the same run left; text lines that look like an entry mark get a backslash.
    """
    day = F.col("date").cast("string")
    entry = F.concat(F.lit(_MARK), F.col("diary_id").cast("string"), F.lit("\nid: "), F.col("diary_id").cast("string"),
                     F.lit(f"\ndate: "), day, F.lit(f"\narchived_at: {now}\n---\n"), F.regexp_replace(F.regexp_replace("content", r"^\s+|\s+$", ""), f"(?m)^(\\\\*{_MARK})", r"\\$1"), F.lit("\n"))
    rows = diaries.repartitionByRange("date", "diary_id").sortWithinPartitions("date", "diary_id")
    rows.select(F.year("date").alias("year"), F.month("date").alias("month"), day.alias("date"), entry.alias("value")).write.mode(
        "overwrite").partitionBy("year", "month", "date").text(f"{path}/run={re.sub('[^0-9A-Za-z]+', '-', now)}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(diary_id, content)`` of an export; records are split at the entry mark, so large files stay splittable."""
    rows = spark.read.option("lineSep", "\n" + _MARK).text(path)
    whole = F.regexp_replace(F.col("value"), f"^{_MARK}", "")
    head = F.regexp_extract(whole, r"^(\d+)\n", 1).try_cast("bigint")
    cut = F.position(F.lit("\n---\n"), whole)
    body = F.regexp_replace(F.substring(whole, cut + 5, F.length(whole)), r"^\s+|\s+$", "")
    body = F.regexp_replace(body, f"(?m)^\\\\(\\\\*{_MARK})", "$1")
    return rows.select(head.alias("diary_id"), body.alias("content")).filter(F.col("diary_id").isNotNull())


def restore(diaries: DataFrame, exported: DataFrame) -> DataFrame:
    """Archived diaries get their exported text back and lose the flag."""
    e = exported.groupBy("diary_id").agg(F.max("content").alias("_full"))
    hit = F.col("archived") & F.col("_full").isNotNull()
    return diaries.join(e, "diary_id", "left").withColumn("content", F.when(hit, F.col("_full")).otherwise(F.col("content"))).withColumn(
        "archived", F.col("archived") & ~hit).drop("_full")


def unflag(diaries: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("diary_id", F.lit(True).alias("_u")).distinct()
    return diaries.join(hit, "diary_id", "left").withColumn("archived", F.col("archived") & F.col("_u").isNull()).drop("_u")
