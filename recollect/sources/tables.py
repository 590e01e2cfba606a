"""Reading and writing the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schemas

SCHEMAS = {
    "atoms": schemas.ATOMS,
    "links": schemas.LINKS,
    "users": schemas.USERS,
    "identities": schemas.IDENTITIES,
    "personas": schemas.PERSONAS,
    "diaries": schemas.DIARIES,
    "sessions": schemas.SESSIONS,
    "messages": schemas.MESSAGES,
    "nodes": schemas.NODES,
    "edges": schemas.EDGES,
}


def load(spark: SparkSession, root: str, name: str, where: str | None = None) -> DataFrame:
    """One table of a snapshot directory; ``where`` reaches the parquet scan."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    df = reader.parquet(f"{root}/{name}")
    return df.filter(where) if where else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores when the input has fewer splits than cores.

    For heavy work per row (tokenising long texts) on few or unsplittable files; a
    table with enough splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def save(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write one table of a *new* snapshot directory (never the one being read)."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root}/{name}")


def with_new_ids(new: DataFrame, stored: DataFrame, id_col: str, order: tuple[str, ...]) -> DataFrame:
    """Dense ids after the stored maximum, numbered in ``order``.

    Rows are range-partitioned on ``order``; each partition counts its rows and
    starts after the counts of the earlier ones, so no single task numbers all.
    The ranged rows are cut from their lineage because both passes must see the
    same partitions.
    """
    from pyspark.sql import Window

    from recollect.session import cut_lineage

    ranged = cut_lineage(
        new.drop(id_col).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the window below is over partition counts, not data
    offsets = counts.select(
        "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_max"))
    start = top.select("_max").scalar()
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(id_col, start + F.col("_offset") + F.col("_pos") - F.col("_first") + 1)
        .drop("_part", "_pos", "_first", "_offset")
    )
