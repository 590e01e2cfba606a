"""Per-batch upkeep of stored tables, for ``writeStream.foreachBatch``.

A table is kept in hashed buckets. A batch reads and writes only the buckets that its
keys fall into, as a new version named by its batch id; the manifest, written last, says
which buckets a batch wrote. The newest version of a bucket before a batch is its old
state, so a replayed batch writes the same again and batch ids may have gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import graph, messages

Sink = Callable[[DataFrame, int], None]
Merge = Callable[[DataFrame, DataFrame], DataFrame]

BUCKETS = 64


def _versions(spark: SparkSession, root: str, before: int | None) -> list[tuple[int, int]]:
    """``(bucket, batch)`` of the newest version of each bucket, of batches before ``before`` if given: one row a bucket."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    rows = spark.read.schema("bucket int, batch bigint").parquet(f"{root}/manifest")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return [(r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max("batch")).collect()]


def _read(spark: SparkSession, root: str, schema: str, versions: Sequence[tuple[int, int]]) -> DataFrame:
    paths = [f"{root}/data/batch={batch}/bucket={bucket}" for bucket, batch in versions]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The kept table as of the last batch."""
    return _read(spark, root, schema, _versions(spark, root, None))


def superseded(spark: SparkSession, root: str) -> list[str]:
    """Folders of versions that no reader of the newest state needs: what a clean-up may remove."""
    newest = set(_versions(spark, root, None))
    if not newest:
        return []
    rows = spark.read.schema("bucket int, batch bigint").parquet(f"{root}/manifest").distinct().collect()
    return sorted(f"{root}/data/batch={batch}/bucket={bucket}" for bucket, batch in {(r[0], r[1]) for r in rows} - newest)


def _write(rows: DataFrame, root: str, batch_id: int, touched: Sequence[int]) -> None:
    """A version of the touched buckets, then the manifest; an emptied bucket is a folder without rows."""
    spark = rows.sparkSession
    for_all = spark.createDataFrame([(b,) for b in touched], "bucket int")
    filled = for_all.join(rows.withColumn("_here", F.lit(True)), "bucket", "left")
    # a bucket without rows keeps a row of nulls out of sight of the reader
    filled.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/batch={batch_id}")
    for_all.withColumn("batch", F.lit(batch_id).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/of={batch_id}")


def keep(batch: DataFrame, batch_id: int, root: str, schema: str, keys: Sequence[str], merge: Merge, buckets: int = BUCKETS) -> None:
    """Merges a batch into the table under ``root``: ``merge(old, new)`` sees whole keys, of the touched buckets only."""
    spark = batch.sparkSession
    where = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in batch.select(where.alias("b")).distinct().collect())  # at most ``buckets``
    if not touched:
        return
    inside = set(touched)
    stored = schema + ", _here boolean"
    old = _read(spark, root, stored, [v for v in _versions(spark, root, batch_id) if v[0] in inside]).filter("_here").drop("_here")
    _write(merge(old, batch).withColumn("bucket", where), root, batch_id, touched)


def rows_of(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table that :func:`keep` holds under ``root``."""
    return snapshot(spark, root, schema + ", _here boolean").filter("_here").drop("_here")


def retention_sink(root: str, schema: str, per_sender: int = 1000, buckets: int = BUCKETS) -> Sink:
    """Keeps the newest messages of every sender."""
    def run(batch: DataFrame, batch_id: int) -> None:
        columns = batch.sparkSession.createDataFrame([], schema).columns
        keep(batch.select(*columns), batch_id, root, schema, ["sender_id"],
             lambda old, new: messages.retain(old.unionByName(new), per_sender), buckets)
    return run


EDGE_STATE = "from_node string, to_node string, relation_type string, diary_id bigint, weight double"
NODE_STATE = "node_id string, name string, type string, count bigint, created_at timestamp, updated_at timestamp"


def graph_sink(root: str, users: DataFrame, now: str, buckets: int = BUCKETS) -> Sink:
    """Indexes new diaries into the entity graph."""
    def run(batch: DataFrame, batch_id: int) -> None:
        n, e = graph.index_diaries(batch, users)
        keep(n, batch_id, f"{root}/nodes", NODE_STATE, ["node_id"], lambda old, new: graph.upsert_nodes(old, new, now), buckets)
        keep(e, batch_id, f"{root}/edges", EDGE_STATE, ["from_node", "to_node", "relation_type"], graph.merge_edges, buckets)
    return run
