"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.components import least_labels
from recollect.session import cut_lineage

# A node with more than this share of all links is joined by broadcast: fewer than 2,000 nodes at any size.
HOT_SHARE = 1 / 1000
# So many links are joined in one task: a bound on rows, whatever the table looks like.
TASK_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns ``a`` and ``b``); root is the least node reachable.

    Each round links the neighbours of a node to its least neighbour, first the larger
    ones, then the smaller ones, so hubs are never squared and the rounds grow with the
    logarithm of a component's size. Every round is checkpointed. The links of hubs stay in
    the tasks where they are; only those of other nodes are dealt by node. Up to
    ``TASK_LINKS`` links are joined in one task, without rounds. Links of a node with
    itself and repeated links are ignored; an empty table gives an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges)
    mark = _mark(edges)
    if mark[0] <= TASK_LINKS:
        return edges.groupBy(F.lit(0).alias("_one")).applyInPandas(_joined, "node bigint, root bigint")
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = max(mark[0] * HOT_SHARE, 1)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.where("v > u"), least, hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.coalesce(parts))  # unions add up their partitions
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, least, hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _joined(edges: pd.DataFrame) -> pd.DataFrame:
    names, code = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    return pd.DataFrame({"node": names, "root": names[least_labels(code[: len(edges)], code[len(edges) :], len(names))]})


def _with_least(edges: DataFrame, least: DataFrame, hot: float) -> DataFrame:
    """(u, v, m): ``edges`` with the ``m`` of their ``u``; hubs of over ``hot`` links by broadcast, the rest by shuffle."""
    hubs = F.broadcast(least.where(F.col("n") > hot).select("u", F.col("m").alias("_m")))
    marked = edges.join(hubs, "u", "left")
    usual = marked.where("_m IS NULL").join(least.where(F.col("n") <= hot).select("u", "m"), "u")
    return marked.where("_m IS NOT NULL").select("u", "v", F.col("_m").alias("m")).union(usual.select("u", "v", "m"))


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the link table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
