"""Connected components of a pair graph, and work that needs a component whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import broadcast_if_small, cut_lineage

# Links that one task holds at most: a bound on rows, whatever the graph looks like.
TASK_LINKS = 200_000
# How often a round follows the parents before it contracts.
_JUMPS = 2


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` numbered nodes the least one it is linked with, directly or not."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; nodes have one root exactly if links join them.

    While there are more links than a task may hold, every node takes that neighbour as its
    parent whose hash is the least (itself, if its own is less), follows the parents twice
    and is contracted into what it finds; at least every second node goes in a round, and
    hashed order keeps a chain from pointing along itself. What is left is joined in one
    task. Each round is checkpointed. A hub costs no group of its own: minima are combined
    before the shuffle, and joins have one row a node on one side. Links of a node with
    itself are ignored; the root is some node of the component, not the least.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = dict(edges.dtypes)["a"]
    rounds: list[DataFrame] = []
    while edges.count() > TASK_LINKS:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        up = both.groupBy("a").agg(F.least(F.min(order("b")), order("a")).alias("m")).select(F.col("a").alias("node"), F.col("m.v").alias("parent"))
        up = cut_lineage(up)
        for _ in range(_JUMPS):
            above = up.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
            up = up.join(above, "parent").select("node", F.col("_above").alias("parent"))
        up = cut_lineage(up)
        rounds.append(up)
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias(end), F.col("parent").alias("_p")), end).drop(end).withColumnRenamed("_p", end)
        edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(pd.concat([pdf["a"], pdf["b"]], ignore_index=True))
        label = least_labels(code[: len(pdf)], code[len(pdf) :], len(names))
        return pd.DataFrame({"node": names, "root": names[label]})

    roots = edges.groupBy(F.lit(0).alias("_one")).applyInPandas(join, f"node {kind}, root {kind}")  # at most TASK_LINKS rows
    for up in reversed(rounds):
        roots = up.join(roots.select(F.col("node").alias("parent"), "root"), "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots


def per_component(
    edges: DataFrame, local: Callable[[pd.DataFrame], pd.DataFrame], schema: str, giants: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``local`` on the rows of whole components of ``edges(l_id, r_id, ...)``; ``giants`` on components no task may hold.

    Components are dealt to tasks by a hash of their root; ``local`` gets the edges of any
    number of whole components. ``giants`` gets those with more than ``TASK_LINKS`` edges,
    of which there are at most ``edges / TASK_LINKS``.
    """
    n = edges.count()
    if n <= TASK_LINKS:
        return edges.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda pdf: local(pdf), schema)
    roots = connected(edges.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")))
    marked = cut_lineage(edges.join(roots.withColumnsRenamed({"node": "l_id", "root": "_root"}), "l_id"))
    large = marked.groupBy("_root").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TASK_LINKS).select("_root")
    large = broadcast_if_small(cut_lineage(large))
    dealt = marked.join(large, "_root", "left_anti").withColumn("_deal", F.pmod(F.xxhash64("_root"), F.lit(4 * n // TASK_LINKS)))
    rest = cut_lineage(marked.join(large, "_root", "left_semi").drop("_root"))
    done = dealt.drop("_root").groupBy("_deal").applyInPandas(lambda pdf: local(pdf), schema)
    return done if rest.isEmpty() else done.unionByName(giants(rest))
