"""Nearest neighbours by several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import cut_lineage

CURVES, DIMS, BITS = 4, 8, 7  # curves; projected dimensions and bits of each: 56-bit keys
SAMPLE = 2_000  # vectors from which the grids and the window are fitted
PROBES = 200  # of these, how many are searched for
AIM = 0.97  # recall aimed at on the sample
CELLS = 32  # blocks of a curve at least
BLOCK_ROWS = 2_048  # rows of a block aimed at, up to MOST_CELLS blocks
MOST_CELLS = 4_096
SLICE_ROWS = 8_192  # rows and queries that meet in one task at most


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, dims) with ``bits`` bits a coordinate.

    Skilling's transform (2004): undo the excess of rotations and flips from the high bit
    down, Gray-encode, then interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Seeded projections, one per curve, with a grid fitted to a sample and shifted for each curve."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.dims = min(DIMS, dim)
        self.axes, self.low, self.step = [], [], []
        for _ in range(curves):
            q, _r = np.linalg.qr(rng.normal(size=(dim, dim)))
            axes = q[:, : self.dims]
            p = sample @ axes
            mid, spread = p.mean(axis=0), np.maximum(p.std(axis=0), 1e-12)
            # the middle six spreads on half of the grid, moved by a random part of the other half
            step = 6 * spread / (1 << (BITS - 1))
            self.axes.append(axes)
            self.step.append(step)
            self.low.append(mid - 3 * spread - rng.random(self.dims) * (1 << (BITS - 1)) * step)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(curves, n) keys."""
        out = []
        for axes, low, step in zip(self.axes, self.low, self.step):
            cell = np.clip((vectors @ axes - low) / step, 0, (1 << BITS) - 1)
            out.append(hilbert_index(cell.astype(np.int64), BITS))
        return np.array(out)


def fitted_share(curves: Curves, sample: np.ndarray, k: int, seed: int = 3) -> float:
    """Least share of all rows on either side of a query that gives the aimed recall on the sample.

    Neighbours inside a sample are farther away than in the whole table, so the share errs
    on the wide side there.
    """
    n = len(sample)
    if n <= k + 1:
        return 1.0
    probes = np.random.default_rng(seed).permutation(n)[:PROBES]
    d = ((sample[probes] ** 2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * sample[probes] @ sample.T)
    d[np.arange(len(probes)), probes] = np.inf
    near = np.argpartition(d, k, axis=1)[:, :k]
    place = np.argsort(np.argsort(curves.keys(sample), axis=1, kind="stable"), axis=1)
    away = np.abs(place[:, probes][:, :, None] - place[:, near]).min(axis=0) / n
    return float(np.quantile(away, AIM))


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _search(items: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest items of each asked vector, exact distances in double, ties to the smaller id."""
    if not len(items) or not len(asked):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    x, ids = np.stack(items["v"].to_numpy()).astype(np.float64), items["id"].to_numpy()
    out = []
    norm = (x * x).sum(axis=1)
    for a in range(0, len(asked), 256):
        part = asked.iloc[a : a + 256]
        q, qid = np.stack(part["v"].to_numpy()).astype(np.float64), part["id"].to_numpy()
        d = (q * q).sum(axis=1)[:, None] + norm[None] - 2 * q @ x.T
        d[qid[:, None] == ids[None]] = np.inf
        m = min(k, d.shape[1])
        edge = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
        slack = 1e-9 * ((q * q).sum(axis=1)[:, None] + norm.max())
        r, c = np.nonzero((d <= edge + slack) & np.isfinite(d))
        exact = np.sqrt(((q[r] - x[c]) ** 2).sum(axis=1))
        order = np.lexsort((ids[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, np.arange(len(q)))
        ok = np.arange(len(r)) - first[r] < k
        out.append(pd.DataFrame({"query_id": qid[r[ok]], "vec_id": ids[c[ok]], "score": exact[ok]}))
    return pd.concat(out)


def nearest(
    items: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
    curves: int = CURVES, share: float | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query by Euclidean distance.

    Every vector is placed on ``curves`` Hilbert curves through differently rotated and
    shifted grids of its projection. Each curve is range-partitioned by its key into blocks
    of similar size; a query is compared with the blocks within ``share`` of all rows on
    either side of its own key, and what the curves find is merged and reranked by exact
    distance. ``share`` is fitted on at most 2,000 vectors if not given; isotropic vectors
    need a wide one, clustered vectors a narrow one. Blocks of many rows and windows of many
    queries are dealt to several tasks by hash, so no task grows with the table.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components
    take no part; vectors of different lengths are never neighbours; rows with a repeated id
    are one item (least vector), null ids take no part; a query never finds its own id;
    fewer than ``k`` candidates give fewer rows; equal distances go to the smaller id; an
    empty table gives an empty result. Other columns are not read.
    """
    spark = items.sparkSession

    def slim(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        good = df.where(F.col(id_col).isNotNull() & _usable(v)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        return good.groupBy("id").agg(F.min("v").alias("v"))

    items, queries = slim(items), slim(queries)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = [(r[0], r[1]) for r in items.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1))).orderBy("d").collect()]
    found = None
    for dim, n in sizes:  # one length of vectors in any sane table
        part = _nearest_of_length(items.where(F.size("v") == dim), queries.where(F.size("v") == dim), n, k, curves, share)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _nearest_of_length(items: DataFrame, queries: DataFrame, n: int, k: int, curves: int, share: float | None) -> DataFrame:
    sample = np.array([r["v"] for r in items.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], np.float64)
    grid = Curves(sample, curves)
    share = fitted_share(grid, sample, k) if share is None else share

    def keyed(df: DataFrame) -> DataFrame:
        @F.pandas_udf("array<bigint>")
        def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(list(grid.keys(np.stack(b.to_numpy()).astype(np.float64)).T) if len(b) else [])

        # called non-deterministic so that the filter Spark infers from posexplode() does not run it a second time
        return df.withColumn("k", keys.asNondeterministic()("v")).select("id", "v", F.posexplode("k").alias("curve", "key"))

    placed = cut_lineage(keyed(items))
    asked = keyed(queries)
    cells = int(min(MOST_CELLS, max(CELLS, -(-n // BLOCK_ROWS))))
    at = [i / cells for i in range(1, cells)]
    cuts = {
        r["curve"]: np.array(r["c"], np.int64)
        for r in placed.groupBy("curve").agg(F.percentile_approx("key", at, 20 * cells).alias("c")).collect()
    }  # curves x cells numbers

    def celled(df: DataFrame) -> DataFrame:
        @F.pandas_udf("int")
        def cell(curve: pd.Series, key: pd.Series) -> pd.Series:
            c, y = curve.to_numpy(), key.to_numpy()
            out = np.zeros(len(y), np.int32)
            for u in np.unique(c):
                out[c == u] = np.searchsorted(cuts[u], y[c == u], side="left")
            return pd.Series(out)

        return df.withColumn("cell", cell("curve", "key")).drop("key")

    placed, asked = celled(placed), celled(asked)
    asked_n = queries.count()
    turns = max(1, -(-asked_n // SLICE_ROWS))  # slices of the queries
    full = placed.groupBy("curve", "cell").agg(F.count(F.lit(1)).alias("n"))
    slices = F.ceil(F.col("n") / SLICE_ROWS).cast("int")
    full = F.broadcast(full.select("curve", "cell", slices.alias("slices")))  # curves x cells rows
    reach = int(np.ceil(share * cells + 0.5))
    left = placed.join(full, ["curve", "cell"]).select(
        "curve", "cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("part"), "id", "v",
        F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"),
    )
    window = F.sequence(F.greatest(F.col("cell") - reach, F.lit(0)), F.least(F.col("cell") + reach, F.lit(cells - 1)))
    right = asked.select("id", "v", "curve", F.explode(window).alias("cell")).join(full, ["curve", "cell"]).select(
        "curve", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), "id", "v",
        F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int").alias("turn"),
    )
    by = ["curve", "cell", "part", "turn"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
        lambda a, b: _search(a, b, k), "query_id bigint, vec_id bigint, score double"
    )
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
