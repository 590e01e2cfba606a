"""Group operators that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this many kept rows per key, ranking runs in two stages over salted keys.
_ONE_STAGE_ROWS = 100
_SALTS = 32


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
) -> DataFrame:
    """First ``n`` rows per key with their 1-based rank.

    ``row_number() <= n`` lets Spark cut each map task to ``n`` rows per key
    before the shuffle. For a larger ``n`` the rows of a key are first ranked in
    salted slices, so the last task sees at most ``salts * n`` rows of a hot key.
    The order has to be total (end with an id) for a repeatable result.
    """
    if n > _ONE_STAGE_ROWS:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in _scalar_columns(df)]), F.lit(_SALTS))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= n)
            .drop("_r", "_salt")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def _scalar_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("bigint", "int", "string", "double")][:4]


def prefix_rank(
    df: DataFrame, key: str, id_col: str, rank: str = "rank", width: int = 1_000_000
) -> DataFrame:
    """``row_number() over (partition by key order by id)`` without one task per key.

    ``id_col`` is a unique integer, so a slice ``id div width`` holds at most
    ``width`` rows. Rows are numbered inside their slice and shifted by the number
    of rows in the key's earlier slices (a window over slice counts only).
    """
    sliced = df.withColumn("_slice", F.expr(f"{id_col} div {width}"))
    counts = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(key, "_slice").orderBy(id_col)
    return (
        sliced.withColumn("_r", F.row_number().over(local))
        .join(offsets, [key, "_slice"])
        .withColumn(rank, F.col("_offset") + F.col("_r"))
        .drop("_slice", "_r", "_offset")
    )


def ranked_in_slices(df: DataFrame, key: str, by: str, ties: Sequence[str], rank: str = "rank", width: int = 4_096) -> DataFrame:
    """``row_number() over (partition by key order by by, ties)`` for a whole number ``by`` that may repeat.

    Slices are runs of ``width`` values of ``by``. Rows are numbered inside their slice and
    shifted by the rows of the key's earlier slices (a window over slice counts only).
    """
    sliced = df.withColumn("_slice", F.floor(F.col(by) / F.lit(width)))
    counts = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(key, "_slice").orderBy(by, *ties)
    return sliced.withColumn("_r", F.row_number().over(local)).join(offsets, [key, "_slice"]).withColumn(
        rank, (F.col("_offset") + F.col("_r")).cast("int")).drop("_slice", "_r", "_offset")


def placed(df: DataFrame, order: Sequence[Column], place: str) -> DataFrame:
    """Adds ``place``, from 1: ``row_number() over (order by order)`` by ranges of the order and their counts."""
    from recollect.sources.tables import with_new_ids

    return with_new_ids(df, df.sparkSession.range(0).withColumnRenamed("id", place), place, tuple(order))
