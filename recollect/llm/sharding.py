"""Proportional stratified interleaving: every shard gets the mixture of the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows that one ranking slice should hold, and the least number of slices.
SLICE_ROWS = 100_000
LEAST_SLICES = 64


def _numbered(df: DataFrame, group: list[str], part: str, order: list[str], out: str) -> DataFrame:
    """0-based place in the order (``part`` first, then ``order``) inside each ``group``.

    Only rows of one part meet in a task; the counts of earlier parts are added, so a
    group with a third of all rows is ranked by many tasks.
    """
    keys = [*group, part]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_k_{c}") for c in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(inside) - 1)
    return (
        ranked.join(F.broadcast(offsets), on)  # groups x slices rows, see stratified_shards
        .withColumn(out, F.col("_off") + F.col("_r"))
        .drop("_r", "_off", *[f"_k_{c}" for c in keys])
    )


def stratified_shards(
    rows: DataFrame, shards: int, stratum: str = "source", key: tuple[str, ...] = ("doc_id",), seed: int = 17
) -> DataFrame:
    """Adds ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 inside the shard).

    Rows of a stratum are shuffled by a seeded MD5 of ``key``, their fractional rank is
    ``(place + 1/2) / size of the stratum``; all rows sorted by it are cut into equal
    runs, so counts of two shards differ by one at most and each run holds every stratum
    in proportion.

    Defined cases: a null stratum is one stratum of its own; null keys count as empty
    text; rows that agree in ``key`` are ordered by their other plain columns, and rows
    that agree in all of them are interchangeable; an empty table gives an empty result;
    columns named ``shard`` or ``slot`` are replaced. Equal texts may go to different shards.

    Ranking works in slices of the hash and of the fractional rank. The offsets joined by
    broadcast have one row per stratum and slice: strata x slices, where slices is
    ``max(64, rows / 100,000)``; a table with so many strata that this is not small is
    ranked with one slice per stratum instead.
    """
    rows = rows.drop("shard", "slot")
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_size"))
    total, strata = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    slices = max(LEAST_SLICES, total // SLICE_ROWS)
    fine = slices if strata * slices <= 200_000 else 1
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    hashed = rows.withColumn("_h", F.md5(name.cast("binary"))).withColumn(
        "_slice", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * fine / (1 << 32)).cast("long")
    )
    plain = [c for c, t in rows.dtypes if t in ("bigint", "int", "string", "double", "boolean")]
    order = ["_h", *[c for c in key if c in plain], *[c for c in plain if c not in key]]
    placed = _numbered(hashed, [stratum], "_slice", order, "_place")
    placed = placed.join(F.broadcast(sizes) if strata <= 10_000 else sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    # (2 place + 1) / (2 size) as an exact integer grid for slicing, the double only breaks ties by order
    placed = placed.withColumn("_f", (2 * F.col("_place") + 1) / (2 * F.col("_size"))).withColumn(
        "_cell", F.least((F.col("_f") * slices).cast("long"), F.lit(slices - 1))
    )
    positioned = _numbered(placed, [], "_cell", ["_f", stratum, *order], "_pos")
    shard = F.floor(F.col("_pos") * shards / F.lit(max(total, 1)))
    # first position of a shard: the least p with floor(p * shards / total) = shard
    first = F.ceil(F.col("shard") * F.lit(total) / shards)
    return (
        positioned.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("_pos") - first).cast("long"))
        .drop("_h", "_slice", "_place", "_size", "_s", "_f", "_cell", "_pos")
    )
