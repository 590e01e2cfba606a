"""Trie of conversation prefixes by truncation peeling, from the deepest turn to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.session import cut_lineage

TURN = 48  # hex digits of a turn in a list: 32 of its digest, 16 of its length
STEP = 24  # bytes of a step in a path: 16 of the prefix's digest, 8 of the last turn's length
# Of all rows, so many may share a prefix whose subtree is peeled in one task.
SHARE, LEAST_GROUP, MOST_GROUP = 1 / 64, 256, 50_000
WORK = 20_000  # rows that a task peels together, if whole groups allow
LISTED = 50_000  # ids of a run of members that is joined to one string
HOT_SHARE, HOT_CHILDREN = 1 / 1000, 1_000

_ROUND = (
    "path binary, digest binary, parent binary, depth bigint, n_convs bigint, conv_id bigint, n_children bigint, "
    "n_leaves bigint, saved bigint"
)


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as one string of ``TURN`` hex digits a turn.

    ``turns``: conv_id, turn, role, text. A turn is the MD5 of its role and text and the code
    points of its text, so no text is shuffled; a conversation is one row of 48 bytes a turn.
    Null turns come first, ties go by the digest; null roles and texts are empty; rows without
    conv_id take no part; other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    one = F.concat(digest, F.lpad(F.hex(F.length(text).cast("long")), 16, "0"))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", one.alias("t")).alias("_t"))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("_t")), lambda x: x["t"]), "").alias("turns")
    )


def spliced(lists: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Lists that begin with the first ``shared`` (at most ``most``) turns of conversation ``base``, then go on with their own.

    A base that does not exist gives no turns; a conversation with ``shared`` turns or
    fewer keeps none of its own. ``base`` and ``shared`` are expressions over conv_id.
    """
    own = lists.select("conv_id", "turns", base.alias("_base"), (shared * TURN).cast("int").alias("_h"))
    heads = lists.select(F.col("conv_id").alias("_base"), F.substring("turns", 1, most * TURN).alias("_head"))
    heads = heads.join(own.select("_base").distinct(), "_base")
    both = own.join(heads, "_base", "left")
    first = F.expr("substring(coalesce(_head, ''), 1, _h)")
    return both.select("conv_id", F.concat(first, F.expr("substring(turns, _h + 1)")).alias("turns"))


def _path(turns: str) -> bytes:
    raw, out, last = bytes.fromhex(turns), [], b""
    for k in range(0, len(raw), STEP):
        last = hashlib.md5(last + raw[k : k + 16]).digest()
        out += (last, raw[k + 16 : k + STEP])
    return b"".join(out)


def _paths(turns: str) -> Column:
    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([_path(t) for t in lists], dtype=object)

    return run(F.col(turns))


def _digest(depth: Column | None) -> Column:
    """The digest at ``depth`` of a path; empty for the root."""
    return F.expr("CAST('' AS binary)") if depth is None else F.substring(F.col("path"), (depth - 1) * STEP + 1, F.lit(16))


def _peel(rows: list[tuple], low: int) -> list[tuple]:
    """Nodes deeper than ``low`` of whole subtrees, deepest first; rows: (path, children, n, conv_id, leaves, saved).

    Each step merges the nodes that lost their last turn with the conversations that end
    there, counts the merged nodes and strips one more turn.
    """
    at: dict[int, list[tuple]] = {}
    for r in rows:
        at.setdefault(len(r[0]) // STEP, []).append(r)
    out, stripped = [], []
    for d in range(max(at, default=0), low, -1):
        here: dict[bytes, list] = {}
        a = (d - 1) * STEP
        for path, children, n, conv, leaves, saved in [*stripped, *at.get(d, ())]:
            x = here.get(key := path[a : a + 16])
            if x is None:
                here[key] = [path, children, n, conv, leaves, saved]
            else:
                x[1] += children
                x[2] += n
                x[3] = min(x[3], conv)
                x[4] += leaves
                x[5] += saved
        stripped = []
        for key, (path, children, n, conv, leaves, saved) in here.items():
            leaves = leaves if children else 1
            saved += (n - 1) * int.from_bytes(path[a + 16 : a + STEP], "big")
            out.append((path[:a] if d == low + 1 else None, key, path[a - STEP : a - 8] if d > 1 else b"", d, n, conv, children, leaves, saved))
            stripped.append((path, 1, n, conv, leaves, saved))
    return out


def _band(low: int):
    """Peels the rows of a task (sorted by their prefix at ``low``) down to that depth, whole groups at a time."""
    names = [c.split()[0] for c in _ROUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            held += zip(b["path"], b["children"].tolist(), b["n"].tolist(), b["conv_id"].tolist(), b["leaves"].tolist(), b["saved"].tolist())
            if len(held) >= WORK:
                last = held[-1][0][: low * STEP]
                cut = len(held)
                while cut and held[cut - 1][0][: low * STEP] == last:
                    cut -= 1
                if cut:
                    yield pd.DataFrame(_peel(held[:cut], low), columns=names)
                    held = held[cut:]
        yield pd.DataFrame(_peel(held, low), columns=names)

    return run


def _cut(rows: DataFrame, top: int) -> int:
    """The least depth below ``top`` whose prefixes are each shared by few rows; ``top``: there is none."""
    marks = sorted({d for k in range(31) for d in (2**k, 3 * 2**k // 2) if d < top} | {top - 1} - {0})
    if not marks:
        return top
    each = F.explode(F.array(*[F.lit(d) for d in marks])).alias("_d")
    deep = rows.select("path", each).where(F.octet_length("path") > F.col("_d") * STEP)
    shared = deep.groupBy("_d", _digest(F.col("_d")).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    most = {r[0]: r[1] for r in shared.groupBy("_d").agg(F.max("_n")).collect()}
    limit = min(max(rows.count() * SHARE, LEAST_GROUP), MOST_GROUP)
    return next((d for d in marks if all(most.get(x, 0) <= limit for x in marks if x >= d)), top)


def prefix_trie(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of all prefixes of ``lists`` (conv_id, turns as of :func:`turn_lists`): (nodes, members).

    ``nodes``, one row each, the textless root included: digest, parent (empty digest: the root;
    null: of the root), depth, conv_id (smallest member), n_convs, n_children, n_leaves, saved
    (over its subtree, each node's ``n_convs - 1`` times the code points of its last text).
    ``members``: (digest, conv_id) of the node at which each conversation ends.

    Equal conversations are one row from the start. The peeling descends from the deepest turn:
    conversations that end at a depth merge with the nodes that lost their last turn there, and
    all columns of a node are settled in that one visit. Below the first depth at which no
    prefix is shared by more than a 64th of the rows (and 50,000) all levels are peeled in one
    pass, each subtree within a task; a level above it is one grouping with partial sums, so a
    first turn that everybody shares never meets in one task. The rounds are checkpointed.

    Defined cases: a conversation without turns is a member of the root; an empty table has no
    node; repeated conv_id count as that many conversations.
    """
    spark = lists.sparkSession
    members = cut_lineage(lists.select("conv_id", _paths("turns").alias("path")))
    ends = cut_lineage(members.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).select(
        "path", F.lit(0).cast("long").alias("children"), "n", "conv_id", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    depth = (F.octet_length("path") / STEP).cast("int")
    level = ends.agg(F.max(depth)).first()[0]
    rounds = []
    alive = ends.limit(0)
    level = -1 if level is None else level
    while level >= 0:
        rows = alive.union(ends.where(depth <= level))
        low = _cut(rows, level) if level > 1 else level
        if low < level:  # whole subtrees within tasks
            dealt = alive.union(ends.where((depth <= level) & (depth > low))).withColumn("_base", F.substring("path", 1, low * STEP))
            done = dealt.repartition("_base").sortWithinPartitions("_base").drop("_base").mapInPandas(_band(low), _ROUND)
        else:  # one level, by partial sums
            low = level - 1
            merged = alive.union(ends.where(depth == level)).groupBy("path").agg(
                *[F.sum(c).alias(c) for c in ("children", "n", "leaves", "saved")], F.min("conv_id").alias("conv_id"))
            size = F.conv(F.hex(F.substring("path", max(low, 0) * STEP + 17, 8)), 16, 10).cast("long")
            spared = (F.col("n") - 1) * size if level else F.lit(0).cast("long")
            parent = F.lit(None).cast("binary") if not level else _digest(F.lit(low) if low else None)
            done = merged.select(
                F.substring("path", 1, max(low, 0) * STEP).alias("path"), _digest(F.lit(level) if level else None).alias("digest"), parent.alias("parent"),
                F.lit(level).cast("long").alias("depth"), F.col("n").alias("n_convs"), "conv_id", F.col("children").alias("n_children"),
                F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + spared).alias("saved"))
        done = cut_lineage(done)
        rounds.append(done.drop("path"))
        alive = done.where(F.col("depth") == low + 1).select(
            "path", F.lit(1).cast("long").alias("children"), F.col("n_convs").alias("n"), "conv_id", F.col("n_leaves").alias("leaves"), "saved")
        level = low
    nodes = spark.createDataFrame([], _ROUND).drop("path") if not rounds else rounds[0]
    for r in rounds[1:]:
        nodes = nodes.unionByName(r)
    end = F.when(F.octet_length("path") > 0, _digest(depth)).otherwise(_digest(None))
    return nodes, members.select(end.alias("digest"), "conv_id")


def with_parent(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``; parents of very many children (fewer than 1,000 nodes) are joined by broadcast."""
    own = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") > max(nodes.count() * HOT_SHARE, HOT_CHILDREN)
    hubs = own.where(hot).select("parent", F.col("parent_conv_id").alias("_hub"))
    marked = nodes.join(F.broadcast(hubs), "parent", "left")
    usual = marked.where("_hub IS NULL").drop("_hub").join(own.where(~hot).drop("n_children"), "parent", "left")
    return usual.unionByName(marked.where("_hub IS NOT NULL").withColumnRenamed("_hub", "parent_conv_id"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (digest, conv_id) as runs (digest, first, ids): the decimal ids, comma-joined."""
    for b in batches:
        out = []
        for digest, run in groupby(zip(b["digest"], b["conv_id"].tolist()), key=lambda x: x[0]):
            ids = [c for _, c in run]
            out += [(digest, ids[k], ",".join(map(str, ids[k : k + LISTED]))) for k in range(0, len(ids), LISTED)]
        yield pd.DataFrame(out, columns=["digest", "first", "ids"])


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each digest's runs in order; only the running hash is held."""
    key, sha = None, None
    for b in batches:
        out = []
        for digest, ids in zip(b["digest"], b["ids"]):
            if digest == key:
                sha.update(b"," + ids.encode())
                continue
            if sha:
                out.append((key, sha.hexdigest()))
            key, sha = digest, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["digest", "ends_sha256"])
    if sha:
        yield pd.DataFrame([(key, sha.hexdigest())], columns=["digest", "ends_sha256"])


def end_hashes(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the lowercase SHA-256 of the members' conv_id, ascending, comma-joined, for each end node.

    Members are sorted by range, so those of one node lie in many tasks, which join them to
    runs; the hash itself has to take the runs of a node one after the other.
    """
    members = cut_lineage(members.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
                          .mapInPandas(_runs, "digest binary, first bigint, ids string"))
    return members.repartition("digest").sortWithinPartitions("digest", "first").mapInPandas(_hashes, "digest binary, ends_sha256 string")


def with_end_hashes(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``nodes`` with ``ends_sha256`` of those members that end there (none: the hash of the empty string)."""
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(end_hashes(members), "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
