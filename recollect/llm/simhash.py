"""SimHash near-duplicates: fingerprints of word shingles, joined by walking pairs of binary trie nodes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.batches import bounded
from recollect.llm.components import components
from recollect.session import broadcast_if_small, cut_lineage

SEED = 42
SEGMENT = 1 << 20  # bytes of a text whose words are held at once
GRAMS = 1 << 14  # shingles whose bits are unpacked at once
CELL_BITS = 12  # depth of the histogram from which the trie is cut into blocks
LEAF = 500_000  # codes of a block at most (but for codes that share CELL_BITS bits, which are sliced)
BLOCKS = 64  # blocks of all tables together at least, if there are enough codes
BESIDE = 4_000_000  # codes that one task compares its block with at most
FRONTIER = 1 << 18  # trie node pairs held at once
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _segments(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > SEGMENT:
        m = _SPACE.search(data, at + SEGMENT)
        if not m:
            break
        yield data[at : m.start()]
        at = m.start()
    yield data[at:]


def shingle_hashes(text: str, ngram: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased; fewer words: of the whole sequence; none: nothing."""
    carry: list[bytes] = []
    some = False
    hash_ = xxhash.xxh64_intdigest
    for seg in _segments(text.encode().lower()):
        w = carry + seg.split()
        m = len(w) - ngram + 1
        if m > 0:
            joined = b" ".join(w)
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
            first = [0, *(ends[: m - 1] + 1).tolist()]
            last = ends[ngram - 1 :].tolist()
            some = True
            yield np.fromiter((hash_(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, m)
            carry = w[m:]
        else:
            carry = w
    if not some and carry:
        yield np.array([hash_(b" ".join(carry), SEED)], np.uint64)


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit word of a hash (k = 0: the hash itself): two rounds of multiply and shift."""
    if not k:
        return h
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, ngram: int) -> np.ndarray:
    """The different shingle hashes of a whole text, sorted."""
    parts = list(shingle_hashes(text or "", ngram))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def signature(text: str | None, ngram: int = 3, words: int = 1, distinct: bool = False) -> list[int]:
    """``words`` 64-bit words (signed); a bit is 1 if it is set in over half of the shingles' hashes.

    Repeated shingles count each time, or once with ``distinct``.
    """
    return _majority([shingle_set(text, ngram)] if distinct else shingle_hashes(text or "", ngram), words)


def _majority(parts: Iterable[np.ndarray], words: int) -> list[int]:
    total = 0
    ones = np.zeros((words, 64), np.int64)
    for hashes in parts:
        for a in range(0, len(hashes), GRAMS):
            part = hashes[a : a + GRAMS]
            total += len(part)
            for k in range(words):
                bits = np.unpackbits(_remixed(part, k).view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
                ones[k] += bits.sum(axis=0, dtype=np.uint32)
    packed = np.packbits((2 * ones > total).astype(np.uint8), axis=1, bitorder="little")
    return packed.view(np.int64).ravel().tolist()


def signatures(
    docs: DataFrame, ngram: int = 3, words: int = 1, text: str = "text", name: str = "signature", distinct: bool = False
) -> DataFrame:
    """Adds the array ``name`` of ``words`` longs. Null texts and texts without words: zeros."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([signature(t, ngram, words, distinct) for t in b])

    return bounded(docs).withColumn(name, run(F.col(text)))


# --- the join -------------------------------------------------------------------------


def _walk(left: np.ndarray, right: np.ndarray, same: bool, budget: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with ``left[i]`` and ``right[j]`` differing in at most ``budget`` of the top ``width`` bits.

    Both arrays are sorted; a trie node is a range of one of them. Pairs of nodes go down
    together, bit by bit; a pair whose children part adds one to its differing bits and is
    dropped beyond the budget. ``same``: left and right are one array, each pair comes once.
    """
    bits = np.uint64(1) << np.arange(63, 63 - width, -1, dtype=np.uint64)
    sums = []
    for a in (left,) if same else (left, right):
        ones = np.zeros((width, len(a) + 1), np.int32)
        for d in range(width):
            np.cumsum((a & bits[d]) != 0, out=ones[d, 1:])
        sums.append(ones)
    l_sum, r_sum = sums[0], sums[-1]
    top = ~((np.uint64(1) << np.uint64(64 - width)) - np.uint64(1)) if width < 64 else ~np.uint64(0)
    l_top, r_top = left & top, right & top
    stack = [(0, np.array([[0, len(left), 0, len(right), 0]], np.int32))]
    while stack:
        depth, f = stack.pop()
        if len(f) > FRONTIER:
            half = len(f) // 2
            stack += [(depth, f[:half]), (depth, f[half:])]
            continue
        work = (f[:, 1] - f[:, 0]).astype(np.int64) * (f[:, 3] - f[:, 2])
        ready = work <= 4 if depth < width else np.ones(len(f), bool)
        done, f = f[ready], f[~ready]
        n = work[ready]
        at, cut = 0, np.cumsum(n)
        while at < len(done):  # small nodes: compare their codes one by one, a bounded number at a time
            to = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + 4 * FRONTIER, side="right")))
            k = n[at:to]
            own = np.repeat(np.arange(at, to), k)
            inside = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
            across = (done[own, 3] - done[own, 2]).astype(np.int64)
            i, j = done[own, 0] + inside // across, done[own, 2] + inside % across
            ok = np.bitwise_count(l_top[i] ^ r_top[j]) <= budget
            if same:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
            at = to
        if not len(f):
            continue
        a_mid = f[:, 1] - (l_sum[depth, f[:, 1]] - l_sum[depth, f[:, 0]])
        b_mid = f[:, 3] - (r_sum[depth, f[:, 3]] - r_sum[depth, f[:, 2]])
        kids = []
        for one_l, one_r in ((0, 0), (1, 1), (0, 1), (1, 0)):
            differ = f[:, 4] + (one_l != one_r)
            lo, hi = (a_mid, f[:, 1]) if one_l else (f[:, 0], a_mid)
            lo2, hi2 = (b_mid, f[:, 3]) if one_r else (f[:, 2], b_mid)
            ok = (lo < hi) & (lo2 < hi2) & (differ <= budget)
            if same:  # of one array: not both (x, y) and (y, x)
                ok &= lo < hi2
            if ok.any():
                kids.append(np.stack([lo[ok], hi[ok], lo2[ok], hi2[ok], differ[ok]], axis=1).astype(np.int32))
        if kids:
            stack.append((depth + 1, np.concatenate(kids)))


class _Forest:
    """Least-label union of index pairs; only a spanning forest of them leaves a task."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        lab = self.label
        while True:
            a, b = lab[u], lab[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = lab[lab]
                if (up == lab).all():
                    break
                lab = up
            self.label = lab


def _blocks(cells: list[tuple[int, int, int]], leaf: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Cuts each table's trie into blocks of at most ``leaf`` codes.

    ``cells``: (table, top CELL_BITS bits, count). Returns blocks (table, prefix, depth,
    count) and for each cell (table, cell, first block, slices).
    """
    blocks: list[tuple[int, int, int, int]] = []
    where: list[tuple[int, int, int, int]] = []
    by_table: dict[int, dict[int, int]] = {}
    for t, c, n in cells:
        by_table.setdefault(t, {})[c] = n
    for t, counts in sorted(by_table.items()):
        keys = np.array(sorted(counts))
        sums = np.concatenate([[0], np.cumsum([counts[k] for k in keys])])
        stack = [(0, 0)]
        while stack:
            prefix, depth = stack.pop()
            lo, hi = np.searchsorted(keys, [prefix << (CELL_BITS - depth), (prefix + 1) << (CELL_BITS - depth)])
            n = int(sums[hi] - sums[lo])
            if not n:
                continue
            if n > leaf and depth < CELL_BITS:
                stack += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
                continue
            slices = -(-n // leaf) if depth == CELL_BITS else 1
            where += [(t, int(k), len(blocks), slices) for k in keys[lo:hi]]
            blocks += [(t, prefix, depth, -(-n // slices))] * slices
    return blocks, where


def _tasks(blocks: list[tuple[int, int, int, int]], budget: int) -> list[tuple[int, int, bool, bool]]:
    """(block, task, own, with itself): pairs of blocks whose prefixes differ within the budget, each met in one task.

    The top of the walk, done once for all tasks: at most a few thousand blocks.
    """
    out, task = [], 0
    table = np.array([b[0] for b in blocks], np.int64)
    depth = np.array([b[2] for b in blocks], np.int64)
    prefix = np.array([b[1] << (CELL_BITS - b[2]) for b in blocks], np.int64)
    count = np.array([b[3] for b in blocks], np.int64)
    n = np.arange(len(blocks))
    for a in range(len(blocks)):
        common = np.minimum(depth, depth[a])
        differ = np.bitwise_count((prefix ^ prefix[a]) >> (CELL_BITS - common))
        mine = (n < a) & ((n + a) % 2 == 1) | (n > a) & ((n + a) % 2 == 0)
        near = n[(table == table[a]) & (differ <= budget) & mine]
        parts = np.cumsum(count[near]) // BESIDE
        for p in range(int(parts.max()) + 1 if len(parts) else 1):
            out.append((a, task, True, p == 0))
            out += [(int(b), task, False, False) for b in near[parts == p]] if len(near) else []
            task += 1
    return out


def trie_links(codes: DataFrame, budget: int = 3, width: int = 64, check_budget: int | None = None) -> DataFrame:
    """Links (a, b) that join all ``node`` whose codes differ in at most ``budget`` bits, as a spanning forest per task.

    ``codes``: table int, code long (its top ``width`` bits count), node long and, if
    ``check_budget`` is given, more long: a pair is a link only if the lower bits of the codes
    and ``more`` differ in at most so many bits too. Pairs are found within one table, without
    a cap, and exactly but for nodes of one code: those that pass the check with the first
    of them are linked to it and take no further part.

    Each table's trie is cut at the top into blocks of similar size (histogram of 4,096
    cells a table on the driver); a task walks one block against itself and those of its
    neighbours that the budget allows and that it owns. A block deeper than the histogram
    is cut into hashed slices, so hot prefixes are split as well.

    Defined cases: fewer than two codes give no link; a node that comes twice is linked with
    itself at most; other columns are not read; nulls are not allowed.
    """
    spark = codes.sparkSession
    cell = F.shiftrightunsigned(F.col("code"), 64 - CELL_BITS).cast("int")
    checks = ["more"] if check_budget is not None else []
    codes = cut_lineage(codes.select("table", "code", "node", *checks, cell.alias("_cell")))
    seen = [(r[0], r[1], r[2]) for r in codes.groupBy("table", "_cell").agg(F.count(F.lit(1))).collect()]
    total = sum(n for _, _, n in seen)
    empty = spark.createDataFrame([], "a bigint, b bigint")
    if total < 2:
        return empty
    blocks, where = _blocks(seen, max(2, min(LEAF, -(-total // BLOCKS))))
    cells = spark.createDataFrame(where, "table int, _cell int, _first int, _slices int")
    tasks = spark.createDataFrame(_tasks(blocks, budget), "_block int, _task int, _own boolean, _self boolean")
    block = (F.col("_first") + F.pmod(F.xxhash64("node"), F.col("_slices"))).cast("int")
    dealt = (
        codes.join(F.broadcast(cells), ["table", "_cell"])  # at most 4,096 rows a table
        .select(block.alias("_block"), "code", "node", *checks)
        .join(F.broadcast(tasks), "_block")  # pairs of blocks
        .drop("_block")
    )
    low = np.uint64((1 << (64 - width)) - 1)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort([rows["node"].to_numpy(), rows["code"].to_numpy().view(np.uint64)])
        own, alone = rows["_own"].to_numpy()[order], bool(rows["_self"].any())
        code, node = rows["code"].to_numpy().view(np.uint64)[order], rows["node"].to_numpy()[order]
        more = rows["more"].to_numpy().view(np.uint64)[order] if check_budget is not None else None
        forest = _Forest(len(rows))

        def passes(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            return np.bitwise_count((code[u] ^ code[v]) & low).astype(np.int64) + np.bitwise_count(more[u] ^ more[v]) <= check_budget

        def leaders(rows: np.ndarray, link: bool) -> np.ndarray:
            top = code[rows] >> np.uint64(64 - width)
            first = np.concatenate([[True], top[1:] != top[:-1]])
            lead = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
            follows = ~first & passes(rows, lead)
            if link:
                forest.add(rows[follows], lead[follows])
            return rows[~follows]

        mine, rest = np.flatnonzero(own), np.flatnonzero(~own)
        if more is not None and width < 64:
            mine, rest = leaders(mine, alone) if len(mine) else mine, leaders(rest, False) if len(rest) else rest
        runs = [(mine, mine, True)] if alone else []
        runs += [(mine, rest, False)] if len(rest) else []
        for left, right, same in runs:
            for i, j in _walk(code[left], code[right], same, budget, width):
                u, v = left[i], right[j]
                if more is not None:
                    ok = passes(u, v)
                    u, v = u[ok], v[ok]
                forest.add(u, v)
        away = np.flatnonzero(forest.label != np.arange(len(code)))
        return pd.DataFrame({"a": node[away], "b": node[forest.label[away]]})

    return dealt.groupBy("_task").applyInPandas(walk, "a bigint, b bigint")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(_node, _root, component_id): the component of each node and the least key in it."""
    roots = components(links)
    least = nodes.join(roots.withColumnRenamed("node", "_node"), "_node", "left").select(
        "_node", F.coalesce("root", "_node").alias("_root"), "_least"
    )
    per_root = least.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return cut_lineage(least.join(per_root, "_root").select("_node", "_root", "component_id"))


def fingerprint_components(docs: DataFrame, ngram: int = 3, budget: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) for every row: components of the links at ``budget`` bits.

    Equal fingerprints are one node, so copies are never paired; the walk runs over
    distinct fingerprints. Defined cases: null texts and texts without words have
    fingerprint zero and link like others; rows with a null key take part, but a null is
    nobody's component_id unless the component has no other key; repeated rows stay
    repeated; other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    signed = signatures(slim, ngram, 1, "_text", "_sig").select("_key", F.element_at("_sig", 1).alias("_node"))
    signed = cut_lineage(signed)
    nodes = cut_lineage(signed.groupBy("_node").agg(F.min("_key").alias("_least")))
    links = trie_links(nodes.select(F.lit(0).alias("table"), F.col("_node").alias("code"), F.col("_node").alias("node")), budget)
    return signed.join(_rooted(nodes, links), "_node").select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("_node"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near-duplicates of 0.8 Jaccard on shingles have a cosine of 0.89, and so a SimHash bit
# differs with this probability. MISSED: share of such pairs that no table may find.
LEAST, DIFFER, MISSED = 0.8, 0.1514, 0.006
TABLE_BUDGET = 3
# Shingles of the documents, and documents, that one task compares.
TASK_SHINGLES, TASK_NODES = 2_000_000, 4_000


def _tables(documents: int) -> tuple[int, int, int]:
    """(tables, bits of a code, differing bits of the rest allowed) for so many documents.

    A code gets a bit more when the documents double, so that the pairs that chance brings
    together stay in proportion to them; then it takes more tables to miss as few pairs.
    """
    width = min(64, max(32, math.ceil(math.log2(max(documents, 1))) + 14))
    found = sum(math.comb(width, k) * DIFFER**k * (1 - DIFFER) ** (width - k) for k in range(TABLE_BUDGET + 1))
    tables = math.ceil(math.log(MISSED) / math.log(1 - found))
    rest = 128 - width
    return tables + tables % 2, width, math.ceil(rest * DIFFER + 3.3 * math.sqrt(rest * DIFFER * (1 - DIFFER)))


def _marked(docs: DataFrame, ngram: int, words: int) -> DataFrame:
    """(_key, _th, _node, _size, _sig): the node is a hash of the text's set of shingles, so texts of one set are one node."""

    @F.pandas_udf("struct<node:bigint,size:bigint,sig:array<bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b:
                h = shingle_set(t, ngram)
                node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], np.uint64).view(np.int64)[0]
                rows.append((node, len(h), _majority([h], words)))
            yield pd.DataFrame(rows, columns=["node", "size", "sig"])

    # called non-deterministic so that taking its fields apart does not run it three times
    made = bounded(docs).select("_key", F.xxhash64("_text").alias("_th"), run.asNondeterministic()("_text").alias("_m"))
    return made.select("_key", "_th", F.col("_m.node").alias("_node"), F.col("_m.size").alias("_size"), F.col("_m.sig").alias("_sig"))


def similar_sets(node: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (a, b) that join exactly the nodes joined by pairs with a Jaccard similarity of ``least`` or more.

    ``sets``: sorted arrays of different values. Sets meet on the rarest ``1 - least`` of their
    values, the smaller ones first; a pair is compared only while nothing joins it yet.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    sets, size, node = [sets[i] for i in order], size[order], node[order]
    if len(sets) < 2:
        return []
    _, value, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    head = (size - np.ceil(least * size - 1e-9) + 1).astype(np.int64)
    ends = np.cumsum(size)
    heads = []
    for end, n, k in zip(ends.tolist(), size.tolist(), head.tolist()):
        v = value[end - n : end]
        v = v[np.argsort(rank[v], kind="stable")[:k]] if k < n else v
        heads.append(v[often[v] > 1])
    room = np.bincount(np.concatenate(heads), minlength=len(often))
    start, used = np.cumsum(room) - room, np.zeros(len(often), np.int64)
    met = np.zeros(int(room.sum()), np.int64)  # by value: the sets so far that have it in their head
    label, links = np.arange(len(sets)), []
    for i, v in enumerate(heads):
        n = used[v]
        if n.any():
            j = met[np.repeat(start[v] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            j = np.unique(j[(label[j] != label[i]) & (size[j] >= least * size[i] - 1e-9)])
            take = 1
            while len(j):  # a few of each component first: one that is near enough speaks for all
                by = np.argsort(label[j], kind="stable")
                of = label[j][by]
                first = np.concatenate([[True], of[1:] != of[:-1]])
                place = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
                now = j[by[place < take]]
                both = np.concatenate([sets[x] for x in now])
                at = np.minimum(np.searchsorted(sets[i], both), size[i] - 1)
                shared = np.add.reduceat((sets[i][at] == both).astype(np.int64), np.cumsum(size[now]) - size[now])
                for x in now[shared >= least * (size[now] + size[i] - shared) - 1e-9]:
                    if label[x] != label[i]:
                        links.append((int(node[i]), int(node[x])))
                        label[label == label[x]] = label[i]
                j = np.setdiff1d(j, now)
                j, take = j[label[j] != label[i]], take * 4
        met[start[v] + n] = i
        used[v] += 1
    return links


def _verified(forest: DataFrame, nodes: DataFrame, docs: DataFrame, ngram: int) -> DataFrame:
    """Links (a, b) between nodes of one component of ``forest`` whose sets have a Jaccard similarity of LEAST or more.

    Small components are dealt to tasks together; one that is too large for a task is cut into
    hashed blocks, of which each pair meets in one task. Every text is read once for this and
    its set is sent once for each pair of blocks it is in, not for each candidate.
    """
    near = nodes.join(components(forest).withColumnRenamed("node", "_node"), "_node").select("_node", "_first", "_size", "root")
    near = cut_lineage(near)
    total = near.agg(F.sum("_size"), F.count(F.lit(1))).first()
    if not total[1]:
        return forest.limit(0)
    tasks = max(1, 4 * max(total[0] // TASK_SHINGLES, total[1] // TASK_NODES))
    sums = near.groupBy("root").agg(F.sum("_size").alias("_s"), F.count(F.lit(1)).alias("_n"))
    large = sums.where((F.col("_s") > TASK_SHINGLES) | (F.col("_n") > TASK_NODES)).select(
        "root", F.ceil(F.greatest(2 * F.col("_s") / TASK_SHINGLES, 2 * F.col("_n") / TASK_NODES)).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("_node", "root"), F.col("_blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1),
                         lambda o: F.xxhash64("root", F.least(o, F.col("_own")), F.greatest(o, F.col("_own"))))
    dealt = near.join(F.broadcast(large), "root", "left").withColumn("_own", own).select(  # fewer than total / TASK_SHINGLES rows
        "_node", F.col("_first.k").alias("_key"), F.col("_first.h").alias("_th"),
        F.when(F.col("_blocks").isNull(), F.array(F.pmod(F.xxhash64("root"), F.lit(tasks)))).otherwise(others).alias("_tasks"))
    dealt = broadcast_if_small(cut_lineage(dealt))

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([shingle_set(t, ngram).tobytes() for t in b])

    texts = docs.withColumn("_h", F.xxhash64("_text")).alias("d").join(
        dealt.alias("n"), F.col("d._key").eqNullSafe(F.col("n._key")) & (F.col("_h") == F.col("_th"))).select("_node", "_tasks", "_text")
    sets = bounded(texts).select("_node", "_tasks", run("_text").alias("_set")).select("_node", F.explode("_tasks").alias("_task"), "_set")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("_node")
        links = similar_sets(rows["_node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["_set"]], LEAST)
        return pd.DataFrame(links, columns=["a", "b"])

    return sets.groupBy("_task").applyInPandas(join, "a bigint, b bigint")


def _near(docs: DataFrame, ngram: int, key: str, text: str) -> DataFrame:
    """(_key, _th, _root, component_id) for every row; _th is a hash of the text."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    tables, width, check = _tables(slim.count())
    words = tables // 2 if width == 32 else tables
    signed = cut_lineage(_marked(slim, ngram, words))
    first = F.struct(F.col("_key").isNull().alias("no"), F.col("_key").alias("k"), F.col("_th").alias("h"))
    nodes = cut_lineage(signed.groupBy("_node").agg(
        F.min("_key").alias("_least"), F.min(first).alias("_first"), F.first("_size").alias("_size"), F.first("_sig").alias("_sig")))

    def code(t: int) -> Column:
        """Both halves of a word are codes if a half is wide enough."""
        word = F.element_at("_sig", t % words + 1)
        turned = F.shiftleft(word, 32).bitwiseOR(F.shiftrightunsigned(word, 32))
        return F.struct(F.lit(t).alias("table"), (turned if t >= words else word).alias("code"), F.element_at("_sig", (t + 1) % words + 1).alias("more"))

    codes = nodes.select(F.inline(F.array(*[code(t) for t in range(tables)])), F.col("_node").alias("node"))
    forest = cut_lineage(trie_links(codes, TABLE_BUDGET, width, check).distinct())
    links = cut_lineage(_verified(forest, nodes, slim, ngram))
    return signed.select("_key", "_th", "_node").join(_rooted(nodes.select("_node", "_least"), links), "_node").drop("_node")


def near_duplicates(docs: DataFrame, ngram: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id): groups of documents linked by a Jaccard similarity of shingle sets of at least 0.8.

    Candidates come from signatures of 512 bits or more; each half of a 64-bit word is a table of
    its own (each word, from 262,145 documents on), joined by the trie walk with 3 errors.
    Every link is verified on the whole sets of shingles (as 64-bit hashes). Cases as in :func:`fingerprint_components`; documents without
    words form one group.
    """
    return _near(docs, ngram, key, text).select(F.col("_key").alias(key), "component_id")


def drop_near_duplicates(docs: DataFrame, ngram: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates stays, with all its columns: that of the least key.

    A null key comes last; of repeated keys the row with the least text hash stays, and of
    wholly repeated rows one. An empty table gives an empty result.
    """
    groups = _near(docs, ngram, key, text)
    row = F.struct(F.col("_key").isNull().alias("_no"), "_key", "_th")
    rows = groups.groupBy("_root", "_key", "_th").agg(F.count(F.lit(1)).alias("_n"))
    chosen = rows.groupBy("_root").agg(F.min(F.struct(row.alias("r"), "_n")).alias("m")).select("m.r._key", "m.r._th", "m._n")
    chosen = broadcast_if_small(cut_lineage(chosen))
    marked = docs.withColumn("_h", F.xxhash64(text))
    kept = marked.join(chosen, marked[key].eqNullSafe(chosen["_key"]) & (marked["_h"] == chosen["_th"]))
    once = kept.where("_n = 1").select(*[kept[c] for c in docs.columns])
    again = kept.where("_n > 1").dropDuplicates(["_key", "_th"]).select(*docs.columns)
    return once.unionByName(again)
