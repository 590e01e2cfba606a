"""Phrase collocations: suffix subtrees cut off at a depth, built group by group after a vertical partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.batches import bounded
from recollect.operators.skew import top_n
from recollect.session import broadcast_if_small, cut_lineage

SEGMENT = 1 << 20  # bytes that are parted into words at once (a longer word is held whole)
CHUNK = 1 << 18  # words whose windows are held at once
LONG = 64  # bytes of a word up to which its hash is a weighted sum
FILTER_BITS = 24  # log2 of the counters that tell which words and pairs may be frequent: 2 MB of bits
BUDGET = 1 << 19  # suffixes of a group of subtrees
GROUPS, LEAST_BUDGET = 64, 2_048  # a smaller table is dealt to about so many groups, of so many suffixes at least
CLASSES, FINER = 4_096, 256  # hashed classes of first words; of the words behind a prefix that is over the budget
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.random.default_rng(13).integers(0, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = _BREAK


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _segments(data: bytes) -> Iterator[bytes]:
    """Parts of about ``SEGMENT`` bytes that end with a separator (but for the last)."""
    at, n = 0, len(data)
    while n - at > SEGMENT:
        to = at + SEGMENT
        while to < n:  # the next separator, looked for in steps
            some = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, min(4096, n - to), to)])
            if len(some):
                to += int(some[0]) + 1
                break
            to = min(n, to + 4096)
        yield data[at:to]
        at = to
    yield data[at:]


def word_hashes(data: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins, lengths, hashes, first) of the words of UTF-8 text; first: no word of the same piece stands before.

    A-Z are lower-cased; pieces part at ``[.,;:!?\\x0A-\\x0D]``, words at blanks and tabs.
    """
    fresh = True
    for seg in _segments(data):
        seg = seg.lower()  # of bytes: A-Z only
        a = np.frombuffer(seg, np.uint8)
        kind = _KIND[a]
        solid = kind == 0
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.cumsum(kind == _BREAK, dtype=np.int32)
        if not len(begin):
            fresh = fresh or bool(len(breaks) and breaks[-1])
            continue
        size = end - begin
        inside = np.arange(len(a)) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [len(a)]])))
        weighed = (a + np.uint64(1)) * _WEIGHTS[np.minimum(inside, LONG - 1)]
        weighed[~solid] = 0
        h = _mixed(np.add.reduceat(weighed, begin) + size.astype(np.uint64) * _GOLD)
        for k in np.flatnonzero(size > LONG).tolist():
            h[k] = xxhash.xxh64_intdigest(seg[begin[k] : end[k]], 13)
        first = np.empty(len(begin), bool)
        first[0] = fresh or bool(breaks[begin[0]])
        first[1:] = breaks[begin[1:]] != breaks[begin[:-1]]
        yield seg, begin, size, h, first
        fresh = bool(breaks[-1] != breaks[begin[-1]])


def _by_lang(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    """Texts of a language in one batch, joined by a line end (which parts pieces)."""
    for b in batches:
        for lang, rows in b.groupby("lang", sort=False):
            yield lang, "\n".join(rows["text"]).encode()


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 17))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * _GOLD + b)


def _counted_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for lang, data in _by_lang(batches):
        for seg, begin, size, h, _ in word_hashes(data):
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            words = [seg[b : b + k].decode() for b, k in zip(begin[at].tolist(), size[at].tolist())]
            yield pd.DataFrame({"lang": lang, "hash": u.view(np.int64), "word": words, "n": n})


class _Bits:
    """A broadcast set of counters that reached the least count; one that did not is surely not frequent."""

    def __init__(self, counters: DataFrame, counter: Column):
        words = counters.select(counter.alias("c")).groupBy(F.shiftright("c", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(c & 63 AS int))")).alias("bits")
        )
        table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)  # at most 2^18 rows, whatever the data
        rows = words.toPandas()
        table[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        self.table = table

    def __call__(self, h: np.ndarray) -> np.ndarray:
        c = h >> np.uint64(64 - FILTER_BITS)
        return (self.table[c >> np.uint64(6)] >> (c & np.uint64(63))) & np.uint64(1) != 0


def _counter(h: str) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - FILTER_BITS)


def _linked(h: np.ndarray, first: np.ndarray, salt: np.uint64, words: _Bits) -> np.ndarray:
    """For each word: the next one is of the same piece, and both may be frequent."""
    ok = words(_mixed(h ^ salt))
    out = np.zeros(len(h), bool)
    out[:-1] = ok[:-1] & ok[1:] & ~first[1:]
    return out


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, hashes, first) of whole joined texts: 9 bytes a word."""
    for lang, data in _by_lang(batches):
        parts = [(h, first) for _, _, _, h, first in word_hashes(data)]
        if parts:
            yield lang, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _counted_pairs(words: Callable[[], _Bits]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = words()
        for lang, h, first in _documents(batches):
            salt = _salt(lang)
            for a in range(0, len(h), CHUNK):
                part, begins = h[a : a + CHUNK + 1], first[a : a + CHUNK + 1]
                at = np.flatnonzero(_linked(part, begins, salt, bits)[:CHUNK])
                c, n = np.unique(_pair(part[at] ^ salt, part[at + 1]) >> np.uint64(64 - FILTER_BITS), return_counts=True)
                yield pd.DataFrame({"c": c.astype(np.int32), "n": n})

    return run


def _suffixes(words: Callable[[], _Bits], pairs: Callable[[], _Bits], depth: int):
    """The words from each place on, up to ``depth``, to the end of the piece or the first pair that is not frequent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, two = words(), pairs()
        for lang, h, first in _documents(batches):
            salt = _salt(lang)
            for a in range(0, len(h), CHUNK):
                part, begins = h[a : a + CHUNK + depth], first[a : a + CHUNK + depth]
                on = _linked(part, begins, salt, bits)
                at = np.flatnonzero(on)
                on[at] = two(_pair(part[at] ^ salt, part[at + 1]))
                at = np.flatnonzero(on[:CHUNK])
                if not len(at):
                    continue
                size = np.full(len(at), 2)
                goes = np.ones(len(at), bool)
                for k in range(1, depth - 1):
                    goes = goes & on[np.minimum(at + k, len(on) - 1)] & (at + k < len(on))
                    size += goes
                total = part[at].copy()
                for k in range(1, depth):
                    total = np.where(size > k, _pair(total, part[np.minimum(at + k, len(part) - 1)]), total)
                _, at_first, n = np.unique(total, return_index=True, return_counts=True)
                where, size = at[at_first], size[at_first]
                keys = part[np.minimum(where[:, None] + np.arange(depth), len(part) - 1)].astype(">u8").tobytes()
                w = 8 * depth
                yield pd.DataFrame({"lang": lang, "key": [keys[k * w : k * w + 8 * m] for k, m in enumerate(size.tolist())], "n": n})

    return run


def vertical_partition(leaves: DataFrame, budget: int, depth: int) -> DataFrame:
    """Adds to ``leaves`` (lang, key, n) the ``_group`` of subtrees they belong to and the ``_whole`` depth.

    First words are dealt to 4,096 hashed classes; classes that hold more rows than the
    budget are taken apart by their next word (256 classes each), and so on to the full
    depth. Classes within the budget are grouped, largest first, each into the first group
    with room. Only class sizes come to the driver: 4,096 rows and 256 for every class over
    the budget. From ``_whole`` words on, all suffixes of a prefix are in one group.
    """
    spark = leaves.sparkSession
    prefix = [F.xxhash64("lang", F.substring("key", 1, 8 * d)) for d in range(1, depth + 1)]
    levels = [F.pmod(p, F.lit(CLASSES if d == 0 else FINER)).cast("int") for d, p in enumerate(prefix)]
    done: list[tuple[tuple[int, ...], int]] = []
    rows = leaves.withColumn("_c", F.array(levels[0]))
    sizes = rows.groupBy("_c").agg(F.count(F.lit(1))).collect()
    for d in range(1, depth + 1):
        over = [tuple(c) for c, n in sizes if n > budget and d < depth]
        done += [(tuple(c), n) for c, n in sizes if n <= budget or d == depth]
        if not over:
            break
        hot = F.broadcast(spark.createDataFrame([(list(c),) for c in over], "_c array<int>"))
        rows = rows.join(hot, "_c").withColumn("_c", F.concat("_c", F.array(levels[d])))
        sizes = rows.groupBy("_c").agg(F.count(F.lit(1))).collect()
    room: list[int] = []
    table = []
    open_ = 0  # groups before this one have no room worth looking for
    for c, n in sorted(done, key=lambda x: (-x[1], x[0])):
        g = next((k for k in range(open_, min(len(room), open_ + 64)) if room[k] + n <= budget), None)
        if g is None:
            g = len(room)
            room.append(0)
        room[g] += n
        while open_ < len(room) and room[open_] >= 0.95 * budget:
            open_ += 1
        table.append((list(c), g, len(c)))
    groups = F.broadcast(spark.createDataFrame(table, "_c array<int>, _group int, _whole int"))
    deepest = max((len(c) for c, _ in done), default=1)
    out = None
    for d in range(1, deepest + 1):  # each row meets the one class that holds it
        part = leaves.withColumn("_c", F.array(*levels[:d])).join(groups.where(F.col("_whole") == d), "_c").drop("_c")
        out = part if out is None else out.unionByName(part)
    return out


def _subtrees(depth: int, least: int):
    """Node totals of one group: suffixes in order, each node a run of those that begin alike."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, part in rows.groupby("lang", sort=False):
            width = 8 * depth
            raw = b"".join(k.ljust(width, b"\0") for k in part["key"])
            words = np.frombuffer(raw, ">u8").reshape(len(part), depth).astype(np.uint64)
            size = np.fromiter(map(len, part["key"]), np.int64, len(part)) // 8
            order = np.lexsort([size, *words.T[::-1]])
            words, size = words[order], size[order]
            n, whole = part["n"].to_numpy()[order], part["_whole"].to_numpy()[order]
            fresh = np.zeros(len(words), bool)  # a run of another prefix begins here
            fresh[0] = True
            for d in range(1, depth + 1):
                fresh[1:] |= words[1:, d - 1] != words[:-1, d - 1]
                has = size >= d
                new = fresh | np.concatenate([[True], has[1:] != has[:-1]])
                begin = np.flatnonzero(new)
                total = np.add.reduceat(n, begin)
                # a node whose prefix is spread over groups gives its part, any other only a total that counts
                keep = has[begin] & ((total >= least) | (d < whole[begin])) & (d > 1)
                some = begin[keep]
                if len(some):
                    keys = words[some, :d].astype(">u8").tobytes()
                    out.append(pd.DataFrame({"lang": lang, "key": [keys[k * 8 * d : (k + 1) * 8 * d] for k in range(len(some))], "n": total[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "key": [], "n": np.zeros(0, np.int64)})

    return run


def phrase_counts(docs: DataFrame, least: int = 100, depth: int = 5, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(words, phrases) of ``docs`` (lang, text): (lang, key, word, n) of all words and (lang, key, n) of phrases of 2 to
    ``depth`` words that occur at least ``least`` times within pieces, overlaps included.

    A key is the words' 64-bit hashes, big-endian, one after the other. Counts are exact but
    for the chance that two words share a hash (1e-7 for a million different words).
    No word, pair or longer phrase is a task: equal suffixes are added up before every
    shuffle, and a prefix over the budget is taken apart by its next words. The filters (2 MB
    each, whatever the data) only leave out what cannot reach ``least``.
    """
    spark = docs.sparkSession
    lang, text = F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit(""))
    slim = bounded(docs.select(lang.alias("lang"), text.alias("text")))
    words = slim.mapInPandas(_counted_words, "lang string, hash bigint, word string, n bigint")
    words = cut_lineage(words.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n")))
    sc = spark.sparkContext

    # the salt of a language and the mixing are done where the texts are read; here by a small helper
    @F.pandas_udf("bigint")
    def salted(langs: pd.Series, hashes: pd.Series) -> pd.Series:
        salts = {x: _salt(x) for x in langs.unique()}
        h = hashes.to_numpy(np.int64).view(np.uint64)
        return pd.Series(_mixed(h ^ langs.map(salts).to_numpy(np.uint64)).view(np.int64))

    usual = words.where(F.col("n") >= least).select(salted("lang", "hash").alias("s"))
    word_bits = sc.broadcast(_Bits(usual, _counter("s")))
    pairs = slim.mapInPandas(_counted_pairs(lambda: word_bits.value), "c int, n bigint")
    pairs = pairs.groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pair_bits = sc.broadcast(_Bits(pairs, F.col("c").cast("long")))
    leaves = slim.mapInPandas(_suffixes(lambda: word_bits.value, lambda: pair_bits.value, depth), "lang string, key binary, n bigint")
    leaves = cut_lineage(leaves.groupBy("lang", "key").agg(F.sum("n").alias("n")))
    budget = min(budget, max(LEAST_BUDGET, leaves.count() // GROUPS))
    grouped = vertical_partition(leaves, budget, depth)
    nodes = grouped.groupBy("_group").applyInPandas(_subtrees(depth, least), "lang string, key binary, n bigint")
    phrases = nodes.groupBy("lang", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    keyed = words.select("lang", F.unhex(F.lpad(F.hex("hash"), 16, "0")).alias("key"), "word", "n")
    return keyed, cut_lineage(phrases)


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, top: int = 2_000, budget: int = BUDGET) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count; the cut into two parts (counts ``l`` and ``r``) with the least
    ``floor(1000 a n / (l r))`` scores it, of equal ones the first; ``n`` are all words of the
    language. Phrases inside a longer one of the same count are left out. All arithmetic is
    on decimals of 38 digits.

    Defined cases: null texts are empty, a null language is ``und``; ties go by count, then by
    the phrase's UTF-8 bytes; repeated rows count each time; other columns are not read; an
    empty table gives an empty result.
    """
    words, phrases = phrase_counts(docs, least, depth, budget)
    size = (F.octet_length("key") / 8).cast("int")
    counted = words.groupBy("lang").agg(F.sum("n").alias("n"))
    usual = words.where(F.col("n") >= least)
    parts = cut_lineage(usual.select("lang", "key", "n").unionByName(phrases))
    # a longer phrase of the same count that holds it, one word longer: then all between have that count, too
    inner = F.explode(F.array(F.expr("substring(key, 1, octet_length(key) - 8)"), F.expr("substring(key, 9)")))
    longer = phrases.where(size > 2).select("lang", inner.alias("key"), F.col("n").alias("_longer"))
    longer = longer.groupBy("lang", "key").agg(F.max("_longer").alias("_longer"))
    kept = phrases.join(longer, ["lang", "key"], "left").where("_longer IS NULL OR _longer < n").drop("_longer")

    cuts = kept.select("lang", "key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring(key, 1, 8 * k)").alias("_l"), F.expr("substring(key, 8 * k + 1)").alias("_r"))
    sides = broadcast_if_small(parts)
    left = sides.select("lang", F.col("key").alias("_l"), F.col("n").alias("l"))
    right = sides.select("lang", F.col("key").alias("_r"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "_l"]).join(right, ["lang", "_r"]).join(broadcast_if_small(counted), "lang")

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    over = ((F.lit(1000) * F.col("a")).cast("decimal(19,0)") * wide("n")).cast("decimal(38,0)")
    scored = scored.withColumn("_over", over).withColumn("_under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("_over div _under"))
    best = scored.groupBy("lang", "key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("_b")).select("lang", "key", "_b.*")

    spelled = best.select("lang", "key", F.posexplode(F.expr("transform(sequence(0, octet_length(key) div 8 - 1), i -> substring(key, CAST(8 * i + 1 AS int), 8))")).alias("_i", "_w"))
    names = broadcast_if_small(usual.select("lang", F.col("key").alias("_w"), "word"))
    text = spelled.join(names, ["lang", "_w"]).groupBy("lang", "key").agg(F.sort_array(F.collect_list(F.struct("_i", "word"))).alias("_t"))
    text = text.select("lang", "key", F.array_join(F.transform("_t", lambda x: x["word"]), " ").alias("phrase"))
    rows = best.join(text, ["lang", "key"]).select("lang", "phrase", "a", "l", "r", "n", "score")
    return top_n(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top).withColumn("rank", F.col("rank").cast("long"))
