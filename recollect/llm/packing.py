"""Sequence packing by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.batches import bounded, gathered
from recollect.session import cut_lineage

WORDS = 500_000  # distinct units whose ids a Python worker remembers before it starts afresh
SLICES = 64  # of each length when ranks are counted
TABLE_BITS = 20
LONG = 256  # bytes of the longest unit that is remembered
GATHERED = 1 << 19  # characters of texts that are encoded together
BLANK, LETTER, DIGIT, OTHER, STRANGE = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[128:] = STRANGE


class _WordIds:
    """Ids of texts as little-endian bytes, word by word.

    The tokenizer parts at white space and between letters, digits and other characters,
    and its merges never cross such a place, so parts can be kept and joined. They are
    found by a 64-bit hash with random weights, a whole batch at once. Parts seen for the
    first time go to the tokenizer together, already lower case and parted by blanks;
    words whose parting or lower case is not that plain go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.parts.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.path, self.whole = path, None
        self.weights = np.random.default_rng(9).integers(0, 1 << 64, LONG, dtype=np.uint64)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)  # open addressing: hash of a word, 0 where free
        self.slots = np.zeros(1 << TABLE_BITS, np.int32)  # its number
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by number: its ids in the pool
        self.pool, self.used = np.zeros(1 << 19, np.uint32), 0

    def _learn(self, units: list[str], odd: np.ndarray) -> np.ndarray:
        """Adds the ids of new units to the pool; their numbers. Plain units are one part each."""
        data = [b""] * len(units)
        plain = np.flatnonzero(~odd).tolist()
        for a in range(0, len(plain), 500):
            some = plain[a : a + 500]
            ids = np.array(self.parts.encode(" ".join([units[k] for k in some]), add_special_tokens=False).ids, dtype="<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(some):
                raise ValueError("the tokenizer parts words otherwise than expected")
            raw = ids.tobytes()
            for k, x, y in zip(some, [0, *stops], stops):
                data[k] = raw[x:y]
        rest = np.flatnonzero(odd).tolist()
        if rest and self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        for k, e in zip(rest, self.whole.encode_batch_fast([units[k] for k in rest], add_special_tokens=False) if rest else ()):
            data[k] = np.array(e.ids, dtype="<u4").tobytes()
        n = np.fromiter(map(len, data), np.int64, len(data)) // 4
        ids = np.frombuffer(b"".join(data), "<u4")
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        number = np.arange(len(self.start), len(self.start) + len(n))
        self.start = np.concatenate([self.start, self.used + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.used += len(ids)
        return number

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes; -1: not seen."""
        out = np.full(len(h), -1, np.int64)
        rows, slot = np.arange(len(h)), (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(rows):
            there = self.keys[slot]
            same = there == h[rows]
            out[rows[same]] = self.slots[slot[same]]
            on = ~same & (there != 0)
            rows, slot = rows[on], (slot[on] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Enters different hashes."""
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(h):
            first = np.zeros(len(h), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            first &= self.keys[slot] == 0
            self.keys[slot[first]], self.slots[slot[first]] = h[first], number[first]
            h, number, slot = h[~first], number[~first], (slot[~first] + 1) & ((1 << TABLE_BITS) - 1)

    @staticmethod
    def _units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case bytes of UTF-8 text, where its units begin, and which are odd; white space belongs to no unit.

        Units are runs of letters, single digits and runs of other characters, for ASCII and
        the letters of Latin-1. A word with any other character, an apostrophe or the
        beginning of a special token is odd and one unit.
        """
        a = np.frombuffer(data, np.uint8).copy()
        kind = _KIND[a]
        lead = np.flatnonzero(a[:-1] == 0xC3)
        second = a[lead + 1]
        lead = lead[(second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        capital = lead[a[lead + 1] < 0x9F] + 1
        a[capital] += 32
        a[(a >= 65) & (a <= 90)] += 32
        blank = kind == BLANK
        strange = (kind == STRANGE) | (a == 39)
        strange[:-1] |= (a[:-1] == 60) & (a[1:] == 124)
        before = np.concatenate([[True], blank[:-1]])
        word = np.flatnonzero(before & ~blank)
        if not len(word):
            return a, word, np.zeros(0, bool)
        odd_word = np.logical_or.reduceat(strange, word)
        odd = np.zeros(len(a), bool)
        odd[word[0] :] = np.repeat(odd_word, np.append(word[1:], len(a)) - word)
        change = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == DIGIT)
        begin = np.flatnonzero(~blank & (before | (change & ~odd)))
        a[blank] = 32
        return a, begin, odd[begin]

    def _numbers(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of UTF-8 text begin and their numbers."""
        a, begin, odd = self._units(data)
        if not len(begin):
            return begin, begin
        lead = int(begin[0])
        gap = np.append(begin[1:], len(a)) - begin  # with the white space behind
        inside = np.arange(lead, len(a)) - np.repeat(begin, gap)
        solid = a[lead:] != 32
        size = np.add.reduceat(solid, begin - lead, dtype=np.int64)
        weighed = (a[lead:] + np.uint64(1)) * self.weights[np.minimum(inside, LONG - 1)]
        weighed[~solid] = 0
        h = np.add.reduceat(weighed, begin - lead)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        short = size <= LONG
        number = np.full(len(h), -1, np.int64)
        number[short] = self._find(h[short])
        new = np.flatnonzero(number < 0)
        if len(new):
            known, at, back = np.unique(np.where(short[new], h[new], np.uint64(2) * new.astype(np.uint64)), return_index=True, return_inverse=True)
            where = new[at]
            raw = a.tobytes()
            mine = self._learn([raw[b : b + n].decode() for b, n in zip(begin[where].tolist(), size[where].tolist())], odd[where])
            number[new] = mine[back]
            keep = short[where]
            self._put(known[keep], mine[keep])
        return begin, number

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.start) > WORDS or self.used > 8 * WORDS:
            self._reset()
        docs = [(t or "").encode() for t in texts]
        begin, number = self._numbers(b" ".join(docs))
        n = self.length[number]
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(self.start[number] - stop + n, n) + np.arange(int(stop[-1]) if len(stop) else 0)].astype("<u4").tobytes()
        ends = np.cumsum([len(d) + 1 for d in docs])
        cut = (4 * np.concatenate([[0], stop])[np.searchsorted(begin, ends)]).tolist()
        return [ids[x:y] for x, y in zip([0, *cut], cut)]


_readers: dict[str, _WordIds] = {}


def _pieces_of(texts: list[str | None], path: str, end_id: int, capacity: int) -> list[list[tuple[int, int, int, int]]]:
    if path not in _readers:
        _readers[path] = _WordIds(path)
    end, out = np.array([end_id], dtype="<u4").tobytes(), []
    for ids in _readers[path].encode(texts):
        ids += end
        n, step = len(ids) // 4, capacity * 4
        out.append([(k, k * capacity, min(capacity, n - k * capacity), zlib.crc32(ids[k * step : (k + 1) * step]))
                    for k in range((n + capacity - 1) // capacity)])
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, text: str = "text") -> DataFrame:
    """One row per piece of each document: ``piece``, ``start``, ``length``, ``ids_crc32``; the text is dropped.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut.
    A null text counts as empty: one piece that holds ``end_id`` alone.
    """
    kind = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in gathered(batches, GATHERED):
            yield pd.Series(_pieces_of(texts, tokenizer, end_id, capacity))

    rest = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids_crc32", "_cut", "_p")]
    # called non-deterministic so that the filter Spark infers from explode() does not run it a second time
    cut_rows = bounded(docs).withColumn("_cut", cut.asNondeterministic()(F.col(text)))
    return cut_rows.select(*rest, F.explode("_cut").alias("_p")).select(*rest, "_p.*")


def bin_slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for ``counts`` (length -> items): (how many bins, [(length, copies in each)]).

    Each bin takes the longest item left; a bitset subset-sum over the lengths left, longest
    first and each up to its count, then finds the fullest feasible rest. The same
    combination is used for as many bins as the counts allow, so every step uses up at
    least one length and the plan has at most as many steps as there are lengths (twice).
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        room = capacity - first
        inside = (1 << (room + 1)) - 1
        reach, steps = 1, []  # bit s: a sum of s is feasible; steps: what each addition made possible
        for n in lengths:
            if n > room or (reach >> room) & 1:
                continue
            copies = min(left[n] - (n == first), room // n)
            k = 1
            while copies > 0 and not (reach >> room) & 1:
                take = min(k, copies)
                after = (reach | (reach << (n * take))) & inside
                steps.append((n, take, reach, after))
                reach, copies, k = after, copies - take, k * 2
        total = reach.bit_length() - 1
        used = {first: 1}
        for n, take, before, _ in reversed(steps):
            if not (before >> total) & 1:  # the sum needs this addition
                used[n] = used.get(n, 0) + take
                total -= n * take
        times = min(left[n] // k for n, k in used.items())
        plan.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return plan


def pack(pieces: DataFrame, capacity: int = 4096, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (column ``length``, 1 to ``capacity``).

    Only the histogram of lengths (``capacity`` rows at most, whatever the data) goes to
    the driver, where the plan is made. Each piece then finds its bin by its rank among
    the pieces of its length; ranks are counted in hashed slices, so a length that holds a
    third of all pieces is ranked by many tasks. ``pieces`` is checkpointed: the plan and
    the ranks read the same rows even if executors are lost.

    Defined cases: pieces that agree in ``key`` are interchangeable; null keys sort first;
    columns ``sequence_id`` and ``offset`` are replaced; an empty table gives an empty result.
    """
    pieces = cut_lineage(pieces.drop("sequence_id", "offset"))
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(SLICES)))
    sizes = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}  # <= capacity rows
    plan = bin_slack_plan(counts, capacity)
    # for each length the ranks at which a step of the plan begins
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for times, items in plan:
        at = 0
        for n, k in items:
            r = taken.get(n, 0)
            table.setdefault(n, []).append((r, base, k, at))
            taken[n] = r + times * k
            at += n * k
        base += times
    arrays = {n: np.array(v, dtype=np.int64) for n, v in table.items()}

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        cuts = np.flatnonzero(np.diff(n[order])) + 1
        for rows in np.split(order, cuts) if len(n) else []:
            size = int(n[rows[0]])
            steps = arrays[size]
            s = steps[np.searchsorted(steps[:, 0], r[rows], side="right") - 1]
            inside = r[rows] - s[:, 0]
            seq[rows] = s[:, 1] + inside // s[:, 2]
            off[rows] = s[:, 3] + inside % s[:, 2] * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = sliced.withColumn(
        "_r", F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*key, *[c for c in ("start", "ids_crc32") if c in pieces.columns])) - 1
    ).join(F.broadcast(offsets), ["length", "_slice"])  # <= capacity x 64 rows
    placed = ranked.withColumn("_at", place(F.col("length"), F.col("_off") + F.col("_r")))
    return placed.select(*pieces.columns, F.col("_at.sequence_id"), F.col("_at.offset"))
