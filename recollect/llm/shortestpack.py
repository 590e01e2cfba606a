"""Sequence packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.batches import bounded
from recollect.llm.packing import BLANK, DIGIT, GATHERED, LETTER, OTHER, STRANGE, _WordIds
from recollect.session import broadcast_if_small, cut_lineage

LONG = 64  # bytes of the longest unit that is remembered
UNITS, TABLE_BITS = 1_200_000, 21  # units whose ids a Python worker remembers; log2 of the places of their table
END = 255  # a byte that UTF-8 has not, behind each document
_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")  # nothing before changes how the text is parted from here on
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[128:] = STRANGE
_KIND[[28, 29, 30, 31, 127]] = STRANGE  # controls that some hold for white space
# Byte-level vocabularies write a printable Latin-1 byte as its character and the others, in order, from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELL = np.arange(256, dtype="<u2")
_SPELL[sorted(set(range(256)) - set(_PLAIN))] = 256 + np.arange(256 - len(_PLAIN))


class ByteIds(_WordIds):
    """Ids of texts by a byte-level BPE whose pattern parts letters, digits, other characters and white space.

    A unit is a run of one kind with the blank before it; the pattern parts there whatever
    stands around. Units are found by a 64-bit hash, a whole batch at once; new ones go to
    the tokenizer. Between blanks with plain characters on both sides, a stretch that holds
    an apostrophe, the beginning of a special token or a character beyond Latin-1 is one
    unit, parted by the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model  # merges one unit, its bytes written as characters
        self.weights = np.random.default_rng(11).integers(0, 1 << 64, LONG, dtype=np.uint64)
        self._reset()

    def _learn(self, units: list[str], odd: np.ndarray) -> np.ndarray:
        """Adds the ids of new units to the pool; their numbers. Odd ones are text, the others spelled byte by byte."""
        found: list[list[int]] = [[]] * len(units)
        merge = self.model.tokenize
        for k in np.flatnonzero(~odd).tolist():
            found[k] = [t.id for t in merge(units[k])]
        rows = np.flatnonzero(odd).tolist()
        for k, e in zip(rows, self.whole.encode_batch_fast([units[k] for k in rows], add_special_tokens=False) if rows else ()):
            found[k] = e.ids
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        number = np.arange(len(self.start), len(self.start) + len(n))
        self.start = np.concatenate([self.start, self.used + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.used += len(ids)
        return number

    def _reset(self) -> None:
        super()._reset()
        self.keys, self.slots = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the units with these hashes; -1: not seen."""
        out = np.full(len(h), -1, np.int64)
        at, slot = np.arange(len(h)), (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(at):
            key = self.keys[slot]
            hit = key == h[at]
            out[at[hit]] = self.slots[slot[hit]]
            go = ~hit & (key != 0)
            at, slot = at[go], (slot[go] + 1) % (1 << TABLE_BITS)
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Enters different hashes, each into the first free place from its own on."""
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            one = np.zeros(len(h), bool)
            one[np.unique(slot, return_index=True)[1]] = True
            one &= free
            self.keys[slot[one]], self.slots[slot[one]] = h[one], number[one]
            h, number, slot = h[~one], number[~one], (slot[~one] + 1) % (1 << TABLE_BITS)

    @staticmethod
    def _units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of documents (each with ``END`` behind it), where units begin and which are odd; ``END`` is a unit."""
        a = np.frombuffer(data, np.uint8)
        kind = _KIND[a]
        lead = np.flatnonzero(a[:-1] == 0xC3)
        second = a[lead + 1]
        lead = lead[(second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        end = a == END
        kind[end] = STRANGE + 1
        blank = kind == BLANK
        after = np.append(kind[1:], STRANGE + 1)  # the next byte's kind
        before = np.append(STRANGE + 1, kind[:-1])
        plain_after, plain_before = (after >= LETTER) & (after <= OTHER), (before >= LETTER) & (before <= OTHER)
        strange = (kind == STRANGE) | (a == 39)
        strange[:-1] |= (a[:-1] == 60) & (a[1:] == 124)
        # where nothing before can change what comes: a blank between plain characters, documents
        safe = end | (before == STRANGE + 1) | ((a == 32) & plain_before & plain_after)
        begin_safe = np.flatnonzero(safe)
        odd_part = np.logical_or.reduceat(strange, begin_safe)
        odd = np.repeat(odd_part, np.append(begin_safe[1:], len(a)) - begin_safe)
        # white space: all but its last character before other text is a unit; a last blank goes with what follows
        run = blank & (before != BLANK)
        last = blank & (after != BLANK) & (after != STRANGE + 1)
        head = ~blank & (before != kind) & ~((before == BLANK) & (np.append(0, a[:-1]) == 32))
        begin = np.flatnonzero(safe | (~odd & (run | last | head)))
        return a, begin, odd[begin]

    def _numbers(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the units begin and their numbers (``END``: that of the empty unit)."""
        a, begin, odd = self._units(data)
        size = np.append(begin[1:], len(a)) - begin
        inside = np.arange(len(a)) - np.repeat(begin, size)
        h = np.add.reduceat((a + np.uint64(1)) * self.weights[np.minimum(inside, LONG - 1)], begin)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        short = size <= LONG
        number = np.full(len(h), -1, np.int64)
        number[short] = self._find(h[short])
        new = np.flatnonzero(number < 0)
        if len(new):
            known, at, back = np.unique(np.where(short[new], h[new], np.uint64(2) * new.astype(np.uint64)), return_index=True, return_inverse=True)
            where = new[at]
            spelled = _SPELL[a].tobytes().decode("utf-16-le")
            at, to, strange = begin[where].tolist(), (begin[where] + size[where]).tolist(), odd[where]
            texts = [data[x:y].decode() if o else "" if a[x] == END else spelled[x:y] for x, y, o in zip(at, to, strange.tolist())]
            mine = self._learn(texts, strange)
            number[new] = mine[back]
            keep = short[where]
            self._put(known[keep], mine[keep])
        return begin, number

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.start) > UNITS or self.used > 8 * UNITS:
            self._reset()
        docs = [(t or "").encode() for t in texts]
        if not docs:
            return []
        begin, number = self._numbers(b"\xff".join(docs) + b"\xff")
        n = self.length[number]
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(self.start[number] - stop + n, n) + np.arange(int(stop[-1]))].astype("<u4").tobytes()
        ends = np.cumsum([len(d) + 1 for d in docs])
        cut = (4 * np.concatenate([[0], stop])[np.searchsorted(begin, ends)]).tolist()
        return [ids[x:y] for x, y in zip([0, *cut], cut)]


# --- the plan -------------------------------------------------------------------------

# a part: (length of the tails it is cut from, rank of the first, where it starts in them, its length)
Part = tuple[int, int, int, int]
# packs alike: (how many, tokens in each, parts); the i-th pack holds each part of the tail at its rank + i
Packs = tuple[int, int, tuple[Part, ...]]


class _Open:
    """Packs by their fill, so that the shortest are found first."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_fill: dict[int, list[Packs]] = {}
        self.full: list[Packs] = []

    def add(self, packs: Packs) -> None:
        if packs[0]:
            (self.full if packs[1] == self.capacity else self.by_fill.setdefault(packs[1], [])).append(packs)

    def shortest(self) -> int | None:
        return min(self.by_fill, default=None)

    def take(self, fill: int) -> Packs:
        rows = self.by_fill[fill]
        packs = rows.pop()
        if not rows:
            del self.by_fill[fill]
        return packs

    def place(self, part: Part, n: int, fill: int) -> int:
        """Puts a part of up to ``n`` tails into packs of this fill, one each; how many were placed."""
        have, _, parts = self.take(fill)
        m = min(have, n)
        self.add((m, fill + part[3], (*parts, part)))
        self.add((have - m, fill, tuple((r, rank + m, start, size) for r, rank, start, size in parts)))
        return m


def shortest_pack_plan(counts: dict[int, int], capacity: int) -> list[Packs]:
    """Packs for ``counts`` (length -> tails, each shorter than ``capacity``).

    Lengths are placed longest first, each into the shortest pack; where it doesn't fit a new
    pack is opened. Only patterns and their counts are kept, never single packs. At the end
    the shortest packs are taken apart again as long as the gaps of the others can hold their
    tokens, and fill these gaps, cut where they have to be. So fewer than ``capacity`` places
    stay empty in all packs together.
    """
    packs = _Open(capacity)
    for size in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        rank, left = 0, counts[size]
        while left:
            fill = packs.shortest()
            if fill is None or fill + size > capacity:
                packs.add((-(-left // (capacity // size)), 0, ()))
                fill = 0
            m = packs.place((size, rank, 0, size), left, fill)
            rank, left = rank + m, left - m
    return _closed(packs)


def _closed(packs: _Open) -> list[Packs]:
    capacity = packs.capacity
    gaps = sum(n * (capacity - fill) for fill, rows in packs.by_fill.items() for n, _, _ in rows)
    loose: dict[int, list[tuple[Part, int]]] = {}  # by length: parts to be placed and how many
    while (fill := packs.shortest()) is not None:
        have, _, parts = packs.take(fill)
        m = min(have, gaps // capacity)  # a pack goes: its gap is lost, its tokens need room
        if m:
            gaps -= m * capacity
            for p in parts:
                loose.setdefault(p[3], []).append((p, m))
        packs.add((have - m, fill, tuple((r, rank + m, start, size) for r, rank, start, size in parts)))
        if m < have:
            break
    while loose:
        size = max(loose)
        rows = loose[size]
        (r, rank, start, _), n = rows.pop()
        if not rows:
            del loose[size]
        fill = packs.shortest()
        here = min(size, capacity - fill)
        m = packs.place((r, rank, start, here), n, fill)
        if here < size:
            loose.setdefault(size - here, []).append(((r, rank, start + here, size - here), m))
        if m < n:
            loose.setdefault(size, []).append(((r, rank + m, start, size), n - m))
    return packs.full + [p for rows in packs.by_fill.values() for p in rows]


def _places(plan: list[Packs]) -> tuple[dict[int, tuple[np.ndarray, list[list[tuple[int, int, int, int, int]]]]], int]:
    """For each length the ranks at which its cutting changes and for each such stretch the parts of a tail:
    (first rank, start, length, first sequence, offset); and the number of sequences."""
    rows: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
    base = 0
    for n, _, parts in plan:
        at = 0
        for r, rank, start, size in parts:
            rows.setdefault(r, []).append((rank, n, start, size, base, at))
            at += size
        base += n
    out = {}
    for r, some in rows.items():
        marks = sorted({x for rank, n, *_ in some for x in (rank, rank + n)})
        index = {x: k for k, x in enumerate(marks)}
        cells: list[list[tuple[int, int, int, int, int]]] = [[] for _ in marks]
        for rank, n, start, size, seq, at in sorted(some, key=lambda x: x[2]):
            for k in range(index[rank], index[rank + n]):
                cells[k].append((rank, start, size, seq, at))
        out[r] = (np.array(marks), cells)
    return out, base


# --- Spark ----------------------------------------------------------------------------

_readers: dict[str, ByteIds] = {}


def _stretches(text: str) -> Iterator[str]:
    """A long text in stretches that are encoded one by one."""
    at = 0
    while len(text) - at > 2 * GATHERED and (m := _CUT.search(text, at + GATHERED)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _encoded(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text; stretches of about ``GATHERED`` characters in all are encoded together."""
    if path not in _readers:
        _readers[path] = ByteIds(path)
    held: list[tuple[str, bool]] = []  # a stretch, and whether its text ends there
    size, open_ = 0, b""
    parts = ((p, last) for t in texts for p, last in _marked(_stretches(t or "")))
    for p, last in _marked(parts):
        held.append(p)
        size += len(p[0])
        if size >= GATHERED or last:
            for (_, done), ids in zip(held, _readers[path].encode([x for x, _ in held])):
                open_ += ids
                if done:
                    yield open_
                    open_ = b""
            held, size = [], 0


def _marked(items: Iterator) -> Iterator[tuple]:
    """(item, whether it is the last)."""
    before = next(items, None)
    while before is not None:
        after = next(items, None)
        yield before, after is None
        before = after


def _read(path: str, end_id: int, capacity: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Documents as their full pieces' CRCs and their tail's ids, numbered within the task."""
    names = ["_task", "doc_tokens", "_crcs", "_full", "_size", "_tail", "_rank"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, task, step = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), 4 * capacity
        seen: Counter = Counter()
        for b in batches:
            rows = []
            for ids in _encoded(b["_text"].tolist(), path):
                ids += end
                full, rest = divmod(len(ids), step)
                crcs = [zlib.crc32(ids[k : k + step]) for k in range(0, full * step, step)]
                rows.append((task, len(ids) // 4, crcs, seen[capacity], rest // 4, ids[full * step :], seen[rest // 4] if rest else 0))
                seen[capacity] += full
                if rest:
                    seen[rest // 4] += 1
            columns = dict(zip(names, zip(*rows) if rows else [()] * len(names)))
            yield b.drop(columns="_text").assign(**{c: pd.Series(list(v), index=b.index, dtype=object) for c, v in columns.items()})

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, text: str = "text") -> DataFrame:
    """One row per piece of each document: ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its ids and ``end_id``. Full pieces are sequences of their own; the tails
    are packed shortest-pack-first. Only the histogram of their lengths (fewer than
    ``capacity`` rows) comes to the driver. A tail finds its places by its rank among those
    of its length: tasks number their tails as they read, and the counts of earlier tasks are
    added, so no text or id is shuffled and a length that a third of all documents have is
    no group. The numbered tails are checkpointed: plan and places read the same rows even
    if executors are lost.

    Defined cases: a null text counts as empty (one piece that holds ``end_id``); equal and
    repeated rows are packed each; columns with the names of the result and ``text`` are
    replaced; an empty table gives an empty result.
    """
    made = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    keys = [c for c in docs.columns if c != text and c not in made]
    own = {f"k{i}": c for i, c in enumerate(keys)}  # by other names meanwhile
    slim = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in own.items()], F.col(text).alias("_text"))
    schema = T.StructType([f for f in slim.schema if f.name != "_text"])
    for name, kind in (("_task", T.IntegerType()), ("doc_tokens", T.LongType()), ("_crcs", T.ArrayType(T.LongType())), ("_full", T.LongType()),
                       ("_size", T.IntegerType()), ("_tail", T.BinaryType()), ("_rank", T.LongType())):
        schema = schema.add(name, kind)
    read = bounded(slim).mapInPandas(_read(tokenizer, end_id, capacity), schema)
    read = cut_lineage(read)
    counts = read.where("_size > 0").groupBy("_task", "_size").agg(F.count(F.lit(1)).alias("_n")).unionByName(
        read.groupBy("_task").agg(F.sum(F.size("_crcs")).cast("long").alias("_n")).select("_task", F.lit(capacity).alias("_size"), "_n"))
    counts = cut_lineage(counts)
    histogram = {r[0]: int(r[1]) for r in counts.groupBy("_size").agg(F.sum("_n")).collect()}
    places, sequences = _places(shortest_pack_plan({n: c for n, c in histogram.items() if n < capacity}, capacity))
    before = Window.partitionBy("_size").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", "_size", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    full = offsets.where(F.col("_size") == capacity).select("_task", F.col("_off").alias("_foff"))
    ranked = read.join(broadcast_if_small(full), "_task").join(
        broadcast_if_small(offsets.where(F.col("_size") < capacity)), ["_task", "_size"], "left")

    @F.pandas_udf("array<struct<start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint>>")
    def place(crcs: pd.Series, first: pd.Series, tail: pd.Series, rank: pd.Series) -> pd.Series:
        out = []
        for c, f, t, k in zip(crcs, first.tolist(), tail, rank.tolist()):
            pieces = [(j * capacity, capacity, int(x), sequences + f + j, 0) for j, x in enumerate(c)]
            if t:
                at = len(c) * capacity
                marks, cells = places[len(t) // 4]
                for rank0, start, size, seq, off in cells[int(np.searchsorted(marks, k, side="right")) - 1]:
                    pieces.append((at + start, size, zlib.crc32(t[4 * start : 4 * (start + size)]), seq + k - rank0, off))
            out.append(pieces)
        return pd.Series(out)

    at = place.asNondeterministic()("_crcs", F.col("_foff") + F.col("_full"), "_tail", F.coalesce(F.col("_off") + F.col("_rank"), F.lit(0)))
    placed = ranked.withColumn("_at", at).select(*own, "doc_tokens", F.explode("_at").alias("_p"))
    return placed.select(*[F.col(k).alias(c) for k, c in own.items()], "doc_tokens", "_p.*")
