"""SentencePiece BPE by suffix-array matching: find all pieces in a batch, then relax edges by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.batches import bounded, gathered

SPACE = "▁"
GATHERED = 3 << 20  # characters of texts that are split and encoded together
INDEX_CHARS = 250_000  # characters that one suffix array covers
CACHE_UNITS = 300_000  # encoded words that a Python worker remembers before it starts afresh
CACHE_PAIRS = 400_000
QUICK_BITS = 19
NUL = 0x110000  # stands for the character 0; 0 parts units


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Positions sorted by the ``length`` codes that follow (0 behind the end), by prefix doubling.

    The first round packs as many codes as fit into one integer.
    """
    bits = max(1, int(text.max(initial=0)).bit_length())
    step = min(length, 62 // bits)
    key = np.zeros(len(text), np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, len(text) - k)] |= text[k:]
    while True:
        order = np.argsort(key, kind="stable")
        if step >= length:
            return order
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        after = np.zeros(len(key), np.int64)
        after[: len(key) - step] = rank[step:]
        key = (rank << 31) + after
        step *= 2


class Pieces:
    """The vocabulary of a SentencePiece BPE model and an encoder for batches of words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in usual}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for t, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size = n
        # bytes that each id decodes to
        self.plain = [b""] * n
        for i, t in self.text.items():
            self.plain[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.plain[i] = bytes([b])
        names = sorted(i for t, i in self.id.items() if t.strip(SPACE) or t == SPACE)
        self.names = np.array(names, np.int64)
        self.longest = max(len(self.text[i]) for i in names)
        self.lens = np.array([len(self.text[i]) for i in names], np.int64)
        self.chars = np.zeros((len(names), self.longest), np.int64)
        for k, i in enumerate(names):
            self.chars[k, : self.lens[k]] = [ord(c) or NUL for c in self.text[i]]
        self.units: dict[str, bytes] = {}  # by word without its space mark
        self.pairs: dict[int, bool] = {}
        self.quick = np.full(1 << QUICK_BITS, -1, np.int64), np.zeros(1 << QUICK_BITS, bool)  # pairs met last, by hash

    # --- merges of short strings, which say whether two neighbours can stay as they are

    def _merged(self, symbols: list[str]) -> list[str]:
        s = list(symbols)
        score = self.score
        while True:
            best, at = None, -1
            for k in range(len(s) - 1):
                v = score.get(s[k] + s[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _token(self, t: int) -> str:
        return self.text[t] if t < self.size else chr(t - self.size)

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE parts left + right into just these two (left -1: right alone stays whole)."""
        key = (left + 1) * (self.size + NUL + 1) + right
        keys, values = self.quick
        slot = (key * 0x1E3779B97F4A7C15 >> (63 - QUICK_BITS)) & ((1 << QUICK_BITS) - 1)
        out = values[slot]
        unknown = np.flatnonzero(keys[slot] != key)
        if len(unknown):
            new, back = np.unique(key[unknown], return_inverse=True)
            found = np.fromiter(map(self._pair, new.tolist()), bool, len(new))
            out[unknown] = found[back]
            keys[slot[unknown]], values[slot[unknown]] = key[unknown], out[unknown]
        return out

    def _pair(self, key: int) -> bool:
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            a, b = divmod(key, self.size + NUL + 1)
            want = [self._token(a - 1)] if a else []
            want.append(self._token(b))
            ok = self.pairs[key] = self._merged(list("".join(want))) == want
        return ok

    # --- matching

    def _ranges(self, codes: np.ndarray, order: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces (rows of ``names``) and for each the range of ``order`` whose suffixes begin with it.

        Two binary searches, all pieces at once. Pieces with a pair of neighbours that the
        text has nowhere are left out before.
        """
        padded = np.concatenate([codes, np.zeros(self.longest, codes.dtype)])
        wanted = dense[self.chars].astype(np.int32)
        inside = np.arange(self.longest) < self.lens[:, None]
        width = int(codes.max(initial=0)) + 1
        beside = np.zeros(width * width, bool)
        beside[codes[:-1] * width + codes[1:]] = True
        able = ((wanted > 0) | ~inside).all(axis=1)
        able &= (beside[wanted[:, :-1] * width + wanted[:, 1:]] | ~inside[:, 1:]).all(axis=1)
        rows = np.flatnonzero(able)
        wanted, inside = wanted[rows], inside[rows]

        def search(past: bool) -> np.ndarray:
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                suffix = padded[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(self.longest)]
                differ = np.where(inside, suffix - wanted, 0)
                first = (differ != 0).argmax(axis=1)
                sign = differ[np.arange(len(differ)), first]
                before = sign <= 0 if past else sign < 0
                lo = np.where(open_ & before, mid + 1, lo)
                hi = np.where(open_ & ~before, mid, hi)
            return lo

        return rows, search(False), search(True)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with the space mark before them (ids from ``size`` on: single characters
        without a piece), one after the other, and where each word's begin.

        Every piece occurrence is an edge between two places. Edges are relaxed in the order
        of their end: the edge counts if BPE leaves it whole beside the last token of the
        best parting of what is before it; exactly one edge into each place does.
        """
        flat = np.frombuffer((SPACE + f"\0{SPACE}".join(units)).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
        begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.append(flat, 0)
        parts = np.zeros(len(text), bool)
        parts[begin + sizes] = True
        text[(text == 0) & ~parts] = NUL
        seen = np.zeros(NUL + 1, bool)
        seen[text] = True
        seen[0] = False
        dense = np.where(seen, np.cumsum(seen), 0)  # codes of the characters at hand, in their order
        codes = dense[text].astype(np.int32)
        order = suffix_order(codes, self.longest)
        rows, lo, hi = self._ranges(codes, order, dense)
        n = hi - lo
        piece = np.repeat(rows, n)
        at = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(piece))]
        token, end = self.names[piece], at + self.lens[piece]
        # characters that are no piece are edges of their own
        single = np.zeros(len(text), bool)
        single[at[self.lens[piece] == 1]] = True
        lone = np.flatnonzero(~single & ~parts)
        token = np.concatenate([token, self.size + np.where(text[lone] == NUL, 0, text[lone])])
        at, end = np.concatenate([at, lone]), np.concatenate([end, lone + 1])
        depth = end - np.repeat(begin, sizes + 1)[at]
        turn = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")
        token, at, end, depth = token[turn], at[turn], end[turn], depth[turn]
        last = np.full(len(text) + 1, -1, np.int64)
        back = np.zeros(len(text) + 1, np.int64)
        is_begin = np.zeros(len(text) + 1, bool)
        is_begin[begin] = True
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(depth)]):
            s, t, e = at[a:b], token[a:b], end[a:b]
            open_ = is_begin[s] | (last[s] >= 0)
            s, t, e = s[open_], t[open_], e[open_]
            ok = self._stable(np.where(is_begin[s], -1, last[s]), t)
            last[e[ok]] = t[ok]
            back[e[ok]] = s[ok]
        # from the ends back to the beginnings: the places where tokens end
        ends = np.zeros(len(text) + 1, bool)
        place = begin + sizes
        while len(place):
            ends[place] = True
            place = back[place]
            place = place[~is_begin[place]]
        stops = np.flatnonzero(ends)
        return last[stops], np.searchsorted(stops, begin, side="right")

    def _know(self, words: list[str]) -> None:
        at = 0
        while at < len(words):
            to, size = at, 0
            while to < len(words) and (to == at or size < INDEX_CHARS):
                size += len(words[to]) + 2
                to += 1
            ids, first = self._encode_units(words[at:to])
            stop = np.append(first[1:], len(ids))
            data = ids.astype("<u4").tobytes()
            self.units.update(zip(words[at:to], [data[4 * a : 4 * b] for a, b in zip(first.tolist(), stop.tolist())]))
            for k in np.unique(np.searchsorted(first, np.flatnonzero(ids >= self.size), side="right") - 1).tolist():
                own = [x for i in ids[first[k] : stop[k]].tolist() for x in ([i] if i < self.size else [self.byte[b] for b in chr(i - self.size).encode()])]
                self.units[words[at + k]] = np.array(own, "<u4").tobytes()
            at = to

    def _spaces(self, n: int) -> bytes:
        """Ids of a run of space marks: merges grow the leftmost run first, so it is cut into longest pieces."""
        out = []
        while n > 0:
            k = n
            while SPACE * k not in self.id:
                k = min(k - 1, self.longest_run)
            out.append(self.id[SPACE * k])
            n -= k
        return np.array(out, "<u4").tobytes()

    @property
    def longest_run(self) -> int:
        return max(len(t) for t in self.id if not t.strip(SPACE))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each text, as the model's own encoder gives them."""
        split = [(SPACE + t.replace(" ", SPACE)).split(SPACE)[1:] if t else [] for t in texts]
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        known = self.units
        self._know(list({w for words in split for w in words if w not in known and w}))
        mark, out = self._spaces(1), []
        for words in split:
            if "" not in words:
                out.append(b"".join([known[w] for w in words]))
                continue
            parts, run = [], 0
            for w in words:
                run += 1
                if w:
                    ids = known[w]
                    if run > 1 and ids[:4] == mark:  # the mark before the word stayed alone, so it joins the run
                        parts += [self._spaces(run), ids[4:]]
                    else:
                        parts += [self._spaces(run - 1), ids]
                    run = 0
            parts.append(self._spaces(run))
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, bytes put together, the first space dropped."""
        data = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of each whole text as packed little-endian 32-bit integers (binary).

    ``decoded`` names a column for the text that these ids decode to, made by the same worker.

    Defined cases: null and empty texts have no ids; repeated rows get the same ids;
    characters without a piece become byte pieces; a column ``name`` is replaced; an empty
    table gives an empty result.
    """

    kind = "struct<ids:binary,decoded:string>" if decoded else "struct<ids:binary>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for texts in gathered(batches, GATHERED):
            ids = m.encode(texts)
            yield pd.DataFrame({"ids": ids, **({"decoded": [m.decode(x) for x in ids]} if decoded else {})}, dtype=object)

    out = bounded(docs).withColumn("_encoded", run(F.col(text))).withColumn(name, F.col("_encoded.ids"))
    return (out.withColumn(decoded, F.col("_encoded.decoded")) if decoded else out).drop("_encoded")


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of packed ids. Null ids give a null text. U+2581 comes back as a blank."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for b in batches:
            yield pd.Series([None if x is None else m.decode(x) for x in b], dtype=object)

    return rows.withColumn(name, run(F.col(ids)))
