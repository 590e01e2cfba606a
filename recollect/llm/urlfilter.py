"""URL filter: all glob rules run at once as one bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of canonical URLs that are turned into one matrix at a time.
MATRIX_BYTES = 8 << 20


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    low = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """Shift-And over several 64-bit words for many globs.

    In a glob ``*`` stands for any bytes but ``/`` and ``**`` for any bytes at all. Each
    glob takes one start bit and one bit per literal byte; a star is a self-loop on the bit
    before it. One step is ``D = ((D << 1) & literal[c]) | (D & loop[c])``, the shift
    carrying between words; a start bit is nobody's literal, so globs do not leak into
    their neighbours.
    """

    def __init__(self, globs: Sequence[str]):
        literal, loop, start, end, pos = [], [], [], [], 0
        for g in globs:
            start.append(pos)
            data, i = g.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    loop.append((pos, True))
                    i += 2
                elif data[i : i + 1] == b"*":
                    loop.append((pos, False))
                    i += 1
                else:
                    pos += 1
                    literal.append((pos, data[i]))
                    i += 1
            end.append(pos)
            pos += 1
        words = max(1, (pos + 63) // 64)
        self.literal = np.zeros((256, words), np.uint64)
        self.loop = np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        one = np.uint64(1)
        for p, c in literal:
            self.literal[c, p // 64] |= one << np.uint64(p % 64)
        for p, anything in loop:
            rows = np.arange(256) if anything else np.array([c for c in range(256) if c != ord("/")])
            self.loop[rows, p // 64] |= one << np.uint64(p % 64)
        for p in start:
            self.start[p // 64] |= one << np.uint64(p % 64)
        self.end = np.array(end, dtype=np.int64)

    def _run(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Final states; ``rows`` is (n, width) bytes sorted by falling length."""
        state = np.tile(self.start, (len(rows), 1))
        carry = np.zeros_like(state)
        for i in range(rows.shape[1]):
            n = int(np.searchsorted(-lengths, -i, side="left"))  # rows longer than i
            if not n:
                break
            c = rows[:n, i]
            d = state[:n]
            s = carry[:n]
            s[:] = d << np.uint64(1)
            s[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (s & self.literal[c]) | (d & self.loop[c])
        return state

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """(n, globs) booleans. Texts are taken in blocks of similar length."""
        out = np.zeros((len(texts), len(self.end)), bool)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            width = max(1, int(lengths[order[at]]))
            ids = order[at : at + max(1, MATRIX_BYTES // width)]
            at += len(ids)
            block = np.frombuffer(b"".join(texts[k].ljust(width, b"\0") for k in ids), np.uint8).reshape(len(ids), width)
            state = self._run(block, lengths[ids])
            word, bit = self.end // 64, (self.end % 64).astype(np.uint64)
            out[ids] = (state[:, word] >> bit) & np.uint64(1) == 1
        return out


def rule_globs(rule: str) -> tuple[str, str]:
    """The two globs of a host/path rule: the host itself and its subdomains, any end of the path."""
    return f"{rule}**", f"*.{rule}**"


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    globs: Sequence[tuple[str, str]] = (),
    default: str = "allow",
    url: str = "url",
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (verdict, host/path prefix): a rule fits its host and all subdomains if
    the path starts with the rule's path; the longest fitting rule wins. Where no rule
    fits, the longest fitting of ``globs`` (verdict, glob over host and path) decides, else
    ``default``; ``rule`` is null then. A rule's or glob's literal length counts, ties go to the first.

    Defined cases: a null url and one without ``://`` have empty host and path and get the
    default; repeated rows are judged alike; the four new columns replace columns of that
    name; an empty table gives an empty result; urls of any length are read whole.
    """
    compiled, owners = [], []
    for k, (_, r) in enumerate(rules):
        for g in rule_globs(r):
            compiled.append(g)
            owners.append(k)
    for k, (_, g) in enumerate(globs):
        compiled.append(g)
        owners.append(len(rules) + k)
    names = [r for _, r in rules] + [None] * len(globs)
    verdicts = [v for v, _ in rules] + [v for v, _ in globs]
    weight = [(1 << 32) + len(r) for _, r in rules] + [len(g.replace("*", "")) for _, g in globs]
    automaton = Automaton(compiled)

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = np.array(owners, dtype=np.int64)
        force = np.array(weight, dtype=np.int64)[own] if len(own) else np.zeros(0, np.int64)
        for b in batches:
            fits = automaton.matches([x.encode() for x in b])
            if len(own):
                best = np.where(fits, force, -1).argmax(axis=1)
                hit = fits.any(axis=1)
                who = own[best]
            else:
                hit, who = np.zeros(len(b), bool), np.zeros(len(b), int)
            yield pd.DataFrame({
                "rule": [names[w] if h else None for h, w in zip(hit, who)],
                "verdict": [verdicts[w] if h else default for h, w in zip(hit, who)],
            })

    kept = pages.drop("host", "path", "rule", "verdict", "_judged") if url not in ("host", "path", "rule", "verdict") else pages
    return (
        kept.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
        .withColumn("_judged", judge(F.concat("host", "path")))
        .withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")})
        .drop("_judged")
    )
