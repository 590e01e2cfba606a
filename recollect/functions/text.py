"""Text expressions: tokens, keywords, canonical names, links. All JVM-side columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

# Words a query keyword may not be.
STOP_WORDS = (
    "的 了 在 是 我 你 他 她 它 "
    "有 不 也 就 都 而 及 与 和 "
    "这 那 什么 怎么 吗 吧 呢 啊 哦 "
    "嗯 哈 呀 啦 嘛 一个 这个 那个 "
    "会 能 可以 要 想 给 把 被 "
    "好 很 太 更 最 真 还 又 再"
).split()

_HAN = r"\p{IsHan}"
_WORD = r"[\p{L}\p{N}_]+"
_MIXED = rf"{_HAN}+|[\p{{L}}\p{{N}}_&&[^{_HAN}]]+"


def ascii_lower(c: Column) -> Column:
    """Case folding of ASCII letters only (what the containment match uses)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _han_bigrams(run: Column) -> Column:
    return overlapping(run, 2)


def words(c: Column) -> Column:
    """Default segmenter: letter/digit runs, Han runs as overlapping bigrams.

    A caller with a real segmenter passes its own column function (for example a
    pandas UDF) wherever an operator takes ``tokenizer``.
    """
    def found(pattern: str) -> Column:
        return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))

    split_han = F.flatten(F.transform(found(_MIXED), lambda r: F.when(r.rlike(f"^{_HAN}"), _han_bigrams(r)).otherwise(F.array(r))))
    # most texts are plain ASCII, where the cheapest pattern does
    return F.when(F.octet_length(c) == F.length(c), found("[a-z0-9_]+")).when(c.rlike(_HAN), split_han).otherwise(found(_WORD))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it by name in ``body``.

    Without it the optimizer inlines a computed column everywhere it is used, also
    inside lambdas, where it would run once per element.
    """
    return F.transform(F.array(value), body)[0]


def overlapping(c: Column, n: int) -> Column:
    """All overlapping runs of ``n`` characters, in one linear regex pass."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1))


def runs(c: Column) -> Column:
    """Letter/digit runs, unsegmented."""
    return F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))


def _char_bigrams(c: Column, at_least: int) -> Column:
    chars = F.regexp_replace(c, " ", "")
    return F.when(F.length(chars) >= at_least, overlapping(chars, 2))


def index_tokens(c: Column, tokenizer: Tokenizer = words) -> Column:
    """Tokens to index, with repeats: words of two characters or more, else bigrams."""
    short = F.coalesce(_char_bigrams(c, 2), F.array().cast("array<string>"))
    return let(F.filter(tokenizer(c), lambda w: F.length(w) >= 2), lambda w: F.when(F.size(w) > 0, w).otherwise(short))


def index_vocabulary(c: Column, tokenizer: Tokenizer = words) -> Column:
    """Distinct tokens to index; words of one character may stay, which no keyword is asked by."""
    short = F.coalesce(_char_bigrams(c, 2), F.array().cast("array<string>"))
    return let(F.array_distinct(tokenizer(c)), lambda w: F.when(F.exists(w, lambda x: F.length(x) >= 2), w).otherwise(F.array_distinct(short)))


def token_set(c: Column, tokenizer: Tokenizer = words) -> Column:
    """Distinct words (>= 2 chars); short texts fall back to >= 2 bigrams of >= 4 chars, else null."""
    def grams() -> Column:
        return let(F.array_distinct(_char_bigrams(c, 4)), lambda g: F.when(F.size(g) >= 2, g))

    long_words = F.array_distinct(F.filter(tokenizer(c), lambda w: F.length(w) >= 2))
    return let(long_words, lambda w: F.when(F.size(w) > 0, w).otherwise(grams()))


def bigram_set(c: Column) -> Column:
    """Distinct character bigrams of the space-stripped text; null under 4 characters."""
    return F.array_distinct(_char_bigrams(c, 4))


def keywords(c: Column, limit: int | None = None, tokenizer: Tokenizer = words) -> Column:
    """Query keywords: ASCII words whole, other words >= 2 chars, no stop words; all or the first ``limit``."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(
        tokenizer(c),
        lambda w: (w.rlike("^[a-z0-9_]+$") | (F.length(w) >= 2)) & ~F.array_contains(stop, w),
    )
    return F.array_distinct(kept) if limit is None else F.slice(F.array_distinct(kept), 1, limit)


def is_ascii_word(c: Column) -> Column:
    return c.rlike("^[a-z0-9_]+$")


def wikilinks(c: Column) -> Column:
    """Names in ``[[...]]``, trimmed, first occurrence order, no repeats."""
    found = F.regexp_extract_all(c, F.lit(r"\[\[([^\[\]]+?)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 0))


def canonical_name(c: Column) -> Column:
    """Node key of a name: lower case, spaces to ``_``, full-width marks to ASCII."""
    tight = F.regexp_replace(F.trim(F.lower(c)), r"\s+", "_")
    return F.translate(tight, "（）：；", "():;")


def segments(c: Column, at_least: int = 4) -> Column:
    """Sentences: cut after ``。！？`` and newlines, trimmed, short ones dropped."""
    parts = F.transform(F.split(c, r"(?<=[。！？\n])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= at_least)
