"""Quality rules, line first: bad lines go, then documents that lost too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Any character but white space belongs to a word.
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
# Fixed phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved", "cookie", "javascript", "terms of use", "terms of service", "privacy policy",
    "lorem ipsum", "subscribe to our newsletter", "licensed under", "released under the",
)
# Fixed values. Marks that end a sentence or a quotation, in all scripts; besides these closing brackets and quotes of any kind.
END_MARKS = ".!?\u2026:;\"'\u2018\u201a\u201c\u201e\u00ab\u2039\u203d\u2047\u2048\u2049\u3002\uff01\uff0e\uff1f\uff1a\uff1b\uff61\u061f\u06d4\u061b\u0964\u0965\u0589\u055c\u055e\u1362\u1367\u1368\u104a\u104b\u17d4\u17d5\u0e2f\u0e5a\u0df4\u1803\u1809"
# A line this long is running text whatever its last character; a row of fields this short is a menu or a table.
LONG_LINE, FIELD = 200, 25
# Most of a document's text that bad lines may hold.
LOST = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's argument is not expanded again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; empty for null. White space becomes blanks first: one-character splits need no regex."""
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(blanks, " "), "")


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in ``w``, the first included.

    Windows are compared as 64-bit hashes. Without a repeated hash the answer is 0 after
    one pass; else windows sorted by (hash, place) show the repeated places, and sorted
    places show how many words they cover: ``min(3, gap to the next place)`` each.
    """
    grams = F.transform(
        F.arrays_zip(
            F.slice(w, 1, F.size(w) - 2).alias("a"), F.slice(w, 2, F.size(w) - 2).alias("b"),
            F.slice(w, 3, F.size(w) - 2).alias("c"),
        ),
        lambda x: F.xxhash64(x["a"], x["b"], x["c"]),
    )

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            # each window beside its neighbours in the sorted order
            beside = F.arrays_zip(
                s.alias("x"),
                F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s).alias("l"),
                F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("r"),
            )
            again = F.filter(beside, lambda z: (z["x"]["h"] == z["l"]["h"]) | (z["x"]["h"] == z["r"]["h"]))
            return F.sort_array(F.transform(again, lambda z: z["x"]["i"]))

        def cover(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return _let(_let(placed, places), cover)

    counted = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(counted)


def _bad_line(line: Column) -> Column:
    """A line that is not running text: no end mark, a menu or table row, symbols, shouting, boilerplate.

    Only a line under ``LONG_LINE`` characters fails for its last one. Rows are told by three
    or more separators (``|``, ``›``, ``•``, or ``»`` and ``·`` between blanks) with fewer than
    ``FIELD`` characters to a field, so quotations and dots inside words in prose are none.
    """

    def bad(body: Column) -> Column:
        chars = F.length(body)
        spaced = sum((chars - F.length(F.replace(body, F.lit(f" {x} "), F.lit("")))) / 3 for x in "»·")
        fields = chars - F.length(F.translate(body, "|›•", "")) + spaced
        row = (fields >= 3) & (chars < FIELD * (fields + 1))
        symbols = chars - F.length(F.translate(body, SYMBOLS, ""))
        shouted = (F.upper(body) == body) & (F.lower(body) != body) & (chars >= 20)
        last = F.substring(body, -1, 1)
        unended = (chars < LONG_LINE) & ~(last.isin(*END_MARKS) | last.rlike(r"[\p{Pe}\p{Pf}]"))
        plate = (chars < LONG_LINE) & F.lower(body).rlike("|".join(BOILERPLATE))
        return unended | row | (symbols * 20 > chars) | shouted | plate

    return _let(F.rtrim(F.translate(line, "\t\x0b\x0c\r", "    ")), bad)


def clean_lines(text: Column, lost: float = LOST) -> Column:
    """Struct of ``cleaned`` (lines that pass, in order), ``all_chars`` and ``kept_chars``.

    Lines without a word do not count. A line that repeats an earlier one fails.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))

    def judged(x: Column) -> Column:
        return _let(F.filter(F.array_distinct(x), lambda y: ~_bad_line(y)), lambda ok: F.struct(
            F.array_join(ok, "\n").alias("cleaned"),
            F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + F.length(y)).alias("all_chars"),
            F.aggregate(ok, F.lit(0).cast("long"), lambda a, y: a + F.length(y)).alias("kept_chars"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ))

    return _let(lines, judged)


def quality(docs: DataFrame, text: str = "text", lost: float = LOST) -> DataFrame:
    """Adds counts, ``base_failed``, ``kept`` and ``cleaned`` (the text without its bad lines).

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows.
    ``kept``: not ``base_failed``, and bad lines hold at most ``lost`` of the characters of all lines.

    Defined cases: null and empty texts have no words and fail the base rule; repeated rows
    are judged alike; texts of any length are read whole; an empty table gives an empty
    result; columns named like the new ones are replaced. One pass per row, no shuffle.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.drop(*[c for c in made if c != text])
    # made by a generator of one row, so that a later filter on the verdict does not compute it all again
    counted = base.withColumn("_w", words(F.col(text))).select("*", F.explode(F.array(
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            repeat_words(F.col("_w")).alias("n_repeat_words"),
            clean_lines(F.col(text), lost).alias("lines"),
        ))).alias("_q"),
    )
    out = counted.withColumns({
        "n_words": F.col("_q.n_words"), "word_chars": F.col("_q.word_chars"), "n_symbols": F.col("_q.n_symbols"),
        "n_dup_lines": F.col("_q.lines.n_dup_lines"), "n_repeat_words": F.col("_q.n_repeat_words"),
        "cleaned": F.col("_q.lines.cleaned"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.col("_q.lines.all_chars") - F.col("_q.lines.kept_chars")
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (gone <= lost * F.col("_q.lines.all_chars"))
    ).drop("_w", "_q")
