"""Small tables with the cases every operator has to meet."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "The first line of a text that is read by all.\nThe second line is here.", "en", "a", 70),
    (1, "The first line of a text that is read by all.\nThe second line is here.", "en", "a", 70),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, " \t\n ", "de", "b", 4),
    (None, "Eine Zeile ohne Nummer, die trotzdem da ist.", "de", "b", 44),
    (5, "12345 !!! ???", "fr", "b", 13),
    (6, "wort " * 30_000, "de", "a", 150_000),
    (7, "x" * 50_000, None, "a", 50_000),
    (8, "e\u0301 \u00df \U0001f44d \u6f22\u5b57 \u2581", "fr", "c", 9),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS)


def clashing(df, names):
    """The table with extra columns of the names that the operator makes."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in names})
