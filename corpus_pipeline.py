"""From raw documents to packed sequences: language, quality, near-duplicates, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import langid, packing, quality, simhash
from recollect.session import shared_folder

# A document whose best language has less than this share of the probability is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a language that the network finds likely.

    The network learns from a bounded sample of the labelled rows. Columns stay as they are;
    if no row is labelled, nothing can be told and only texts without a letter go.
    """
    net = langid.train(*langid.training_sample(docs.where(F.col("lang").isNotNull())))
    if not net.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    labelled = langid.label(docs.withColumn("_text", F.col("text")).select(F.struct(*docs.columns).alias("_row"), "_text"), net, "_text")
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes bad lines out of the texts and rejects documents that fail the base rules or lose over half.

    ``n_chars`` becomes the length of the cleaned text.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    kept = quality.quality(row).where("kept")
    columns = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return kept.select(*[columns.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity about 0.8 or more) stays."""
    return simhash.drop_near_duplicates(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4,096 tokens: one row per piece."""
    cut = packing.token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 1, 4096)
    return packing.pack(cut, 4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("sequences", sequences),
]

# No SQL for a recurrent network, fingerprint links and token ids; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
