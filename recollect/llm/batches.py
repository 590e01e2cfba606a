"""Bounds what one Arrow batch of texts holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

RECORDS = 500  # rows of a batch: texts may be long
CHARS = 6 << 20  # characters that an operator gathers before it works on them


def bounded(df: DataFrame) -> DataFrame:
    """``df``, its session set to send Python at most 500 rows at a time (Spark's default is 10,000)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= RECORDS:
        conf.set(name, RECORDS)
    return df


def gathered(batches: Iterator[pd.Series], chars: int = CHARS) -> Iterator[list[str | None]]:
    """Lists of texts with at least ``chars`` characters (the last may have fewer) and at most one batch more."""
    held: list[str | None] = []
    size = 0
    for b in batches:
        held += b.tolist()
        size += sum(len(t) for t in b if t)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held
