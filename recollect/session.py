"""Session settings, lineage cuts and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound for a side we broadcast ourselves (bytes, estimated from the data).
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(cores: str = "*", app: str = "recollect", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session (tests, benches) gets one of its own when the setting is missing.
    """
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if named is None and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not set_.isDefined():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="recollect-ckpt-"))
        named = named or sc._jsc.sc().getCheckpointDir().get()
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder.

    Iterative operators call this once per round, so a lost executor costs one round.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def first_rows(df: DataFrame) -> list[Row]:
    """Rows of an ordered and limited frame, in order, cut by the executors.

    A plain ``collect()`` of it sends as many rows as the limit from every partition to the driver.
    """
    return cut_lineage(df).collect()


def estimated_bytes(df: DataFrame) -> int:
    """Data size by one aggregate: 16 bytes per field plus string/array contents."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.lit(24) * F.greatest(F.size(F.col(f.name)), F.lit(0))
    return df.select(F.sum(size.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after measuring the side; beyond the limit the join shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
