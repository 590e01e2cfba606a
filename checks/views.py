"""The store's tables as views over the driver's tables.

One SQL text per view serves both engines. Views use whole tables and whole
texts; the modulo arithmetic only assigns values, it never filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.sources.tables import spread

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# tables of long texts: one driver file each, so their rows are dealt over the cores
TEXTS = ("documents", "pages")

NOW = "2024-02-01 00:00:00"

VIEWS: dict[str, str] = {
    "atoms": """
SELECT d.doc_id AS atom_id, concat('u_', CAST(d.doc_id % 20 AS STRING)) AS user_id,
 DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS diary_date,
 CASE d.doc_id % 6 WHEN 0 THEN 'episodic' WHEN 1 THEN 'factual' WHEN 2 THEN 'preference' WHEN 3 THEN 'planned' WHEN 4 THEN 'relational' ELSE 'unknown' END AS atom_type,
 d.text AS content, CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100 AS importance, CAST(0.7 AS DOUBLE) AS confidence,
 CAST(d.doc_id % 5 AS BIGINT) AS access_count,
 CAST(DATE '2023-10-01' + CAST(d.doc_id % 120 AS INT) AS TIMESTAMP) AS created_at,
 CAST(CASE d.doc_id % 6 WHEN 1 THEN 180 WHEN 2 THEN 60 WHEN 3 THEN 7 WHEN 4 THEN 90 ELSE 30 END AS DOUBLE) AS ttl_days,
 CASE d.doc_id % 6 WHEN 3 THEN 'step' WHEN 4 THEN 'linear' ELSE 'exponential' END AS decay_type,
 CASE d.doc_id % 10 WHEN 0 THEN 'dormant' WHEN 1 THEN 'forgotten' ELSE 'active' END AS status, e.embedding
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "diaries": """
SELECT doc_id AS diary_id, DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS date, text AS content,
 CAST((doc_id * 13) % 100 AS DOUBLE) / 100 AS importance,
 CAST(DATE '2023-10-01' + CAST(doc_id % 120 AS INT) AS TIMESTAMP) AS created_at, doc_id % 50 = 0 AS archived
FROM documents""",
    "links": """
SELECT doc_id AS atom_id, doc_id - doc_id % 5 AS diary_id, '' AS snippet, CAST((doc_id * 7) % 10 AS DOUBLE) / 10 AS importance FROM documents
UNION ALL
SELECT doc_id AS atom_id, doc_id * 3 + 1 AS diary_id, '' AS snippet, CAST((doc_id * 3) % 10 AS DOUBLE) / 10 AS importance FROM documents""",
    "messages": """
SELECT conv_id * 1000 + turn AS msg_id, concat('s_', CAST(conv_id AS STRING)) AS session_id, role, text AS content,
 concat('u_', CAST(conv_id % 20 AS STRING)) AS sender_id, concat('User ', CAST(conv_id % 20 AS STRING)) AS sender_name,
 TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL '1' MINUTE AS ts FROM conversations""",
    "activity": """
SELECT event_id AS msg_id, concat('s_', CAST(user_id AS STRING)) AS session_id, concat('u_', CAST(user_id AS STRING)) AS sender_id,
 event_type AS role, CAST(ts AS TIMESTAMP) AS ts FROM events""",
    "mentions": """
SELECT DISTINCT concat('entity:p', CAST(l_partkey % 200 AS STRING)) AS from_node, l_orderkey AS diary_id FROM lineitem""",
    "social": """
SELECT from_user, to_user, 'friend_of' AS relation_type, status, weight, cap FROM (
 SELECT *, row_number() OVER (PARTITION BY from_user, to_user ORDER BY k) AS rn FROM (
  SELECT o_orderkey AS k, concat('u_', CAST(o_custkey AS STRING)) AS from_user, concat('u_', CAST((o_custkey * 7 + o_orderkey) % 50 AS STRING)) AS to_user,
   CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'pending' ELSE 'passive' END AS status,
   CAST(o_orderkey % 100 AS DOUBLE) / 100 AS weight, CAST(CASE o_orderstatus WHEN 'O' THEN 1.0 ELSE 0.4 END AS DOUBLE) AS cap
  FROM orders) x WHERE from_user <> to_user) y WHERE rn = 1""",
    "identities": """
SELECT concat('u_', CAST(c_custkey % 900 AS STRING)) AS uid, CASE c_custkey % 3 WHEN 0 THEN 'qq' WHEN 1 THEN 'webchat' ELSE 'telegram' END AS platform,
 CAST(c_custkey + 1000000 AS STRING) AS platform_id, c_name AS name FROM customer""",
    "personas": """
SELECT concat('u_', CAST(vec_id AS STRING)) AS uid, concat('group ', CAST(label AS STRING), ' member') AS summary,
 CASE label % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'regular' ELSE 'new' END AS tier,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(vec_id % 700 AS INT) * INTERVAL '1' HOUR AS last_full_update, embedding AS persona_embedding FROM embeddings""",
    "recall_queries": """
SELECT item_id AS query_id, concat('u_', CAST(item_id % 20 AS STRING)) AS user_id, text AS query, e.embedding
FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id""",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Base tables or views as DataFrames."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = []
    for n in names:
        if n in BASE:
            out.append(base(spark, sf_dir, n))
        else:
            out.append(view(spark, sf_dir, n))
    return out


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {b: base(spark, sf_dir, b) for b in BASE if _uses(sql, b)}
    for b in used:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {b}", f"{word} {{{b}}}")
    return spark.sql(sql, **used)


def _uses(sql: str, table: str) -> bool:
    return f"FROM {table}" in sql or f"JOIN {table}" in sql


def oracle(body: str, *names: str, **ctes: str) -> str:
    """``WITH <views>, <ctes> <body>`` for DuckDB."""
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names] + [f"{n} AS MATERIALIZED ({q})" for n, q in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body
