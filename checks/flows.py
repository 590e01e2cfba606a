"""Capture, triggers, streams and whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.memory import scan_sql
from checks.store import AWM, activity_watermarks
from checks.views import NOW, oracle, tables
from recollect.functions import diary as dia
from recollect.functions import facts
from recollect.operators import capture, models
from recollect.plans import maintenance
from recollect.plans.remember import remember
from recollect.plans.store import Store
from recollect.streaming import triggers

# ------------------------------------------------------------- triggers


@check("count_triggers", oracle("""SELECT session_id, (rn - 1) // 20 AS unit_no, min(msg_id) AS first_msg_id, max(msg_id) AS last_msg_id, count(*) AS n FROM (
 SELECT session_id, msg_id, row_number() OVER (PARTITION BY session_id ORDER BY msg_id) AS rn FROM activity JOIN wm USING (session_id) WHERE msg_id > last_consolidated_msg_id) GROUP BY 1, 2 HAVING count(*) = 20""",
                                "activity", wm=AWM))
def _(s, d):
    (a,) = tables(s, d, "activity")
    return triggers.count_units(a, activity_watermarks(a))


@check("idle_sessions", oracle("""SELECT session_id, unit_no, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM (
 SELECT *, sum(st) OVER (PARTITION BY session_id ORDER BY us, msg_id ROWS UNBOUNDED PRECEDING) - 1 AS unit_no FROM (
  SELECT session_id, msg_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, msg_id) < 7200000000 THEN 0 ELSE 1 END AS st FROM activity)) GROUP BY 1, 2 HAVING count(*) >= 2""", "activity"))
def _(s, d):
    return triggers.idle_units(*tables(s, d, "activity"), 120).select("session_id", "unit_no", "start_us", "end_us", "n")


@check("periodic_windows", oracle("""SELECT session_id, epoch_us(ts) // 7200000000 AS win, count(*) AS n, max(msg_id) AS last_msg_id FROM activity GROUP BY 1, 2 HAVING count(*) >= 2""", "activity"))
def _(s, d):
    w = triggers.sweep_units(*tables(s, d, "activity"))
    return w.select("session_id", F.expr("unix_micros(window_start) div 7200000000").alias("win"), "n", "last_msg_id")


SWEPT = """SELECT session_id, last_consolidated_msg_id, CASE length(session_id) % 3 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2024-01-31 23:00:00' ELSE TIMESTAMP '2024-01-31 22:00:00' END AS last_consolidated_at FROM wm"""


@check("sweep_due", oracle(f"""SELECT session_id, count(*) AS n, max(msg_id) AS last_msg_id FROM activity LEFT JOIN swept USING (session_id)
 WHERE (last_consolidated_at IS NULL OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_consolidated_at) >= 7200000000) AND msg_id > coalesce(last_consolidated_msg_id, 0) GROUP BY 1 HAVING count(*) >= 2""", "activity", wm=AWM, swept=SWEPT))
def _(s, d):
    (a,) = tables(s, d, "activity")
    k = F.length("session_id") % 3
    at = F.when(k == 1, F.lit("2024-01-31 23:00:00").cast("timestamp")).when(k == 2, F.lit("2024-01-31 22:00:00").cast("timestamp"))
    return triggers.sweep_due(a, activity_watermarks(a).withColumn("last_consolidated_at", at), NOW)


@check("watermark_advance", oracle("""SELECT session_id, greatest(w.last_consolidated_msg_id, m.m) AS last_consolidated_msg_id FROM wm w JOIN (SELECT session_id, max(msg_id) AS m FROM activity GROUP BY 1) m USING (session_id)""", "activity", wm=AWM))
def _(s, d):
    (a,) = tables(s, d, "activity")
    w = activity_watermarks(a).withColumn("last_consolidated_at", F.lit(None).cast("timestamp"))
    return triggers.advance(w, a.select("session_id", F.col("msg_id").alias("last_msg_id")), NOW).select("session_id", "last_consolidated_msg_id")


def spaced_sql(src: str, key: str, seconds: int) -> dict[str, str]:
    """The walk over ``src(id, key, us)`` that takes each first event at least ``seconds`` after the last one taken."""
    gap = seconds * 1_000_000
    return {
        f"{key}_t": f"SELECT {key}, us, min(id) AS id FROM ({src}) GROUP BY ALL",
        f"{key}_s": f"SELECT a.{key}, a.us, a.id, b.us AS nxt FROM {key}_t a ASOF LEFT JOIN {key}_t b ON a.{key} = b.{key} AND a.us + {gap} <= b.us",
        f"{key}_w": f"SELECT {key}, min(us) AS us FROM {key}_t GROUP BY ALL UNION ALL SELECT s.{key}, s.nxt FROM {key}_w w JOIN {key}_s s ON s.{key} = w.{key} AND s.us = w.us WHERE s.nxt IS NOT NULL",
        f"{key}_ok": f"SELECT t.id FROM {key}_t t JOIN {key}_w w ON t.{key} = w.{key} AND t.us = w.us",
    }


def recursive(sql: str, *names: str) -> str:
    """The SQL with ``WITH RECURSIVE``; the tables that call themselves can't be materialised."""
    for n in names:
        sql = sql.replace(f"{n} AS MATERIALIZED", f"{n} AS")
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


EVENT_US = "SELECT msg_id AS id, sender_id AS user_id, 'all' AS everyone, epoch_us(ts) AS us FROM activity"


@check("rate_limit", recursive(oracle("SELECT msg_id AS id, sender_id AS user_id, ts FROM activity WHERE msg_id IN (SELECT id FROM user_id_ok)", "activity",
                                      **spaced_sql(EVENT_US, "everyone", 1800), **spaced_sql(f"SELECT * FROM ({EVENT_US}) WHERE id IN (SELECT id FROM everyone_ok)", "user_id", 7200)), "everyone_w", "user_id_w"))
def _(s, d):
    (a,) = tables(s, d, "activity")
    return triggers.rate_limit(a.select(F.col("msg_id").alias("id"), F.col("sender_id").alias("user_id"), "ts"), 1800, 7200)


@check("user_rate_limit", recursive(oracle("SELECT msg_id AS id, sender_id AS user_id, ts FROM activity WHERE msg_id IN (SELECT id FROM user_id_ok)", "activity",
                                           **spaced_sql(EVENT_US, "user_id", 86400)), "user_id_w"))
def _(s, d):
    (a,) = tables(s, d, "activity")
    return triggers.spaced(a.select(F.col("msg_id").alias("id"), F.col("sender_id").alias("user_id"), "ts"), 86400, "user_id")


# ------------------------------------------------------------- capture

def told(s, d):
    """Texts of the driver's conversations with Chinese phrases that exercise the rules."""
    (m,) = tables(s, d, "messages")
    say = F.element_at(F.array(*[F.lit(x) for x in ("明天下午去开会 ", "昨天讨论了方案 ", "喜欢喝咖啡 ", "他们同事关系 ", "北京是首都 ", "上午做事 ", "5月30日去旅行 ", "")]),
                       (F.col("msg_id") % 8 + 1).cast("int"))
    return m.select("msg_id", F.concat(say, "content").alias("fact"))


FACTS = """SELECT msg_id, concat(CASE msg_id % 8 WHEN 0 THEN '明天下午去开会 ' WHEN 1 THEN '昨天讨论了方案 ' WHEN 2 THEN '喜欢喝咖啡 ' WHEN 3 THEN '他们同事关系 ' WHEN 4 THEN '北京是首都 '
 WHEN 5 THEN '上午做事 ' WHEN 6 THEN '5月30日去旅行 ' ELSE '' END, content) AS fact FROM messages"""


def _m(p: str) -> str:
    return f"regexp_matches(fact, '{p}')"


@check("classify", oracle(f"""SELECT msg_id, CASE WHEN {_m(facts.FUTURE)} AND {_m(facts.ACTION)} THEN 'planned' WHEN {_m(facts.PAST)} AND {_m(facts.ACTION)} THEN 'episodic'
 WHEN {_m(facts.PREFERENCE)} THEN 'preference' WHEN {_m(facts.RELATION)} THEN 'relational' WHEN {_m(facts.STATIVE)} THEN 'factual' WHEN {_m(facts.ACTION)} THEN 'episodic' ELSE 'factual' END AS atom_type FROM f""", "messages", f=FACTS))
def _(s, d):
    return told(s, d).select("msg_id", facts.classify(F.col("fact"))["atom_type"].alias("atom_type"))


@check("event_time", oracle(f"""SELECT msg_id, CASE WHEN contains(fact, '昨天') THEN epoch_us(TIMESTAMP '{NOW}') - 86400000000 WHEN contains(fact, '明天') THEN epoch_us(TIMESTAMP '{NOW}') + 86400000000
 WHEN contains(fact, '5月30日') THEN epoch_us(TIMESTAMP '2024-05-30 00:00:00') END AS t FROM f""", "messages", f=FACTS))
def _(s, d):
    return told(s, d).select("msg_id", F.unix_micros(facts.event_time(F.col("fact"), NOW)).alias("t"))


def answer_rows(s, d):
    """Model-like answers made from the documents: whole, fenced, truncated, plain."""
    (do,) = tables(s, d, "documents")
    whole = F.to_json(F.struct(F.col("text").alias("diary"), F.array(F.struct(F.col("source").alias("content"), F.lit("factual").alias("type"))).alias("atoms")))
    raw = F.when(F.col("doc_id") % 4 == 0, whole).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(
        F.col("doc_id") % 4 == 2, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(F.col("text"))
    return do.select("doc_id", "text", raw.alias("raw"))


@check("parse_responses", oracle("SELECT doc_id, CASE WHEN doc_id % 4 >= 2 THEN 0 ELSE 1 END AS atoms FROM documents"))
def _(s, d):
    return capture.parse_responses(answer_rows(s, d)).select("doc_id", F.size(F.filter("atoms", lambda a: a["content"].startswith("src"))).alias("atoms"))


@check("front_matter", oracle("SELECT doc_id, source AS mood, lang || '|' || source AS topics, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM documents"))
def _(s, d):
    (do,) = tables(s, d, "documents")
    c = dia.build([("date", F.lit("2024-01-05")), ("mood", F.col("source")), ("topics", F.to_json(F.array("lang", "source")))], F.col("text"))
    t = do.select("doc_id", c.alias("content"))
    return t.select("doc_id", F.try_element_at(dia.front_matter(F.col("content")), F.lit("mood")).alias("mood"),
                    F.array_join(dia.front_list(F.col("content"), "topics"), "|").alias("topics"), F.md5(dia.body_of(F.col("content"))).alias("body"))


def small_store(s, d) -> Store:
    a, di, l = tables(s, d, "atoms", "diaries", "links")
    return Store(atoms=a, diaries=di, links=l)


@check("remember", oracle("""SELECT n.user_id, n.content, n.atom_type, n.importance, d.k AS linked FROM (
 SELECT user_id, regexp_replace(fact, '^\\s+|\\s+$', '', 'g') AS content, CASE WHEN {f} AND {a} THEN 'planned' WHEN {p} AND {a} THEN 'episodic' WHEN {l} THEN 'preference' WHEN {r} THEN 'relational' WHEN {st} THEN 'factual'
  WHEN {a} THEN 'episodic' ELSE 'factual' END AS atom_type, 0.8 AS importance FROM (SELECT f.*, m.sender_id AS user_id FROM f JOIN messages m USING (msg_id)) WHERE length(regexp_replace(fact, '^\\s+|\\s+$', '', 'g')) >= 4) n, (SELECT 1 AS k) d""".format(
    f=_m(facts.FUTURE), a=_m(facts.ACTION), p=_m(facts.PAST), l=_m(facts.PREFERENCE), r=_m(facts.RELATION), st=_m(facts.STATIVE)), "messages", f=FACTS))
def _(s, d):
    (m,) = tables(s, d, "messages")
    req = told(s, d).join(m.select("msg_id", "sender_id"), "msg_id").select(
        F.col("msg_id").alias("request_id"), F.col("sender_id").alias("user_id"), F.lit("2024-02-01").cast("date").alias("diary_date"), F.col("fact").alias("summary"),
        F.array("fact").alias("facts"), F.array().cast("array<string>").alias("entities"), F.lit(0.8).alias("importance"))
    st = small_store(s, d)
    out = remember(req, st, NOW)
    new = out.atoms.join(st.atoms.select("atom_id"), "atom_id", "left_anti")
    n = out.links.groupBy("atom_id").agg(F.count(F.lit(1)).cast("int").alias("linked"))
    return new.join(n, "atom_id").select("user_id", "content", "atom_type", "importance", "linked")


def _toy_judge(texts):
    return ['{"should_remember": true, "importance": 0.7, "reason": "", "mood": "happy"}' for _ in texts]


def _toy_answer(texts):
    import json

    return [json.dumps({"diary": t, "atoms": [{"content": line, "entities": []} for line in t.split("\n") if len(line) > 20]}) for t in texts]


def _toy_vectors(texts):
    import zlib

    return [[((zlib.crc32(t.encode()) >> (4 * i)) & 15) - 7.5 for i in range(8)] for t in texts]


@check("capture_batch")
def _(s, d):
    from recollect.plans.capture_batch import capture_units

    (m,) = tables(s, d, "messages")
    (i,) = tables(s, d, "identities")
    us = i.groupBy("uid").agg(F.array_sort(F.collect_set("name")).alias("names"))
    u = m.groupBy("session_id").agg(F.min("sender_id").alias("user_id"), F.min("msg_id").alias("unit_id"),
                                    F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_id", "content"))), lambda x: x["content"]), "\n").alias("text"))
    st = small_store(s, d).with_(users=us)
    out = capture_units(u.withColumn("diary_date", F.lit("2024-02-01").cast("date")), st, NOW, _toy_judge, _toy_answer, _toy_vectors, "toy")
    return out.atoms.join(st.atoms.select("atom_id"), "atom_id", "left_anti").select("user_id", "atom_type", "content", "importance")


@check("daily_maintenance")
def _(s, d):
    st = small_store(s, d)
    out, _due = maintenance.daily(st, NOW, threshold=0.2, jaccard=0.1)
    return out.atoms.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 4).alias("importance"))


# the toy model in SQL: CRC-32 bit by bit, lowest bit of each byte first, in eight parts of four bits
TOY = """SELECT atom_id, list_transform(range(8), lambda i: CAST(((crc >> CAST(4 * i AS INT)) & 15) - 7.5 AS DOUBLE)) AS v FROM (
 SELECT atom_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
   list_filter(regexp_split_to_array(regexp_replace(hex(encode(coalesce(content, ''))), '(..)', '\\1 ', 'g'), ' '), lambda x: x <> ''),
   lambda x: list_transform(range(8), lambda i: (('0x' || x)::BIGINT >> i) & 1)))),
   lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) AS crc FROM atoms WHERE status = 'active')"""


@check("embed_and_scan", scan_sql("""SELECT status, count(*) AS n, round(sum(importance), 4) AS importance FROM (
 SELECT CASE WHEN s.status = 'dormant' THEN 'dormant' ELSE a.status END AS status, CASE WHEN wins > 0 THEN least(0.95, importance + 0.05 * wins) ELSE importance END AS importance
 FROM atoms a LEFT JOIN scan s USING (atom_id)) GROUP BY 1""", 0.92, 0.3, TOY, "a.user_id"))
def _(s, d):
    out = maintenance.embed_and_scan(small_store(s, d), _toy_vectors, "toy")
    return out.atoms.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 4).alias("importance"))


@check("embed_texts", oracle("SELECT doc_id, 8 AS dims, 'toy' AS model FROM documents"))
def _(s, d):
    (do,) = tables(s, d, "documents")
    return models.embed(do, "text", _toy_vectors, "toy").select("doc_id", F.size("embedding").alias("dims"), F.col("embedding_model").alias("model"))
