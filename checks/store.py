"""Point lookups, joins, reports, message log, state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.retrieval import top
from checks.views import NOW, oracle, tables
from recollect.functions import times
from recollect.operators import lookup, messages as log, reports, state
from recollect.sources import etl

def day():
    return F.col("date").cast("string").alias("date")


def text_of(c: str):
    return F.col(c).cast("string").alias(c)


# ------------------------------------------------------------- reports

@check("atom_stats", oracle("""SELECT user_id, count(*) AS total, count_if(status = 'active') AS active,
 count_if(status = 'active' AND atom_type = 'episodic') AS episodic, count_if(status = 'active' AND atom_type = 'factual') AS factual,
 count_if(status = 'active' AND atom_type = 'preference') AS preference, count_if(status = 'active' AND atom_type = 'planned') AS planned,
 count_if(status = 'active' AND atom_type = 'relational') AS relational, count_if(status = 'active' AND atom_type = 'unknown') AS unknown
 FROM atoms GROUP BY 1""", "atoms"))
def _(s, d):
    return reports.atom_stats(*tables(s, d, "atoms"))


@check("timeline_top3", oracle(f"""SELECT t.user_id, CAST(t.diary_date AS VARCHAR) AS diary_date, n, avg_importance, accesses, top_atoms FROM (
 SELECT user_id, diary_date, count(*) AS n, CAST(round(CAST(avg(CAST(importance AS DECIMAL(18,9))) AS DECIMAL(18,6)), 2) AS DOUBLE) AS avg_importance, CAST(sum(access_count) AS BIGINT) AS accesses FROM atoms WHERE status = 'active' GROUP BY 1, 2) t
 JOIN (SELECT user_id, diary_date, string_agg(atom_id || ':' || substr(content, 1, 100), '|' ORDER BY rank) AS top_atoms FROM (
  {top("SELECT * FROM atoms WHERE status = 'active'", "user_id, diary_date", "importance DESC, atom_id", 3)}) GROUP BY 1, 2) b USING (user_id, diary_date)""", "atoms"))
def _(s, d):
    (a,) = tables(s, d, "atoms")
    t = reports.timeline(a.drop("embedding"))
    shown = F.array_join(F.transform("top_atoms", lambda x: F.concat_ws(":", x["atom_id"].cast("string"), x["text"])), "|")
    return t.select("user_id", text_of("diary_date"), "n", "avg_importance", "accesses", shown.alias("top_atoms"))


@check("day_atoms", oracle("SELECT atom_id, importance FROM atoms WHERE user_id = 'u_4' AND diary_date = DATE '2024-01-05' AND status = 'active'", "atoms"))
def _(s, d):
    return reports.day_atoms(*tables(s, d, "atoms"), "u_4", "2024-01-05").select("atom_id", "importance")


EDGES = """SELECT from_node, concat('diary:', CAST(diary_id AS STRING)) AS to_node, 'mentions' AS relation_type, 'active' AS status FROM mentions
UNION ALL SELECT from_user, to_user, relation_type, status FROM social"""
NODES = "SELECT DISTINCT from_node AS node_id, 'entity' AS type FROM mentions UNION ALL SELECT DISTINCT from_user, 'user' FROM social"


def graph(s, d):
    m, so = tables(s, d, "mentions", "social")
    edges = m.select("from_node", F.concat(F.lit("diary:"), F.col("diary_id").cast("string")).alias("to_node"), F.lit("mentions").alias("relation_type"),
                     F.lit("active").alias("status")).unionByName(so.select(F.col("from_user").alias("from_node"), F.col("to_user").alias("to_node"), "relation_type", "status"))
    nodes = m.select(F.col("from_node").alias("node_id"), F.lit("entity").alias("type")).distinct().unionByName(
        so.select(F.col("from_user").alias("node_id"), F.lit("user").alias("type")).distinct())
    return nodes, edges


@check("graph_overview", oracle("""SELECT 'node' AS kind, type AS key, count(*) AS n FROM nodes GROUP BY 2
 UNION ALL SELECT 'edge', relation_type, count(*) FROM edges WHERE status = 'active' GROUP BY 2""", "mentions", "social", edges=EDGES, nodes=NODES))
def _(s, d):
    return reports.graph_overview(*graph(s, d))


@check("system_stats", oracle("""SELECT (SELECT count(DISTINCT uid) FROM personas) AS users, (SELECT count(*) FROM diaries) AS diaries,
 (SELECT count_if(status = 'active') FROM atoms) AS atoms, (SELECT count(*) FROM nodes) AS nodes, (SELECT count_if(status = 'active') FROM edges) AS edges""",
                              "mentions", "social", "personas", "diaries", "atoms", edges=EDGES, nodes=NODES))
def _(s, d):
    p, di, a = tables(s, d, "personas", "diaries", "atoms")
    return reports.system(p, di, a, *graph(s, d))


@check("lifecycle_stats", oracle("SELECT status, count(*) AS n FROM atoms GROUP BY 1 UNION ALL SELECT 'archived_diaries', count_if(archived) FROM diaries", "atoms", "diaries"))
def _(s, d):
    return reports.lifecycle(*tables(s, d, "atoms", "diaries"))


@check("months", oracle("SELECT DISTINCT year(date) AS year, month(date) AS month FROM diaries", "diaries"))
def _(s, d):
    return reports.months(*tables(s, d, "diaries"))


@check("diary_dates", oracle("SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM diaries", "diaries"))
def _(s, d):
    return reports.dates(*tables(s, d, "diaries")).select(day())


@check("today_counts", oracle("SELECT count_if(status = 'active' AND diary_date = DATE '2024-01-15') AS atoms_today, (SELECT count(*) FROM diaries) AS diaries FROM atoms", "atoms", "diaries"))
def _(s, d):
    return reports.today_counts(*tables(s, d, "atoms", "diaries"), "2024-01-15")


@check("social_edge_counts", oracle("SELECT uid, count(*) AS n FROM (SELECT from_user AS uid FROM social UNION ALL SELECT to_user FROM social) GROUP BY 1", "social"))
def _(s, d):
    return reports.social_edge_counts(*tables(s, d, "social"))


@check("rebuild_candidates", oracle("""SELECT diary_id, links FROM (
 SELECT d.diary_id, d.content, coalesce(n.links, 0) AS links, h.n, h.len FROM diaries d
 LEFT JOIN (SELECT diary_id, count(*) AS links FROM links GROUP BY 1) n USING (diary_id)
 LEFT JOIN (SELECT diary_id, count(*) AS n, max(length(a.content)) AS len FROM links JOIN atoms a USING (atom_id) WHERE a.status = 'active' GROUP BY 1) h USING (diary_id))
 WHERE links <= 1 AND length(content) > 20 AND NOT coalesce(n = 1 AND len < 0.8 * length(content), false)""", "diaries", "links", "atoms"))
def _(s, d):
    return reports.rebuild_candidates(*tables(s, d, "diaries", "links", "atoms")).select("diary_id", "links")


@check("store_audit", oracle("""SELECT count(*) AS atoms, max(atom_id) AS max_id, count_if(diary_date IS NULL) AS undated,
 (SELECT count(DISTINCT atom_id) FROM atoms WHERE regexp_matches(content, '[\\p{L}\\p{N}_]{2}')) AS indexed, max(atom_id) > 1.5 * count(*) AS id_gaps FROM atoms""", "atoms"))
def _(s, d):
    from recollect.functions import text

    (a,) = tables(s, d, "atoms")
    indexed = a.filter(F.exists(text.index_tokens(F.col("content")), lambda t: t.rlike(r"^[\p{L}\p{N}_]{2}")))
    return reports.audit(a, indexed)


# ------------------------------------------------------------- lookups and joins

@check("atoms_of_users", oracle("SELECT atom_id, user_id, epoch_us(created_at) AS created FROM atoms WHERE status = 'active' AND user_id IN (SELECT sender_id FROM messages)", "atoms", "messages"))
def _(s, d):
    a, m = tables(s, d, "atoms", "messages")
    return lookup.atoms_of_users(a, m.select(F.col("sender_id").alias("user_id"))).select("atom_id", "user_id", F.unix_micros("created_at").alias("created"))


@check("diaries_by_label", oracle("SELECT diary_id, length(content) AS chars FROM diaries WHERE diary_id IN (SELECT doc_id FROM labels)", "diaries"))
def _(s, d):
    di, la = tables(s, d, "diaries", "labels")
    return lookup.by_ids(di, la.select(F.col("doc_id").alias("diary_id")), "diary_id").select("diary_id", F.length("content").alias("chars"))


@check("latest_diary_per_date", oracle("SELECT CAST(date AS VARCHAR) AS date, max(diary_id) AS diary_id, md5(max_by(content, diary_id)) AS h FROM diaries GROUP BY 1", "diaries"))
def _(s, d):
    return lookup.latest_per_date(*tables(s, d, "diaries")).select(day(), "diary_id", F.md5("content").alias("h"))


@check("diaries_of_month", oracle("SELECT diary_id, CAST(date AS VARCHAR) AS date FROM diaries WHERE year(date) = 2024 AND month(date) = 3", "diaries"))
def _(s, d):
    return lookup.in_month(*tables(s, d, "diaries"), 2024, 3).select("diary_id", day())


@check("archived_diaries", oracle("SELECT diary_id, CAST(date AS VARCHAR) AS date FROM diaries WHERE archived", "diaries"))
def _(s, d):
    return lookup.archived(*tables(s, d, "diaries")).select("diary_id", day())


@check("atoms_by_diary", oracle("SELECT l.diary_id, a.atom_id, l.importance AS link_importance FROM atoms a JOIN links l USING (atom_id) WHERE a.status = 'active'", "atoms", "links"))
def _(s, d):
    return lookup.atoms_by_diary(*tables(s, d, "atoms", "links")).select("diary_id", "atom_id", "link_importance")


@check("diaries_by_atom", oracle("SELECT atom_id, diary_id, importance FROM links WHERE atom_id IN (SELECT doc_id FROM labels)", "links"))
def _(s, d):
    l, la = tables(s, d, "links", "labels")
    return lookup.diaries_by_atom(l, la.select(F.col("doc_id").alias("atom_id"))).select("atom_id", "diary_id", "importance")


@check("diary_with_atoms", oracle("""SELECT d.diary_id, x.atom_id, x.li AS link_importance FROM diaries d LEFT JOIN (
 SELECT l.diary_id, a.atom_id, l.importance AS li FROM atoms a JOIN links l USING (atom_id) WHERE a.status = 'active') x USING (diary_id)""", "diaries", "atoms", "links"))
def _(s, d):
    return lookup.diary_with_atoms(*tables(s, d, "diaries", "atoms", "links")).select("diary_id", "atom_id", "link_importance")


@check("pagination", oracle("SELECT diary_id, CAST(date AS VARCHAR) AS date FROM diaries ORDER BY date DESC, diary_id DESC OFFSET 20 LIMIT 10", "diaries"))
def _(s, d):
    return lookup.page(*tables(s, d, "diaries"), [F.desc("date"), F.desc("diary_id")], 3, 10).select("diary_id", day())


@check("missing_diary_links", oracle("SELECT atom_id, diary_id FROM links WHERE diary_id NOT IN (SELECT diary_id FROM diaries)", "links", "diaries"))
def _(s, d):
    return lookup.missing_diary_links(*tables(s, d, "links", "diaries")).select("atom_id", "diary_id")


@check("dates_without_diary", oracle("SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS diary_date FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT date FROM diaries WHERE archived)", "diaries"))
def _(s, d):
    e, di = tables(s, d, "events", "diaries")
    return lookup.dates_without_diary(e.select(F.to_date("ts").alias("diary_date")), di.filter("archived")).select(text_of("diary_date"))


@check("recent_diaries_of_users", oracle("SELECT user_id, diary_id, rank FROM (" + top(
    "SELECT DISTINCT a.user_id, diary_id, d.date FROM atoms a JOIN links l USING (atom_id) JOIN diaries d USING (diary_id) WHERE a.status = 'active'",
    "user_id", "date DESC, diary_id DESC", 5) + ")", "atoms", "links", "diaries"))
def _(s, d):
    return lookup.recent_diaries_of_users(*tables(s, d, "atoms", "links", "diaries"), 5).select("user_id", "diary_id", "rank")


USERS = "SELECT uid, list_sort(list(DISTINCT name)) AS names FROM identities GROUP BY 1"
PLATFORM = "SELECT platform, platform_id, min(uid) AS uid FROM identities GROUP BY 1, 2"
NAMES = "SELECT name, min(uid) AS uid FROM identities GROUP BY 1"


def people(s, d):
    """Users and identities in table form from the flat view."""
    (i,) = tables(s, d, "identities")
    users = i.groupBy("uid").agg(F.sort_array(F.collect_set("name")).alias("names"))
    ids = etl.identities(i.select("uid", F.concat_ws(":", "platform", "platform_id").alias("platform_id"), F.lit(0).alias("first_seen"),
                                  F.lit(1).alias("last_seen"), F.lit(False).alias("verified")))
    return users, ids


def stamp(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@check("name_resolution", oracle("SELECT c_custkey AS k, n.uid FROM customer LEFT JOIN names n ON n.name = c_name", "identities", names=NAMES))
def _(s, d):
    (c,) = tables(s, d, "customer")
    return lookup.uid_of_names(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), people(s, d)[0]).select("k", "uid")


@check("platform_resolution", oracle("SELECT o_orderkey AS k, p.uid FROM orders LEFT JOIN plat p ON p.platform = 'qq' AND p.platform_id = CAST(o_custkey + 1000000 AS VARCHAR)", "identities", plat=PLATFORM))
def _(s, d):
    (o,) = tables(s, d, "orders")
    req = o.select(F.col("o_orderkey").alias("k"), F.lit("qq").alias("platform"), (F.col("o_custkey") + 1000000).cast("string").alias("platform_id"))
    return lookup.uid_of_platform_ids(req, people(s, d)[1]).select("k", "uid")


RAW = """SELECT k, CASE k % 3 WHEN 0 THEN CAST(o + 1000000 AS VARCHAR) WHEN 1 THEN concat('u_', CAST(o AS VARCHAR)) ELSE concat('Customer#', lpad(CAST(o AS VARCHAR), 9, '0')) END AS raw
 FROM (SELECT o_orderkey AS k, o_custkey AS o FROM orders)"""


@check("raw_id_resolution", oracle("""SELECT k, coalesce(p.uid, u.uid, n.uid, raw) AS uid FROM raw_ids LEFT JOIN plat p ON p.platform = 'qq' AND p.platform_id = raw
 LEFT JOIN (SELECT DISTINCT uid FROM identities) u ON u.uid = raw LEFT JOIN names n ON n.name = raw""", "identities", plat=PLATFORM, names=NAMES, raw_ids=RAW))
def _(s, d):
    (o,) = tables(s, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    raw = F.when(k % 3 == 0, (F.col("o_custkey") + 1000000).cast("string")).when(k % 3 == 1, F.concat(F.lit("u_"), c)).otherwise(
        F.concat(F.lit("Customer#"), F.lpad(c, 9, "0")))
    users, ids = people(s, d)
    return lookup.resolve_ids(o.select(k.alias("k"), raw.alias("raw")), users, ids).select("k", "uid")


@check("related_ids", oracle("""SELECT DISTINCT c.c_name AS id, coalesce(a.alias, c.c_name) AS related_id FROM customer c LEFT JOIN al o ON o.alias = c.c_name LEFT JOIN al a ON a.uid = o.uid""",
                             "identities", al="SELECT uid, uid AS alias FROM identities UNION SELECT uid, platform_id FROM identities UNION SELECT uid, name FROM identities"))
def _(s, d):
    (c,) = tables(s, d, "customer")
    return lookup.related_ids(c.select(F.col("c_name").alias("id")), *people(s, d))


@check("display_names", oracle("SELECT o_orderkey AS k, coalesce(u.names[1], concat('用户', right(concat('u_', CAST(o_custkey AS VARCHAR)), 4))) AS display_name FROM orders LEFT JOIN users u ON u.uid = concat('u_', CAST(o_custkey AS VARCHAR))", "identities", users=USERS))
def _(s, d):
    (o,) = tables(s, d, "orders")
    req = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("u_"), F.col("o_custkey").cast("string")).alias("uid"))
    return lookup.display_names(req, people(s, d)[0]).select("k", "display_name")


@check("users_with_persona", oracle("""SELECT u.uid, coalesce(u.names[1], u.uid) AS name, coalesce(p.tier, 'new') AS tier, substr(coalesce(p.summary, ''), 1, 100) AS summary
 FROM users u LEFT JOIN personas p USING (uid)""", "identities", "personas", users=USERS))
def _(s, d):
    (p,) = tables(s, d, "personas")
    return lookup.users_with_persona(people(s, d)[0], p).select("uid", "name", "tier", "summary")


@check("persona_vectors", oracle("SELECT uid, len(persona_embedding) AS dims FROM personas WHERE uid IN (SELECT uid FROM identities) AND persona_embedding IS NOT NULL", "identities", "personas"))
def _(s, d):
    (p,) = tables(s, d, "personas")
    return lookup.persona_vectors(people(s, d)[0], p).select("uid", F.size("embedding").alias("dims"))


@check("persona_of_names", oracle("SELECT c_name AS name, n.uid, p.tier FROM customer LEFT JOIN names n ON n.name = c_name LEFT JOIN personas p ON p.uid = n.uid", "identities", "personas", names=NAMES))
def _(s, d):
    c, p = tables(s, d, "customer", "personas")
    return lookup.persona_of_names(c.select(F.col("c_name").alias("name")), people(s, d)[0], p).select("name", "uid", "tier")


# ------------------------------------------------------------- message log

WM = "SELECT session_id, CASE WHEN hash_half = 0 THEN 0 ELSE mid END AS last_consolidated_msg_id FROM (SELECT session_id, min(msg_id) + 2 AS mid, (min(msg_id) // 1000) % 2 AS hash_half FROM messages GROUP BY 1)"
AWM = "SELECT session_id, min(msg_id) + 500 AS last_consolidated_msg_id FROM activity GROUP BY 1"


def watermarks(m):
    first = m.groupBy("session_id").agg(F.min("msg_id").alias("m"))
    return first.select("session_id", F.when(F.expr("(m div 1000) % 2 = 0"), 0).otherwise(F.col("m") + 2).alias("last_consolidated_msg_id"))


def activity_watermarks(a):
    return a.groupBy("session_id").agg((F.min("msg_id") + 500).alias("last_consolidated_msg_id"))


@check("session_rollup", oracle("""SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(o.user_id, n.user_id) AS user_id, epoch_us(coalesce(o.created_at, n.lo)) AS created,
 epoch_us(greatest(o.last_active_at, n.hi)) AS last_active, coalesce(o.message_count, 0) + coalesce(n.c, 0) AS message_count
 FROM (SELECT session_id, min_by(sender_id, msg_id) AS user_id, min(ts) AS created_at, max(ts) AS last_active_at, count(*) AS message_count FROM messages WHERE role = 'user' GROUP BY 1) o
 FULL JOIN (SELECT session_id, min_by(sender_id, msg_id) AS user_id, min(ts) AS lo, max(ts) AS hi, count(*) AS c FROM messages WHERE role <> 'user' GROUP BY 1) n USING (session_id)""", "messages"))
def _(s, d):
    (m,) = tables(s, d, "messages")
    old = log.rollup_sessions(s.createDataFrame([], "session_id string, user_id string, created_at timestamp, last_active_at timestamp, message_count bigint"),
                              m.filter("role = 'user'"))
    out = log.rollup_sessions(old, m.filter("role <> 'user'"))
    return out.select("session_id", "user_id", stamp("created_at").alias("created"), stamp("last_active_at").alias("last_active"), "message_count")


@check("retention", oracle("SELECT msg_id, sender_id FROM (" + top("SELECT * FROM activity", "sender_id", "msg_id DESC", 1000) + ")", "activity"))
def _(s, d):
    return log.retain(*tables(s, d, "activity")).select("msg_id", "sender_id")


@check("retention_tight", oracle("SELECT msg_id, sender_id FROM (" + top("SELECT * FROM activity", "sender_id", "msg_id DESC", 40) + ")", "activity"))
def _(s, d):
    return log.retain(*tables(s, d, "activity"), 40).select("msg_id", "sender_id")


@check("live_sessions", oracle("SELECT DISTINCT session_id FROM activity WHERE session_id IN (SELECT session_id FROM messages)", "activity", "messages"))
def _(s, d):
    a, m = tables(s, d, "activity", "messages")
    return log.live_sessions(a.select("session_id").distinct(), m)


_LINE = """concat('[', CASE WHEN CAST(ts AS DATE) = DATE '2024-01-20' THEN strftime(ts, '%H:%M') WHEN DATE '2024-01-20' - CAST(ts AS DATE) < 7 THEN strftime(ts, '%m-%d %H:%M') ELSE strftime(ts, '%m-%d') END,
 '] ', CASE WHEN role = 'user' THEN sender_name ELSE 'Bot: 我' END, ': ', content)"""


@check("last_n_context", oracle(f"SELECT session_id, string_agg({_LINE}, chr(10) ORDER BY msg_id) AS context FROM (" + top("SELECT * FROM messages", "session_id", "msg_id DESC", 4) + ") GROUP BY 1", "messages"))
def _(s, d):
    return log.recent_context(*tables(s, d, "messages"), 4, "2024-01-20 12:00:00")


@check("context_since", oracle("SELECT msg_id, session_id FROM (" + top(
    "SELECT m.*, coalesce(w.last_consolidated_msg_id, 0) AS wm FROM messages m LEFT JOIN wm w USING (session_id) WHERE msg_id > coalesce(w.last_consolidated_msg_id, 0)",
    "session_id", "CASE WHEN wm = 0 THEN -msg_id ELSE msg_id END", 3) + ")", "messages", wm=WM))
def _(s, d):
    (m,) = tables(s, d, "messages")
    return log.context_since(m, watermarks(m), 3).select("msg_id", "session_id")


@check("context_since_all", oracle("SELECT msg_id, session_id FROM messages LEFT JOIN wm w USING (session_id) WHERE msg_id > coalesce(w.last_consolidated_msg_id, 0)", "messages", wm=WM))
def _(s, d):
    (m,) = tables(s, d, "messages")
    return log.context_since(m, watermarks(m)).select("msg_id", "session_id")


@check("unprocessed_rounds", oracle("SELECT session_id, count(*) AS messages, count(*) // 2 AS rounds FROM activity a JOIN wm USING (session_id) WHERE msg_id > last_consolidated_msg_id GROUP BY 1", "activity", wm=AWM))
def _(s, d):
    (a,) = tables(s, d, "activity")
    return log.unprocessed(a, activity_watermarks(a))


@check("last_activity", oracle("SELECT session_id, epoch_us(max(ts)) AS last_active FROM activity GROUP BY 1", "activity"))
def _(s, d):
    return log.last_activity(*tables(s, d, "activity")).select("session_id", stamp("last_active_at").alias("last_active"))


@check("message_tags", oracle("""SELECT msg_id, concat('[', CASE WHEN CAST(ts AS DATE) = DATE '2024-01-20' THEN strftime(ts, '%H:%M') WHEN DATE '2024-01-20' - CAST(ts AS DATE) < 7 THEN strftime(ts, '%m-%d %H:%M') ELSE strftime(ts, '%m-%d') END, ']') AS tag FROM activity""", "activity"))
def _(s, d):
    (a,) = tables(s, d, "activity")
    return a.select("msg_id", times.message_tag(F.col("ts"), "2024-01-20 12:00:00").alias("tag"))


@check("date_tags", oracle("""SELECT diary_id, CASE WHEN date = DATE '2024-01-15' THEN '今日' WHEN date = DATE '2024-01-14' THEN '昨天' ELSE strftime(date, '%m-%d') END AS tag FROM diaries""", "diaries"))
def _(s, d):
    (di,) = tables(s, d, "diaries")
    return di.select("diary_id", times.date_tag(F.col("date").cast("string"), "2024-01-15 08:00:00").alias("tag"))


@check("speaker_count", oracle("""SELECT session_id, count(DISTINCT name) AS speakers FROM (
 SELECT session_id, CASE WHEN role = 'user' THEN sender_name END AS name FROM messages) GROUP BY 1""", "messages"))
def _(s, d):
    (m,) = tables(s, d, "messages")
    one_line = m.withColumn("content", F.regexp_replace("content", r"[\n:]", " "))
    text = log.recent_context(one_line, 1_000_000, "2024-01-20 12:00:00")
    return reports.speaker_counts(text.withColumnRenamed("context", "text")).select("session_id", "speakers")


# ------------------------------------------------------------- state changes

@check("update_fields", oracle("SELECT atom_id, coalesce(q.imp, importance) AS importance, CASE WHEN q.tox = 1 THEN 'dormant' ELSE status END AS status FROM atoms LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 0.9 END AS imp, toxic AS tox FROM labels) q ON q.doc_id = atom_id", "atoms"))
def _(s, d):
    a, la = tables(s, d, "atoms", "labels")
    up = la.select(F.col("doc_id").alias("atom_id"), F.when(F.col("quality") == 1, 0.9).alias("importance"), F.when(F.col("toxic") == 1, "dormant").alias("status"))
    return state.apply_updates(a, up, "atom_id", state.ATOM_FIELDS).select("atom_id", "importance", "status")


@check("touch", oracle("""SELECT atom_id, access_count + coalesce(n, 0) AS access_count, CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END AS touched FROM atoms LEFT JOIN (SELECT l_partkey AS atom_id, count(*) AS n FROM lineitem GROUP BY 1) USING (atom_id)""", "atoms"))
def _(s, d):
    a, li = tables(s, d, "atoms", "lineitem")
    t = state.touch(a.withColumn("last_accessed_at", F.lit(None).cast("timestamp")), li.select(F.col("l_partkey").alias("atom_id")), NOW)
    return t.select("atom_id", "access_count", F.col("last_accessed_at").isNotNull().cast("int").alias("touched"))


@check("soft_delete", oracle("SELECT atom_id, CASE WHEN user_id = concat('u_', CAST(r.u AS VARCHAR)) THEN 'forgotten' ELSE status END AS status FROM atoms LEFT JOIN (SELECT doc_id, doc_id % 20 + toxic AS u FROM labels) r ON r.doc_id = atom_id", "atoms"))
def _(s, d):
    a, la = tables(s, d, "atoms", "labels")
    req = la.select(F.col("doc_id").alias("atom_id"), F.concat(F.lit("u_"), (F.col("doc_id") % 20 + F.col("toxic")).cast("string")).alias("user_id"))
    return state.forget(a, req).select("atom_id", "status")


@check("hard_delete_links", oracle("SELECT atom_id, diary_id FROM links WHERE diary_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "links"))
def _(s, d):
    di, l, la = tables(s, d, "diaries", "links", "labels")
    return state.delete_diaries(di, l, la.filter("toxic = 1").select(F.col("doc_id").alias("diary_id")))[1].select("atom_id", "diary_id")


@check("delete_dates", oracle("SELECT diary_id FROM diaries WHERE date NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'error')", "diaries"))
def _(s, d):
    di, l, e = tables(s, d, "diaries", "links", "events")
    return state.delete_dates(di, l, e.filter("event_type = 'error'").select(F.to_date("ts").alias("date")))[0].select("diary_id")


@check("update_latest_of_date", oracle("""SELECT diary_id, CASE WHEN diary_id = m THEN 0.77 ELSE importance END AS importance FROM diaries
 LEFT JOIN (SELECT date, max(diary_id) AS m FROM diaries WHERE date IN (SELECT CAST(ts AS DATE) FROM events) GROUP BY 1) x USING (date)""", "diaries"))
def _(s, d):
    di, e = tables(s, d, "diaries", "events")
    up = e.select(F.to_date("ts").alias("date")).distinct().withColumn("importance", F.lit(0.77))
    return state.apply_updates(di, state.latest_of_date(di, up), "diary_id", state.DIARY_FIELDS).select("diary_id", "importance")


@check("append_links", oracle("""SELECT atom_id, diary_id, importance FROM links
 UNION ALL SELECT a, b, min_by(i, q) FROM (SELECT l_partkey AS a, l_suppkey AS b, l_discount AS i, l_orderkey * 10 + l_linenumber AS q FROM lineitem) x
 WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.atom_id = x.a AND l.diary_id = x.b) GROUP BY 1, 2""", "links"))
def _(s, d):
    l, li = tables(s, d, "links", "lineitem")
    new = li.select(F.col("l_partkey").alias("atom_id"), F.col("l_suppkey").alias("diary_id"), F.lit("").alias("snippet"),
                    F.col("l_discount").alias("importance"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return state.append_links(l, new).select("atom_id", "diary_id", "importance")


# ------------------------------------------------------------- older layouts

@check("identity_etl", oracle("SELECT uid, platform, string_agg(DISTINCT platform_id, ',' ORDER BY platform_id) AS ids FROM identities GROUP BY 1, 2", "identities"))
def _(s, d):
    return people(s, d)[1].select("uid", F.explode("platform_ids").alias("platform", "ids")).select("uid", "platform", F.array_join("ids", ",").alias("ids"))


@check("sender_remap", oracle("SELECT o_orderkey AS msg_id, coalesce(p.uid, CAST(o_custkey + 1000000 AS VARCHAR)) AS sender_id FROM orders LEFT JOIN (SELECT platform_id, uid FROM identities WHERE platform = 'qq') p ON p.platform_id = CAST(o_custkey + 1000000 AS VARCHAR)", "identities"))
def _(s, d):
    o, i = tables(s, d, "orders", "identities")
    m = o.select(F.col("o_orderkey").alias("msg_id"), (F.col("o_custkey") + 1000000).cast("string").alias("sender_id"))
    return etl.remap_sender(m, i.filter("platform = 'qq'").select(F.col("platform_id").alias("raw"), "uid"))


@check("backfill_links", oracle("SELECT atom_id, diary_id FROM links UNION SELECT doc_id, doc_id - doc_id % 4 FROM documents WHERE doc_id - doc_id % 4 > 0", "links"))
def _(s, d):
    l, a = tables(s, d, "links", "atoms")
    old = a.select("atom_id", (F.col("atom_id") - F.col("atom_id") % 4).alias("diary_id"), F.lit("").alias("diary_snippet"), "importance")
    return etl.backfill_links(l, old).select("atom_id", "diary_id")


@check("normalize_ts", oracle("SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS t FROM events"))
def _(s, d):
    (e,) = tables(s, d, "events")
    mixed = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("decimal(20,6)").cast("string"))
    return etl.normalize_ts(e.select("event_id", mixed.alias("t")), "t").select("event_id", F.round("t", 3).alias("t"))


@check("date_normalisation", oracle("SELECT diary_id, CAST(date AS VARCHAR) AS date FROM diaries", "diaries"))
def _(s, d):
    (di,) = tables(s, d, "diaries")
    return di.select("diary_id", times.normal_date(F.date_format("date", "yyyy/M/d")).alias("date"))
