"""Provenance, lifecycle, duplicates, graph, social ties, people."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.retrieval import _RUN, TERMS, recall_ctes, recall_inputs, top, GS, multi_ctes, GV
from checks.store import people, stamp, USERS
from checks.views import NOW, oracle, tables
from recollect.functions import diary as dia
from recollect.functions import text
from recollect.operators import context, dedup, graph, lifecycle, provenance, quality, search, social, users
from recollect.plans import recall as recall_plan

# ------------------------------------------------------------- diaries, provenance, context

PREFIX_K = 3
PREFIX = dict(
    asked="SELECT item_id AS query_id, regexp_extract_all(lower(text), '%s', 1) AS t FROM benchmark" % _RUN,
    q="SELECT query_id, len(list_distinct(t)) AS n_terms, unnest(list_distinct(t)) AS term FROM asked",
    toks="SELECT diary_id, unnest(t) AS token, len(t) AS doc_len FROM (SELECT diary_id, regexp_extract_all(lower(content), '%s', 1) AS t FROM diaries)" % _RUN,
    st="SELECT (SELECT count(*) FROM diaries) AS n_docs, (SELECT count(*) FROM toks) * 1.0 / (SELECT count(*) FROM diaries) AS avg_len",
    per="SELECT term, diary_id, count(*) AS tf, max(doc_len) AS doc_len FROM (SELECT DISTINCT term FROM q) JOIN toks ON starts_with(token, term) GROUP BY 1, 2",
    fr="SELECT term, count(*) AS df FROM per GROUP BY 1",
    hit="""SELECT query_id, diary_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS bm25
  FROM q JOIN per USING (term) JOIN fr USING (term), st GROUP BY 1, 2 HAVING count(*) = max(n_terms)""",
)


@check("diary_prefix_search", oracle("SELECT query_id, diary_id, rank, score, bm25 FROM (" + top(
    "SELECT *, round((CASE WHEN importance = 0 THEN 0.5 ELSE importance END) * 0.6, 6) AS score FROM (" +
    "SELECT h.*, d.importance FROM hit h JOIN diaries d USING (diary_id))",
    "query_id", "score DESC, bm25 DESC, diary_id", PREFIX_K) + ")", "diaries", **PREFIX))
def _(s, d):
    di, b = tables(s, d, "diaries", "benchmark")
    return search.diary_prefix(di, b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), PREFIX_K)


# sentences end at newlines in the driver's texts; the oracle cuts there
SEGS = "SELECT {id}, list_filter(list_transform(string_split(regexp_replace({c}, '[\\x{{3002}}\\x{{FF01}}\\x{{FF1F}}]', '\\0' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 4) AS segs FROM {t}"


def seg_sql(src: str, key: str) -> str:
    """``src`` holds ``key``, segs and kws."""
    return f"""SELECT {key}, CASE WHEN len(segs) > 0 THEN substr(array_to_string(segs[greatest(1, best - 1):least(len(segs), best + 1)], ''), 1, 200) END AS snippet FROM (
 SELECT *, CASE WHEN list_max(counts) > 0 THEN list_position(counts, list_max(counts)) ELSE 1 END AS best FROM (
  SELECT *, list_transform(segs, lambda s: len(list_filter(kws, lambda k: contains(lower(s), k)))) AS counts FROM ({src})))"""


DOC_SEGS = SEGS.format(id="diary_id", c="content", t="diaries")
Q_KWS = "SELECT query_id, list(token) AS kws FROM terms GROUP BY 1"


@check("best_segment", oracle("SELECT query_id, diary_id, snippet FROM (" + seg_sql(
    "SELECT s.diary_id AS query_id, s.diary_id, s.segs, k.kws FROM doc_segs s JOIN q_kws k ON k.query_id = s.diary_id % (SELECT count(*) FROM recall_queries)", "query_id, diary_id") + ") WHERE snippet IS NOT NULL",
    "diaries", "recall_queries", terms=TERMS, doc_segs=DOC_SEGS, q_kws=Q_KWS))
def _(s, d):
    di, q = tables(s, d, "diaries", "recall_queries")
    k = q.select(F.col("query_id").alias("k"), text.keywords(F.col("query")).alias("kws"))
    rows = di.withColumn("query_id", F.col("diary_id")).withColumn("k", F.col("diary_id") % q.count()).join(k, "k")
    return rows.select("query_id", "diary_id", provenance.best_segment(F.col("content"), F.col("kws")).alias("snippet")).filter("snippet IS NOT NULL")


def ordered_kws(src: str, key: str) -> str:
    return f"""SELECT {key}, list_filter(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]),
  lambda x: regexp_full_match(x, '[a-z0-9_]+') OR length(x) >= 2)[1:15] AS kws FROM (SELECT {key}, regexp_extract_all(lower(txt), '{_RUN}', 1) AS t FROM ({src}))"""


TRACE = dict(
    hit="SELECT r.query_id, r.atom_id, l.diary_id, l.importance FROM ranked r JOIN links l USING (atom_id)",
    tops=top("SELECT query_id, diary_id, max(importance) AS imp FROM hit GROUP BY 1, 2", "query_id", "imp DESC, diary_id", 2, rank="pos"),
    said="SELECT query_id, diary_id, txt FROM (" + top("SELECT h.*, a.content AS txt FROM hit h JOIN atoms a USING (atom_id)", "query_id, diary_id", "length(txt) DESC, importance DESC, atom_id", 1) + ")",
    said_kws=ordered_kws("SELECT query_id, diary_id, txt FROM said", "query_id, diary_id"),
    q_kws="SELECT query_id, list(token) AS qk FROM terms GROUP BY 1",
    doc_segs=DOC_SEGS,
    segged=seg_sql("SELECT t.query_id, t.diary_id, t.pos, s.segs, list_distinct(list_concat(coalesce(q.qk, []), k.kws)) AS kws FROM tops t JOIN said_kws k USING (query_id, diary_id) LEFT JOIN q_kws q USING (query_id) JOIN doc_segs s USING (diary_id)", "query_id, diary_id, pos"),
)


@check("provenance_top2", oracle("SELECT query_id, diary_id, pos, snippet FROM segged WHERE snippet IS NOT NULL", *GS, **recall_ctes(5, 50), **TRACE))
def _(s, d):
    i = recall_inputs(s, d)
    (di,) = tables(s, d, "diaries")
    r = recall_plan.recall(**i, k=5)
    return provenance.trace(r, i["atoms"], i["links"], di, i["queries"]).select("query_id", "diary_id", "pos", "snippet")


@check("rendered_context")
def _(s, d):
    i = recall_inputs(s, d)
    di, p = tables(s, d, "diaries", "personas")
    from recollect.session import cut_lineage

    r = cut_lineage(recall_plan.recall(**i, k=5))
    t = provenance.trace(r, i["atoms"], i["links"], di, i["queries"])
    p = p.withColumn("tags", F.array("tier"))
    return context.render(i["queries"], r, i["atoms"], t, p, NOW)


def nested(ctes: dict[str, str], body: str) -> str:
    """A query with tables of its own, whatever the names outside."""
    return "(WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes.items()) + " " + body + ")"


FOUND_DIARIES = nested(PREFIX, "SELECT query_id, diary_id, rank FROM (" + top(
    "SELECT *, round((CASE WHEN importance = 0 THEN 0.5 ELSE importance END) * 0.6, 6) AS score FROM (SELECT h.*, d.importance FROM hit h JOIN diaries d USING (diary_id))",
    "query_id", "score DESC, bm25 DESC, diary_id", PREFIX_K) + ")")


@check("hybrid_search", oracle(f"SELECT query_id, 'atom' AS kind, atom_id AS id, rank FROM ranked UNION ALL SELECT query_id, 'diary', diary_id, rank FROM {FOUND_DIARIES}", *GS, **recall_ctes(3, 50)))
def _(s, d):
    (di,) = tables(s, d, "diaries")
    i = recall_inputs(s, d)
    return recall_plan.hybrid(diaries=di, k=3, **i)


@check("social_rerank", oracle("SELECT query_id, atom_id, rank, score FROM ranked", "atoms", "recall_queries", "social", **{
    "filled": "SELECT query_id, atom_id, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, atom_id) AS rank FROM recall_queries, (SELECT atom_id, importance FROM atoms WHERE status = 'active' ORDER BY importance DESC, atom_id)",
    "friends": recall_ctes(5, 10)["friends"], "ranked": recall_ctes(10, 10)["ranked"]}))
def _(s, d):
    a, q, so = tables(s, d, "atoms", "recall_queries", "social")
    best = a.filter("status = 'active'").select("atom_id", "importance")
    empty = best.select(F.lit(0).cast("bigint").alias("query_id"), "atom_id", F.lit(1).alias("rank")).filter("false")
    filled = search.backfill(empty, a.join(best.select("atom_id"), "atom_id", "left_semi"), q, None)
    from recollect.operators.skew import placed, ranked_in_slices
    # one place an atom, the same for all queries
    at = placed(best, [F.desc("importance"), F.asc("atom_id")], "_at").select("atom_id", "_at")
    ordered = ranked_in_slices(filled.drop("rank").join(at, "atom_id"), "query_id", "_at", [])
    return search.social_rerank(ordered, a, q, so, 10)


# ------------------------------------------------------------- lifecycle

AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0"


@check("decay_scores", oracle(f"""SELECT atom_id, round(CASE decay_type WHEN 'linear' THEN greatest(0.0, 1 - age / ttl) WHEN 'step' THEN CASE WHEN age <= ttl THEN 1.0 ELSE 0.05 END
 ELSE exp(-ln(2.0) * age / greatest(ttl / 2, 0.5)) END, 6) AS score FROM (SELECT atom_id, decay_type, greatest({AGE}, 0.0) AS age, greatest(ttl_days, 1.0) AS ttl FROM atoms)""", "atoms"))
def _(s, d):
    (a,) = tables(s, d, "atoms")
    return a.select("atom_id", F.round(lifecycle.decay_score(F.col("decay_type"), F.col("ttl_days"), lifecycle.age_days(F.col("created_at"), NOW)), 6).alias("score"))


@check("global_decay", oracle("SELECT atom_id, round(CASE WHEN status = 'active' THEN importance * 0.95 ELSE importance END, 6) AS importance FROM atoms", "atoms"))
def _(s, d):
    return lifecycle.decayed(*tables(s, d, "atoms"), 0.95).select("atom_id", F.round("importance", 6).alias("importance"))


@check("expiry", oracle(f"""SELECT atom_id, decay_type, (epoch_us(TIMESTAMP '{NOW}') + CAST(round(ttl_days * 86400 * (0.5 + importance) * 1000) AS BIGINT) * 1000) // 1000000 AS expires FROM atoms""", "atoms"))
def _(s, d):
    e = lifecycle.with_expiry(*tables(s, d, "atoms"), NOW, use_type_ttl=True)
    return e.select("atom_id", "decay_type", F.round(stamp("expires_at") / 1e6).cast("bigint").alias("expires"))


@check("orphans", oracle("""SELECT atom_id, CASE WHEN status = 'active' AND importance < 0.2 AND atom_id IN (SELECT atom_id FROM links WHERE diary_id NOT IN (SELECT diary_id FROM diaries))
 THEN 'dormant' ELSE status END AS status FROM atoms""", "atoms", "links", "diaries"))
def _(s, d):
    return lifecycle.orphans_dormant(*tables(s, d, "atoms", "links", "diaries")).select("atom_id", "status")


@check("expired", oracle(f"SELECT atom_id, status FROM atoms WHERE NOT (status IN ('dormant', 'forgotten') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 60 DAY)", "atoms"))
def _(s, d):
    return lifecycle.drop_expired(*tables(s, d, "atoms"), NOW).select("atom_id", "status")


@check("archive_candidates", oracle(f"""SELECT diary_id, CASE WHEN due THEN substr(content, 1, 200) ELSE content END AS content, archived OR due AS archived FROM (
 SELECT *, created_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND importance < 0.1 AND NOT archived AS due FROM diaries)""", "diaries"))
def _(s, d):
    (di,) = tables(s, d, "diaries")
    return lifecycle.archived_state(di, NOW).select("diary_id", "content", "archived")


HITS = "SELECT l_partkey AS atom_id, l_orderkey * 10 + l_linenumber AS seq, max(l_discount * 8) AS judge, max(l_tax * 10) AS confidence FROM lineitem GROUP BY 1, 2"


@check("reinforce", oracle("""SELECT atom_id, round(coalesce(list_reduce(j, lambda acc, x, i: least(0.95, greatest(acc + greatest(0.01, 0.05 / log2(access_count + i + 1)), x * 0.7 + acc * 0.3)), importance), importance), 6) AS importance,
 access_count + coalesce(n, 0) AS access_count, greatest(confidence, coalesce(c, 0)) AS confidence FROM atoms LEFT JOIN (
 SELECT atom_id, list(judge ORDER BY seq) AS j, count(*) AS n, max(confidence) AS c FROM hits GROUP BY 1) USING (atom_id)""", "atoms", hits=HITS))
def _(s, d):
    a, li = tables(s, d, "atoms", "lineitem")
    hits = li.select(F.col("l_partkey").alias("atom_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
                     (F.col("l_discount") * 8).alias("judge"), (F.col("l_tax") * 10).alias("confidence"))
    hits = hits.groupBy("atom_id", "seq").agg(F.max("judge").alias("judge"), F.max("confidence").alias("confidence"))
    r = lifecycle.reinforce(a.withColumn("expires_at", F.lit(None).cast("timestamp")), hits, NOW)
    return r.select("atom_id", F.round("importance", 6).alias("importance"), "access_count", "confidence")


@check("diary_write_back", oracle("""SELECT diary_id, greatest(importance, coalesce(b, 0)) AS importance FROM diaries LEFT JOIN (
 SELECT l.diary_id, max(0.9) AS b FROM links l JOIN atoms a USING (atom_id) JOIN labels q ON q.doc_id = l.atom_id WHERE q.quality = 1 AND a.importance < 0.9 AND l.diary_id > 0 GROUP BY 1) USING (diary_id)""", "diaries", "links", "atoms"))
def _(s, d):
    di, l, a, la = tables(s, d, "diaries", "links", "atoms", "labels")
    good = la.filter("quality = 1").select(F.col("doc_id").alias("atom_id"), F.lit(0.9).alias("up"))
    after = a.join(good, "atom_id", "left").withColumn("importance", F.greatest("importance", F.coalesce("up", F.lit(0.0))))
    return lifecycle.raise_diaries(di, a, after, l).select("diary_id", "importance")


# ------------------------------------------------------------- duplicates

SETS = f"""SELECT atom_id, user_id, status, w AS bag, list_distinct(w) AS tokens FROM (
 SELECT atom_id, user_id, status, list_filter(regexp_extract_all(lower(content), '{_RUN}', 1), lambda x: length(x) >= 2) AS w FROM atoms) WHERE len(w) > 0"""


@check("jaccard_pairs", oracle("""SELECT l_id, r_id, round(shared / (ln + rn - shared), 6) AS jaccard FROM (
 SELECT a.atom_id AS l_id, b.atom_id AS r_id, len(a.tokens) AS ln, len(b.tokens) AS rn, len(list_intersect(a.tokens, b.tokens)) AS shared
 FROM sets a JOIN sets b ON a.atom_id < b.atom_id AND len(a.tokens) >= 0.5 * len(b.tokens) AND len(b.tokens) >= 0.5 * len(a.tokens)
 WHERE a.atom_id IN (SELECT m FROM (SELECT min(atom_id) AS m FROM sets GROUP BY list_sort(bag))) AND b.atom_id IN (SELECT m FROM (SELECT min(atom_id) AS m FROM sets GROUP BY list_sort(bag))))
 WHERE shared / (ln + rn - shared) >= 0.5""", "atoms", sets=SETS))
def _(s, d):
    from recollect.operators.similarity import set_pairs, with_tokens

    (a,) = tables(s, d, "atoms")
    t = with_tokens(a.select("atom_id", "content"))
    reps = t.groupBy("sig").agg(F.min("atom_id").alias("id"), F.first("tokens").alias("tokens")).select("id", "tokens")
    return set_pairs(reps, reps, 0.5).select("l_id", "r_id", F.round("jaccard", 6).alias("jaccard"))


MATCH = dict(
    sets=SETS,
    new_sets="SELECT atom_id AS new_id, tokens FROM sets WHERE status <> 'active'",
    pairs="""SELECT new_id, atom_id, shared / (ln + rn - shared) AS jaccard FROM (SELECT n.new_id, o.atom_id, len(n.tokens) AS ln, len(o.tokens) AS rn, len(list_intersect(n.tokens, o.tokens)) AS shared
  FROM new_sets n JOIN sets o ON o.status = 'active' AND len(n.tokens) >= 0.6 * len(o.tokens) AND len(o.tokens) >= 0.6 * len(n.tokens)) WHERE shared / (ln + rn - shared) >= 0.6""",
    st="SELECT (SELECT count(*) FROM atoms) AS n_docs, (SELECT sum(len(bag)) FROM sets) * 1.0 / (SELECT count(*) FROM atoms) AS avg_len",
    post="SELECT atom_id, token, count(*) AS tf, max(dl) AS doc_len FROM (SELECT atom_id, unnest(bag) AS token, len(bag) AS dl FROM sets) GROUP BY 1, 2",
    fr="SELECT token, count(*) AS df FROM post GROUP BY 1",
    scored="""SELECT p.new_id, p.atom_id, any_value(p.jaccard) AS jaccard, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS bm25
  FROM pairs p JOIN (SELECT new_id, unnest(tokens) AS token FROM new_sets) n USING (new_id) JOIN post ON post.atom_id = p.atom_id AND post.token = n.token JOIN fr ON fr.token = n.token, st GROUP BY 1, 2""",
)


@check("jaccard_match", oracle("SELECT new_id, atom_id, round(jaccard, 6) AS jaccard, bm25 FROM (" + top("FROM scored", "new_id", "bm25 DESC, atom_id", 1) + ")", "atoms", **MATCH))
def _(s, d):
    (a,) = tables(s, d, "atoms")
    new = a.filter("status <> 'active'").select(F.col("atom_id").alias("new_id"), "content")
    return dedup.jaccard_match(new, a)


@check("semantic_pairs", oracle("""SELECT user_id, l_id, r_id, round(jaccard, 6) AS jaccard, sim FROM (
 SELECT a.user_id, a.atom_id AS l_id, b.atom_id AS r_id, len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) AS jaccard,
  round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS sim
 FROM sets a JOIN sets b ON a.user_id = b.user_id AND a.atom_id < b.atom_id AND a.status = 'active' AND b.status = 'active'
 JOIN embeddings x ON x.vec_id = a.atom_id JOIN embeddings y ON y.vec_id = b.atom_id) WHERE jaccard >= 0.1 AND sim > 0.05""", "atoms", sets=SETS))
def _(s, d):
    (a,) = tables(s, d, "atoms")
    return dedup.similar_pairs(a, 0.05, 0.1).withColumn("jaccard", F.round("jaccard", 6))


@check("semantic_new", oracle("SELECT new_id, atom_id, sim FROM (" + top("""SELECT s.*, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS sim FROM scored s
 JOIN atoms x ON x.atom_id = s.new_id JOIN atoms y ON y.atom_id = s.atom_id WHERE x.atom_id % 3 = y.atom_id % 3 AND x.embedding IS NOT NULL AND y.embedding IS NOT NULL
 AND list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) > 0.05""", "new_id", "bm25 DESC, atom_id", 1) + ")", "atoms",
                               **{**MATCH, "pairs": MATCH["pairs"].replace("0.6", "0.1")}))
def _(s, d):
    # the view gives a user only one status: other owners make stored and new rows meet
    (a,) = tables(s, d, "atoms")
    a = a.withColumn("user_id", F.concat(F.lit("g"), (F.col("atom_id") % 3).cast("string")))
    new = a.filter("status <> 'active'").withColumnRenamed("atom_id", "new_id")
    return dedup.semantic_new(new, a, 0.05, 0.1)


def scan_ctes(threshold: float, jaccard: float, vectors: str, owner: str = "'all'") -> dict[str, str]:
    """The scan of each owner's atoms: copies by counting, then turn by turn. ``vectors(atom_id, v)``."""
    return dict(
        sets=SETS,
        live=f"""SELECT s.atom_id, {owner} AS owner, s.bag, s.tokens, a.importance, v FROM sets s JOIN atoms a USING (atom_id) JOIN ({vectors}) USING (atom_id)
  WHERE a.status = 'active' AND list_dot_product(v, v) >= 1e-20""",
        copies="SELECT *, min(atom_id) OVER g AS gid, count(*) OVER g AS m, max(importance) OVER g AS top FROM live WINDOW g AS (PARTITION BY owner, list_sort(bag), v)",
        tied="SELECT gid, count(*) AS t, min(atom_id) AS first_id, max(atom_id) AS last_id, list(atom_id ORDER BY atom_id)[2] AS second_id FROM copies WHERE m > 1 AND importance = top GROUP BY gid",
        folded="""SELECT atom_id, gid, CASE WHEN atom_id = stays THEN 'active' ELSE 'dormant' END AS status,
   CASE WHEN importance = top AND t >= 2 AND atom_id <> second_id THEN 1 ELSE 0 END + CASE WHEN atom_id = stays THEN m - t ELSE 0 END AS wins
  FROM (SELECT c.*, t, second_id, CASE WHEN t >= 3 THEN last_id ELSE first_id END AS stays FROM copies c JOIN tied USING (gid) WHERE m > 1)""",
        alive="SELECT * FROM live WHERE atom_id NOT IN (SELECT atom_id FROM folded WHERE status = 'dormant')",
        near=f"""SELECT l_id, r_id FROM (SELECT a.atom_id AS l_id, b.atom_id AS r_id, len(a.tokens) AS ln, len(b.tokens) AS rn, len(list_intersect(a.tokens, b.tokens)) AS shared, list_cosine_similarity(a.v, b.v) AS sim
   FROM alive a JOIN alive b ON a.owner = b.owner AND a.atom_id <> b.atom_id AND len(a.tokens) >= {jaccard} * len(b.tokens) AND len(b.tokens) >= {jaccard} * len(a.tokens))
  WHERE shared / (ln + rn - shared) >= {jaccard} AND sim > {threshold}""",
        st=MATCH["st"], post=MATCH["post"], fr=MATCH["fr"],
        scores="""SELECT l_id, r_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS bm25
  FROM near JOIN (SELECT atom_id, unnest(tokens) AS token FROM alive) n ON n.atom_id = l_id JOIN post ON post.atom_id = r_id AND post.token = n.token JOIN fr ON fr.token = n.token, st GROUP BY 1, 2""",
        turns="""SELECT row_number() OVER (ORDER BY imp DESC, id) AS i, * FROM (SELECT l_id AS id, any_value(x.importance) AS imp, list(r_id ORDER BY bm25 DESC, r_id) AS partners,
   list(y.importance ORDER BY bm25 DESC, r_id) AS imps FROM scores JOIN alive x ON x.atom_id = l_id JOIN alive y ON y.atom_id = r_id GROUP BY 1)""",
        game="""SELECT 0::BIGINT AS i, []::BIGINT[] AS marked, NULL::BIGINT AS winner, NULL::BIGINT AS loser
 UNION ALL SELECT i, CASE WHEN loser IS NULL THEN marked ELSE list_append(marked, loser) END, winner, loser FROM (
  SELECT i, marked, CASE WHEN p IS NULL THEN NULL WHEN imp >= pimp THEN id ELSE p END AS winner, CASE WHEN p IS NULL THEN NULL WHEN imp >= pimp THEN p ELSE id END AS loser FROM (
   SELECT *, partners[k] AS p, imps[k] AS pimp FROM (
    SELECT t.*, g.marked, CASE WHEN list_contains(g.marked, t.id) THEN NULL ELSE list_position(list_transform(t.partners, lambda x: list_contains(g.marked, x)), false) END AS k
    FROM game g JOIN turns t ON t.i = g.i + 1)))""",
        scan="""SELECT atom_id, CASE WHEN bool_or(status = 'dormant') THEN 'dormant' ELSE 'active' END AS status, sum(wins)::BIGINT AS wins FROM (
  SELECT atom_id, status, wins FROM folded UNION ALL SELECT winner, 'active', count(*) FROM game WHERE winner IS NOT NULL GROUP BY 1 UNION ALL SELECT loser, 'dormant', 0 FROM game WHERE loser IS NOT NULL) GROUP BY 1""",
    )


def scan_sql(body: str, threshold: float, jaccard: float, vectors: str, owner: str = "'all'") -> str:
    return oracle(body, "atoms", **scan_ctes(threshold, jaccard, vectors, owner)).replace("WITH ", "WITH RECURSIVE ", 1).replace("game AS MATERIALIZED", "game AS")


STORED = "SELECT atom_id, CAST(embedding AS DOUBLE[]) AS v FROM atoms WHERE embedding IS NOT NULL"


@check("semantic_scan", scan_sql("SELECT * FROM scan", 0.1, 0.2, STORED))
def _(s, d):
    (a,) = tables(s, d, "atoms")
    return dedup.semantic_scan(a.withColumn("user_id", F.lit("all")), 0.1, 0.2)


BIGRAMS = """SELECT atom_id, concat('g', CAST(atom_id % 3 AS STRING)) AS grp, status, list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) AS tokens
 FROM (SELECT atom_id, status, replace(content, ' ', '') AS c FROM atoms) WHERE length(c) >= 4"""


@check("purge_forgotten", oracle("""SELECT atom_id FROM atoms WHERE atom_id NOT IN (SELECT o.atom_id FROM grams o JOIN grams n ON o.status = 'forgotten' AND n.status = 'active' AND o.grp = n.grp
 AND len(n.tokens) >= 2 AND len(o.tokens) >= 0.75 * len(n.tokens) AND len(n.tokens) >= 0.75 * len(o.tokens)
 WHERE len(list_intersect(o.tokens, n.tokens)) / (len(o.tokens) + len(n.tokens) - len(list_intersect(o.tokens, n.tokens))) >= 0.75)""", "atoms", grams=BIGRAMS))
def _(s, d):
    (a,) = tables(s, d, "atoms")
    a = a.withColumn("user_id", F.concat(F.lit("g"), (F.col("atom_id") % 3).cast("string")))
    return dedup.purge_forgotten(a.filter("status = 'active'").select("user_id", "content"), a, 0.75).select("atom_id")


# ------------------------------------------------------------- graph

@check("wikilinks", oracle("""SELECT page_id, array_to_string(list_distinct_in_order, ',') AS names FROM (SELECT page_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_in_order FROM (
 SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(html, '<(/?)([a-z0-9]+)[^>]*>', '[[\\2]]', 'g'), '\\[\\[([^\\[\\]]+?)\\]\\]', 1), lambda x: trim(x)), lambda x: length(x) > 0) AS t FROM pages))"""))
def _(s, d):
    (p,) = tables(s, d, "pages")
    linked = F.regexp_replace("html", r"<(/?)([a-z0-9]+)[^>]*>", "[[$2]]")
    return p.select("page_id", F.array_join(text.wikilinks(linked), ",").alias("names"))


@check("canonical_names", oracle("SELECT c_custkey AS k, regexp_replace(lower(trim(concat(c_name, ' ', c_mktsegment))), '\\s+', '_', 'g') AS name FROM customer"))
def _(s, d):
    (c,) = tables(s, d, "customer")
    return c.select(F.col("c_custkey").alias("k"), text.canonical_name(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("name"))


@check("edge_merge", oracle("""SELECT from_node, to_node, relation_type, coalesce(min(diary_id) FILTER (diary_id % 2 = 0), min(diary_id)) AS diary_id, round(sum(weight), 6) AS weight FROM (
 SELECT concat('p', CAST(least(l_partkey, l_suppkey) AS STRING)) AS a, concat('p', CAST(greatest(l_partkey, l_suppkey) AS STRING)) AS b, l_orderkey AS diary_id, l_quantity AS weight FROM lineitem) x,
 LATERAL (SELECT least(a, b) AS from_node, greatest(a, b) AS to_node, 'co_occur' AS relation_type) y GROUP BY 1, 2, 3"""))
def _(s, d):
    (li,) = tables(s, d, "lineitem")
    p = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    delta = li.select(p("l_partkey").alias("from_node"), p("l_suppkey").alias("to_node"), F.lit("co_occur").alias("relation_type"),
                      F.col("l_orderkey").alias("diary_id"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("seq"))
    none = s.createDataFrame([], "from_node string, to_node string, relation_type string, diary_id bigint, weight double")
    half = delta.filter("diary_id % 2 = 0")
    merged = graph.merge_edges(graph.merge_edges(none, half), delta.filter("diary_id % 2 = 1"))
    return merged.withColumn("weight", F.round("weight", 6)).select(
        "from_node", "to_node", "relation_type", "diary_id", "weight")


@check("cooccur", oracle("""SELECT a.from_node, b.from_node AS to_node, min(a.diary_id) AS diary_id, CAST(count(*) AS DOUBLE) AS weight FROM mentions a JOIN mentions b
 ON a.diary_id = b.diary_id AND a.from_node < b.from_node AND a.diary_id > 0 GROUP BY 1, 2""", "mentions"))
def _(s, d):
    return graph.recount_cooccurrence(*tables(s, d, "mentions")).select("from_node", "to_node", "diary_id", "weight")


@check("node_upsert", oracle("""SELECT from_node AS node_id, max_by(from_node, diary_id) AS name, count(*) + max(CASE WHEN from_node IN (SELECT from_node FROM mentions WHERE diary_id = 1) THEN 5 ELSE 0 END) AS count FROM mentions GROUP BY 1""", "mentions"))
def _(s, d):
    (m,) = tables(s, d, "mentions")
    at = F.lit("2023-01-01").cast("timestamp")
    old = m.filter("diary_id = 1").select(F.col("from_node").alias("node_id"), F.col("from_node").alias("name"), F.lit("entity").alias("type"),
                                          F.lit(5).cast("bigint").alias("count"), at.alias("created_at"), at.alias("updated_at"))
    new = m.select(F.col("from_node").alias("node_id"), F.col("from_node").alias("name"), F.lit("entity").alias("type"), F.col("diary_id").alias("seq"))
    return graph.upsert_nodes(old, new, NOW).select("node_id", "name", "count")


NB = dict(
    nodes="SELECT from_node AS node_id, from_node AS name, 'entity' AS type FROM mentions GROUP BY 1",
    asked="SELECT p_partkey AS query_id, concat('p', CAST(p_partkey AS STRING)) AS token FROM part",
    start="SELECT DISTINCT query_id, node_id FROM asked JOIN nodes ON contains(node_id, token)",
    edges="SELECT from_node, concat('diary:', CAST(diary_id AS STRING)) AS to_node, CAST(diary_id % 97 AS DOUBLE) AS weight FROM mentions",
    kept="SELECT query_id, e.* FROM edges e JOIN start s ON s.node_id = e.from_node",
)


@check("neighbors", oracle("SELECT query_id, from_node, to_node, weight FROM kept", "mentions", **NB))
def _(s, d):
    m, p = tables(s, d, "mentions", "part")
    nodes = m.select(F.col("from_node").alias("node_id"), F.col("from_node").alias("name"), F.lit("entity").alias("type")).distinct()
    edges = m.select("from_node", F.concat(F.lit("diary:"), F.col("diary_id").cast("string")).alias("to_node"), F.lit("mentions").alias("relation_type"),
                     (F.col("diary_id") % 97).cast("double").alias("weight"), F.lit("active").alias("status"))
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    return graph.neighbors(nodes, edges, asked)[1].select("query_id", "from_node", "to_node", "weight")


@check("index_diaries")
def _(s, d):
    (p,) = tables(s, d, "pages")
    linked = F.regexp_replace("html", r"<(/?)([a-z0-9]+)[^>]*>", "[[$2]]")
    dia_rows = p.select(F.col("page_id").alias("diary_id"), F.concat(F.lit("---\ndate: 2024-01-05\nmood: happy\ntopics: [\"a\", \"b\"]\n---\n"), linked).alias("content"))
    _n, edges = graph.index_diaries(dia_rows, people(s, d)[0])
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


# ------------------------------------------------------------- social ties

ACCESS = """SELECT uid, other, max(weight) AS weight FROM (
 SELECT from_user AS uid, to_user AS other, least(weight, cap) AS weight, status FROM social UNION ALL SELECT to_user, from_user, least(weight, cap), status FROM social
 UNION ALL SELECT uid, uid, 1.0, 'active' FROM (SELECT from_user AS uid FROM social UNION SELECT to_user FROM social)) GROUP BY 1, 2 HAVING max(weight) > 0 OR bool_or(status = 'active')"""


@check("accessible", oracle("SELECT * FROM access", "social", access=ACCESS))
def _(s, d):
    return social.accessible(*tables(s, d, "social"))


REQ = "SELECT DISTINCT concat('u_', CAST(o_custkey AS STRING)) AS actor, concat('u_', CAST(o_orderkey % 60 AS STRING)) AS target FROM orders"


def requests(s, d):
    (o,) = tables(s, d, "orders")
    u = lambda c: F.concat(F.lit("u_"), c.cast("string"))
    return o.select(u(F.col("o_custkey")).alias("actor"), u(F.col("o_orderkey") % 60).alias("target")).distinct()


@check("read_access", oracle("SELECT actor, target FROM req LEFT JOIN access ON uid = actor AND other = target WHERE actor = target OR weight >= 0.3", "social", access=ACCESS, req=REQ))
def _(s, d):
    return social.may_read(requests(s, d), social.accessible(*tables(s, d, "social")), 0.3)


@check("write_access", oracle("SELECT actor, target FROM req WHERE actor = target", req=REQ))
def _(s, d):
    return social.may_write(requests(s, d))


@check("persona_view", oracle("""SELECT actor, target, CASE WHEN w >= 0.6 THEN 'full' WHEN w >= 0.4 THEN 'summary' WHEN w > 0 THEN 'tier' ELSE 'name' END AS level,
 CASE WHEN w >= 0.6 THEN summary WHEN w >= 0.4 THEN substr(summary, 1, 200) END AS summary, CASE WHEN w > 0 THEN tier END AS tier FROM (
 SELECT actor, target, CASE WHEN actor = target THEN 1.0 ELSE coalesce(weight, 0.0) END AS w, summary, tier FROM req LEFT JOIN access ON access.uid = actor AND other = target LEFT JOIN personas p ON p.uid = target)""",
                               "social", "personas", access=ACCESS, req=REQ))
def _(s, d):
    so, p = tables(s, d, "social", "personas")
    return social.persona_view(requests(s, d), social.accessible(so), p)


@check("neighbour_edges", oracle("""SELECT from_user AS uid, to_user AS other, relation_type, status, weight FROM social WHERE status = 'active' AND weight >= 0.5
 UNION ALL SELECT to_user, from_user, relation_type, status, weight FROM social WHERE status = 'active' AND weight >= 0.5""", "social"))
def _(s, d):
    return social.neighbour_edges(*tables(s, d, "social"), status="active", min_weight=0.5)


@check("pending", oracle("SELECT to_user AS uid, from_user AS claimer, weight FROM social WHERE status = 'pending'", "social"))
def _(s, d):
    return social.pending_for(*tables(s, d, "social")).select("uid", "claimer", "weight")


@check("passive_relations", oracle("""SELECT DISTINCT actor AS from_user, target AS to_user, 'passive' AS status, 0.05 AS weight FROM req WHERE NOT EXISTS (SELECT 1 FROM social s WHERE s.status IN ('active', 'pending')
 AND ((s.from_user = actor AND s.to_user = target) OR (s.from_user = target AND s.to_user = actor)))""", "social", req=REQ))
def _(s, d):
    return social.passive_relations(requests(s, d).select(F.col("actor").alias("from_user"), F.col("target").alias("to_user")), *tables(s, d, "social")).select(
        "from_user", "to_user", "status", F.col("weight").cast("decimal(3,2)").alias("weight"))


@check("social_decay", oracle("""SELECT from_user, to_user, CASE WHEN status = 'pending' AND weight * pow(0.85, 14) < 0.02 THEN 'rejected' ELSE status END AS status,
 round(CASE WHEN status = 'active' THEN greatest(0.02, weight * pow(0.95, 14)) WHEN status = 'pending' AND weight * pow(0.85, 14) >= 0.02 THEN weight * pow(0.85, 14) ELSE weight END, 6) AS weight FROM social""", "social"))
def _(s, d):
    return social.decay(*tables(s, d, "social"), 14).select("from_user", "to_user", "status", F.round("weight", 6).alias("weight"))


ACTIONS = ("claim", "confirm", "reject", "block", "co_occur", "remove", "unblock", "claim")
LIVE = "(s.status IN ('pending', 'active'))"
CLAIMS = f"(e.action = 'claim' AND NOT s.bf AND NOT s.bb AND NOT coalesce({LIVE} AND s.fwd <> e.fwd, false))"
ANSWERS = "coalesce(s.status = 'pending' AND s.fwd <> e.fwd, false)"
MEETS = f"(e.action = 'co_occur' AND NOT coalesce({LIVE}, false))"
RELATIONS = dict(
    ev=f"""SELECT event_id AS seq, concat('u_', CAST((user_id + event_id) % 40 AS VARCHAR)) AS actor, concat('u_', CAST((user_id * 3 + event_id) % 40 AS VARCHAR)) AS target,
  ([{", ".join(f"'{x}'" for x in ACTIONS)}])[CAST((event_id * 7919) // 13 % 8 AS INT) + 1] AS action FROM events""",
    log="""SELECT *, row_number() OVER (PARTITION BY a, b, rel ORDER BY seq) AS n FROM (
  SELECT seq, least(actor, target) AS a, greatest(actor, target) AS b, action, actor <= target AS fwd, unnest(CASE WHEN action IN ('block', 'unblock') THEN ['friend_of', 'family_of', 'trusted_by'] ELSE ['friend_of'] END) AS rel
  FROM ev WHERE actor <> target)""",
    fold=f"""SELECT DISTINCT a, b, rel, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::BOOLEAN AS fwd, NULL::DOUBLE AS weight, NULL::DOUBLE AS cap, false AS bf, false AS bb FROM log
 UNION ALL SELECT s.a, s.b, s.rel, e.n,
  CASE WHEN {CLAIMS} THEN 'pending' WHEN e.action = 'confirm' AND {ANSWERS} THEN 'active' WHEN e.action = 'reject' AND {ANSWERS} THEN 'rejected' WHEN e.action = 'block' AND s.status IS NOT NULL THEN 'blocked'
   WHEN {MEETS} THEN 'passive' WHEN e.action = 'remove' AND s.status IS NOT NULL THEN 'rejected' ELSE s.status END,
  CASE WHEN {CLAIMS} OR {MEETS} THEN e.fwd ELSE s.fwd END,
  CASE WHEN {CLAIMS} THEN 0.1 WHEN e.action = 'confirm' AND {ANSWERS} THEN 0.7 WHEN {MEETS} THEN 0.05 ELSE s.weight END,
  CASE WHEN {CLAIMS} THEN 0.4 WHEN e.action = 'confirm' AND {ANSWERS} THEN 1.0 WHEN {MEETS} THEN 0.4 ELSE s.cap END,
  CASE WHEN e.fwd AND e.action = 'block' THEN true WHEN e.fwd AND e.action = 'unblock' THEN false ELSE s.bf END,
  CASE WHEN NOT e.fwd AND e.action = 'block' THEN true WHEN NOT e.fwd AND e.action = 'unblock' THEN false ELSE s.bb END
  FROM fold s JOIN log e ON e.a = s.a AND e.b = s.b AND e.rel = s.rel AND e.n = s.n + 1""",
    ends="SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY a, b, rel ORDER BY n DESC) = 1",
)


@check("relations_from_events", oracle("""SELECT CASE WHEN fwd THEN a ELSE b END AS from_user, CASE WHEN fwd THEN b ELSE a END AS to_user, rel AS relation_type, status, weight, cap FROM ends WHERE status IS NOT NULL
 UNION ALL SELECT a, b, 'blocked_by', 'active', 1.0, 1.0 FROM ends WHERE rel = 'friend_of' AND bf UNION ALL SELECT b, a, 'blocked_by', 'active', 1.0, 1.0 FROM ends WHERE rel = 'friend_of' AND bb""",
                                       **RELATIONS).replace("WITH ", "WITH RECURSIVE ", 1).replace("fold AS MATERIALIZED", "fold AS"))
def _(s, d):
    (e,) = tables(s, d, "events")
    act = F.element_at(F.array(*[F.lit(x) for x in ACTIONS]), F.expr("CAST((event_id * 7919) div 13 % 8 + 1 AS int)"))
    who = lambda n: F.concat(F.lit("u_"), ((F.col("user_id") * n + F.col("event_id")) % 40).cast("string"))
    return social.relations_from_events(e.select(F.col("event_id").alias("seq"), who(1).alias("actor"), who(3).alias("target"), act.alias("action"), F.lit("friend_of").alias("relation_type"))
                                        .filter("actor <> target"))


# ------------------------------------------------------------- people

@check("similar_users", oracle("""SELECT least(a.uid, b.uid) AS l_uid, greatest(a.uid, b.uid) AS r_uid, round(list_cosine_similarity(CAST(a.persona_embedding AS DOUBLE[]), CAST(b.persona_embedding AS DOUBLE[])), 4) AS sim
 FROM personas a JOIN personas b ON a.uid < b.uid WHERE list_cosine_similarity(CAST(a.persona_embedding AS DOUBLE[]), CAST(b.persona_embedding AS DOUBLE[])) >= 0.3""", "personas"))
def _(s, d):
    return users.similar(*tables(s, d, "personas"), 0.3)


@check("mark_similar", oracle("""SELECT uid, round(CASE WHEN s IS NULL THEN 0.3 ELSE least(0.95, 0.3 + 0.7 * s) END, 6) AS confidence FROM (SELECT DISTINCT uid FROM identities) LEFT JOIN (
 SELECT uid, min(sim) AS s FROM (SELECT a.uid, round(list_cosine_similarity(CAST(a.persona_embedding AS DOUBLE[]), CAST(b.persona_embedding AS DOUBLE[])), 4) AS sim FROM personas a JOIN personas b ON a.uid <> b.uid
 WHERE list_cosine_similarity(CAST(a.persona_embedding AS DOUBLE[]), CAST(b.persona_embedding AS DOUBLE[])) >= 0.35) GROUP BY 1) USING (uid)""", "personas", "identities"))
def _(s, d):
    (p,) = tables(s, d, "personas")
    u = people(s, d)[0].withColumn("confidence", F.lit(0.3))
    return users.mark_similar(u, users.least_partner(p, 0.35)).select("uid", F.round("confidence", 6).alias("confidence"))


@check("identity_upsert", oracle("""SELECT coalesce(i.uid, concat('u_', substr(sha256(concat('qq:', CAST(k AS VARCHAR))), 1, 12))) AS uid, count(*) AS seen FROM (
 SELECT DISTINCT o_custkey + 1000000 AS k FROM orders) LEFT JOIN (SELECT platform_id, min(uid) AS uid FROM identities WHERE platform = 'qq' GROUP BY 1) i ON i.platform_id = CAST(k AS VARCHAR) GROUP BY 1""", "identities"))
def _(s, d):
    (o,) = tables(s, d, "orders")
    us, ids = people(s, d)
    at = F.lit("2023-01-01").cast("timestamp")
    us = us.select("uid", "names", F.lit(0.3).alias("confidence"), at.alias("created_at"), at.alias("updated_at"))
    ids = ids.select("uid", "platform_ids", at.alias("first_seen"), at.alias("last_seen"), "verified", F.lit("etl").alias("source"))
    key = (F.col("o_custkey") + 1000000).cast("string")
    seen = o.select(F.col("o_orderkey").alias("seq"), F.lit("qq").alias("platform"), key.alias("platform_id"), F.concat(F.lit("N"), key).alias("name"))
    u, _ids = users.upsert(us, ids, seen, NOW)
    fresh = u.select("uid", F.size(F.filter("names", lambda n: n.startswith("N"))).alias("seen"))
    return fresh.filter("seen > 0").select("uid", F.col("seen").cast("bigint").alias("seen"))


@check("persona_inputs", oracle("""SELECT user_id, facts, coalesce(held, '（无新日记）') AS diaries
 FROM (SELECT user_id, string_agg('- ' || content, chr(10) ORDER BY rank) AS facts FROM last GROUP BY 1)
 LEFT JOIN (SELECT user_id, string_agg('- ' || content, chr(10) ORDER BY rank) AS held FROM kept GROUP BY 1) USING (user_id)""", "atoms", "links", "diaries",
    last=top("SELECT * FROM atoms WHERE status = 'active'", "user_id", "atom_id DESC", 10),
    kept=top("SELECT DISTINCT l.user_id, d.diary_id, d.content FROM last l JOIN links k USING (atom_id) JOIN diaries d ON d.diary_id = k.diary_id", "user_id", "diary_id DESC", 5)))
def _(s, d):
    p, a, l, di = tables(s, d, "personas", "atoms", "links", "diaries")
    return users.incremental_inputs(p.withColumn("tags", F.array("tier")), a, l, di, facts=10, held=5).select("user_id", "facts", "diaries")


@check("persona_rebuild_inputs", oracle("SELECT user_id, count(*) AS facts FROM (" + top("SELECT * FROM atoms WHERE status = 'active' AND importance > 0.3", "user_id", "created_at DESC, atom_id", 30) + ") GROUP BY 1", "atoms"))
def _(s, d):
    r = users.rebuild_inputs(*tables(s, d, "atoms", "links", "diaries"), facts=30, held=10)
    return r.select("user_id", F.size(F.filter(F.split("facts", "\n"), lambda x: x.rlike(r"^- \[(episodic|factual|preference|planned|relational|unknown)\] "))).cast("bigint").alias("facts"))


# ------------------------------------------------------------- captured text

@check("mood_map", oracle("""SELECT o_orderkey AS k, CASE m WHEN 'happy' THEN 'positive' WHEN 'sad' THEN 'negative' WHEN 'angry' THEN 'negative' WHEN 'mixed' THEN 'mixed' ELSE 'neutral' END AS sentiment FROM (
 SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'happy' WHEN 'F' THEN 'sad' WHEN 'P' THEN 'mixed' ELSE o_orderstatus END AS m FROM orders)"""))
def _(s, d):
    (o,) = tables(s, d, "orders")
    m = F.when(F.col("o_orderstatus") == "O", "Happy ").when(F.col("o_orderstatus") == "F", "sad").when(F.col("o_orderstatus") == "P", "mixed").otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("k"), dia.mood_to_sentiment(m).alias("sentiment"))


@check("quality_flags", oracle("""SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'low' ELSE 'normal' END AS diary_quality,
 contains(lower(text), 'someone') OR contains(lower(text), 'somebody') OR contains(lower(text), 'the user') AS generic_terms FROM documents"""))
def _(s, d):
    (do,) = tables(s, d, "documents")
    f = quality.capture_flags(do.withColumn("contents", F.array("text")).withColumn("importance", F.lit(0.5)), diary="text")
    return f.select("doc_id", "diary_quality", "generic_terms")


@check("enum_violations", oracle("SELECT 'atom_type' AS \"column\", event_type AS value, count(*) AS n FROM events GROUP BY 2"))
def _(s, d):
    (e,) = tables(s, d, "events")
    return quality.enum_violations(e.select(F.col("event_type").alias("atom_type"), F.lit("active").alias("status"), F.lit("step").alias("decay_type")))


@check("list_summary", oracle("""SELECT diary_id, CASE WHEN length(content) > 10 THEN substr(content, 1, 150) WHEN length(h) > 0 THEN substr(h, 1, 150) ELSE '(无内容)' END AS summary FROM (
 SELECT diary_id, content, regexp_replace(replace(content, '---', ''), '^\\s+|\\s+$', '', 'g') AS h FROM diaries)""", "diaries"))
def _(s, d):
    (di,) = tables(s, d, "diaries")
    return di.select("diary_id", dia.list_summary(F.col("content")).alias("summary"))
