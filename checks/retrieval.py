"""Retrieval queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import oracle, tables
from recollect.operators import search
from recollect.plans import recall as recall_plan
from recollect.session import shared_folder

_RUN = "([\\p{L}\\p{N}_]+)"
_STOP = "'" + "','".join(search.text.STOP_WORDS) + "'"

# keyword rows of the recall queries
TERMS = f"""
SELECT query_id, unnest(kws) AS token FROM (
 SELECT query_id, list_filter(list_distinct_ordered, lambda x: (regexp_full_match(x, '[a-z0-9_]+') OR length(x) >= 2) AND x NOT IN ({_STOP})) AS kws FROM (
  SELECT query_id, list_transform(list_filter(list_zip(toks, range(1, len(toks) + 1)), lambda z: list_position(toks, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered
  FROM (SELECT query_id, regexp_extract_all(lower(query), '{_RUN}', 1) AS toks FROM recall_queries)))"""
DOC_TOKENS = f"""
SELECT atom_id, unnest(toks) AS token, len(toks) AS doc_len FROM (
 SELECT atom_id, CASE WHEN len(w) > 0 THEN w ELSE CASE WHEN length(replace(content, ' ', '')) >= 2 THEN list_transform(range(1, length(replace(content, ' ', ''))), lambda i: substr(replace(content, ' ', ''), i, 2)) ELSE [] END END AS toks FROM (
  SELECT atom_id, content, list_filter(regexp_extract_all(lower(content), '{_RUN}', 1), lambda x: length(x) >= 2) AS w FROM atoms))"""
STATS = """
SELECT (SELECT count(*) FROM atoms) AS n_docs, (SELECT count(*) FROM doc_tokens) * 1.0 / (SELECT count(*) FROM atoms) AS avg_len"""
POSTINGS = "SELECT atom_id, token, count(*) AS tf, max(doc_len) AS doc_len FROM doc_tokens WHERE token IN (SELECT token FROM terms) GROUP BY 1, 2"
FREQ = "SELECT token, count(*) AS df FROM postings GROUP BY 1"


def bm25_cte(terms: str) -> str:
    return f"""
SELECT query_id, atom_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS bm25
FROM (SELECT DISTINCT query_id, token FROM terms WHERE {terms}) q JOIN postings USING (token) JOIN freq USING (token), stats GROUP BY 1, 2"""


def top(src: str, keys: str, order: str, k: int, cols: str = "*", rank: str = "rank") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT {cols}, row_number() OVER ({part}ORDER BY {order}) AS {rank} FROM ({src}) QUALIFY {rank} <= {k}"


def bm25_top(hits: str, k: int, pool: int | None = None) -> str:
    cand = f"SELECT h.*, a.importance FROM {hits} h JOIN atoms a USING (atom_id) WHERE a.status = 'active'"
    if pool is not None:
        cand = top(cand, "query_id", "bm25 DESC, atom_id", pool, rank="bm25_rank")
    return top(f"SELECT *, round(importance * 0.6, 6) AS score FROM ({cand})", "query_id", "score DESC, bm25 DESC, atom_id", k)


INDEX = dict(terms=TERMS, doc_tokens=DOC_TOKENS, stats=STATS, postings=POSTINGS, freq=FREQ)
RQ = ("atoms", "recall_queries")


@check("keyword_extraction", oracle("SELECT query_id, token FROM terms", "recall_queries", terms=TERMS))
def _(spark, d):
    (q,) = tables(spark, d, "recall_queries")
    return search.query_terms(q).select("query_id", "token")


@check("bm25_topk", oracle("SELECT query_id, atom_id, rank, score, bm25 FROM picked", *RQ, **INDEX,
                           hits=bm25_cte("true"), picked=bm25_top("hits", 10)))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.bm25_atoms(a.drop("embedding"), search.query_terms(q), 10)


def kept_index(spark, atoms):
    """The atoms' index, written in two batches and read back."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4()}"
    for batch in (0, 1):
        search.write_index(atoms.filter(F.col("atom_id") % 2 == batch), folder, batch)
    return search.read_index(spark, folder)


@check("bm25_indexed", oracle("SELECT query_id, atom_id, rank, score, bm25 FROM picked", *RQ, **INDEX,
                              hits=bm25_cte("true"), picked=bm25_top("hits", 10)))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    a = a.drop("embedding")
    return search.bm25_atoms(a, search.query_terms(q), 10, **kept_index(spark, a))


@check("bm25_pool", oracle("SELECT query_id, atom_id, rank, score, bm25 FROM picked", *RQ, **INDEX,
                           hits=bm25_cte("true"), picked=bm25_top("hits", 10, 30)))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.bm25_atoms(a.drop("embedding"), search.query_terms(q), 10, pool=30)


@check("bm25_normalized", oracle(
    "SELECT query_id, atom_id, rank, score, bm25 FROM (" + top("SELECT *, round(importance * 0.6 + bm25 / max(bm25) OVER (PARTITION BY query_id) * 0.4, 6) AS score FROM cand", "query_id", "score DESC, bm25 DESC, atom_id", 10) + ")",
    *RQ, **INDEX, hits=bm25_cte("true"),
    cand="SELECT h.*, a.importance FROM hits h JOIN atoms a USING (atom_id) WHERE a.status = 'active'"))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.bm25_atoms(a.drop("embedding"), search.query_terms(q), 10, mode="normalized")


@check("bm25_own_user", oracle("SELECT query_id, atom_id, rank, score, bm25 FROM picked", *RQ, **INDEX, all_hits=bm25_cte("true"),
                               hits="SELECT h.* FROM all_hits h JOIN atoms a USING (atom_id) JOIN recall_queries q ON q.query_id = h.query_id AND q.user_id = a.user_id",
                               picked=bm25_top("hits", 5)))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.bm25_atoms(a.drop("embedding"), search.query_terms(q), 5, query_users=q.select("query_id", "user_id"))


@check("bm25_rank_only", oracle("SELECT query_id, atom_id, rank, bm25 FROM (" + top(
    "SELECT h.* FROM hits h JOIN atoms a USING (atom_id) WHERE a.status = 'active'", "query_id", "bm25 DESC, atom_id", 1 << 60) + ")",
    *RQ, **INDEX, hits=bm25_cte("true")))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.bm25_ranked(a.drop("embedding"), search.query_terms(q)).select("query_id", "atom_id", "rank", "bm25")


def keyword_ctes(k: int) -> dict[str, str]:
    return dict(
        INDEX,
        fts="""SELECT DISTINCT query_id, atom_id FROM terms JOIN postings USING (token) JOIN atoms a USING (atom_id)
   WHERE a.status = 'active' AND length(token) >= 2 AND regexp_full_match(token, '[a-z0-9_]+')""",
        like_hits="""SELECT t.token, a.atom_id, a.importance FROM (SELECT DISTINCT token FROM terms WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[a-z0-9_]+')) t
   JOIN atoms a ON a.status = 'active' AND contains(translate(a.content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(t.token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))""",
        kw_scored="""SELECT query_id, atom_id, importance, round(importance * 0.7 + least(sum(hit), 1.0) * 0.3, 6) AS score FROM (
   SELECT query_id, atom_id, a.importance, a.importance AS hit FROM fts JOIN atoms a USING (atom_id)
   UNION ALL SELECT query_id, atom_id, importance, 0.3 AS hit FROM like_hits JOIN (SELECT DISTINCT query_id, token FROM terms) USING (token)) GROUP BY 1, 2, 3""",
        kw_route=top("FROM kw_scored", "query_id", "score DESC, importance DESC, atom_id", k, "query_id, atom_id, score"),
    )


@check("keyword_route", oracle("SELECT query_id, atom_id, rank, score FROM kw_route", *RQ, **keyword_ctes(20)))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.keyword_route(a.drop("embedding"), search.query_terms(q), 20)


def vec_cte(k: int, where: str = "true") -> str:
    return top(f"""SELECT q.query_id, a.atom_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
 FROM recall_queries q JOIN atoms a ON a.status = 'active' AND a.embedding IS NOT NULL AND q.embedding IS NOT NULL AND {where}""",
               "query_id", "score DESC, atom_id", k)


@check("vector_topk", oracle("SELECT query_id, atom_id, rank, score FROM vec", *RQ, vec=vec_cte(10)))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.vector_atoms(a, q, 10)


@check("vector_filtered", oracle("SELECT query_id, atom_id, rank, score FROM vec", *RQ, vec=vec_cte(5, "a.user_id = 'u_3'")))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.vector_atoms(a, q, 5, user_id="u_3")


# graph side for retrieval: one entity per distinct benchmark word, mentioned by every diary that holds it
WORD_NODES = f"""
SELECT concat('entity:', word) AS node_id, word AS name, 'entity' AS type, e.embedding, TIMESTAMP '2024-01-01 00:00:00' AS updated_at, n FROM (
 SELECT word, row_number() OVER (ORDER BY word) - 1 AS n FROM (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_RUN}', 1)) AS word FROM benchmark) WHERE length(word) >= 2) w
LEFT JOIN embeddings e ON e.vec_id = w.n"""
WORD_MENTIONS = f"""
SELECT DISTINCT concat('entity:', word) AS from_node, diary_id FROM (
 SELECT unnest(regexp_extract_all(lower(content), '{_RUN}', 1)) AS word, diary_id FROM diaries) WHERE word IN (SELECT name FROM nodes)"""


def word_graph(spark, d):
    """Nodes and mentions derived from the benchmark and document texts."""
    b, dia, e = tables(spark, d, "benchmark", "diaries", "embeddings")
    words = b.select(F.explode(search.text.words(F.col("text"))).alias("word")).distinct().filter(F.length("word") >= 2)
    from pyspark.sql import Window

    # a vocabulary of benchmark words: a few hundred rows
    n = words.withColumn("n", F.row_number().over(Window.orderBy("word")) - 1)
    nodes = n.join(e.select(F.col("vec_id").alias("n"), "embedding"), "n", "left").select(
        F.concat(F.lit("entity:"), "word").alias("node_id"), F.col("word").alias("name"), F.lit("entity").alias("type"),
        "embedding", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    held = dia.select("diary_id", F.explode(F.array_distinct(search.text.words(F.col("content")))).alias("word"))
    mentions = held.join(words, "word", "left_semi").select(F.concat(F.lit("entity:"), "word").alias("from_node"), "diary_id")
    return nodes, mentions


def graph_kw_ctes(k: int, per_keyword: int = 1 << 60, newest: int = 1 << 60) -> dict[str, str]:
    return dict(
        node_hits=top("""SELECT t.token, n.node_id FROM (SELECT DISTINCT token FROM terms WHERE length(token) >= 2) t JOIN nodes n ON contains(concat(n.name, chr(10), n.node_id), t.token)""",
                      "token", "node_id", per_keyword),
        heads="SELECT DISTINCT query_id, node_id FROM node_hits JOIN terms USING (token)",
        head_diaries=top("SELECT DISTINCT query_id, diary_id FROM heads JOIN mentions ON from_node = node_id AND diary_id > 0", "query_id", "diary_id DESC", newest),
        gk_route=top("""SELECT query_id, atom_id, max(l.importance) AS score FROM head_diaries h JOIN links l USING (diary_id) JOIN atoms a USING (atom_id) WHERE a.status = 'active' GROUP BY 1, 2""",
                     "query_id", "score DESC, atom_id", k),
    )


def graph_vec_ctes(k: int, nearest: int = 1 << 60) -> dict[str, str]:
    return dict(
        vector_nodes="SELECT node_id, embedding FROM nodes WHERE embedding IS NOT NULL",
        near_nodes=top("""SELECT q.query_id, n.node_id, round(greatest(0.0, list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS sim
   FROM (SELECT * FROM recall_queries WHERE embedding IS NOT NULL AND query_id IN (SELECT query_id FROM terms)) q, vector_nodes n""", "query_id", "sim DESC, node_id", nearest),
        node_diaries="SELECT DISTINCT from_node AS node_id, diary_id FROM mentions WHERE diary_id > 0 AND from_node IN (SELECT node_id FROM near_nodes)",
        node_atoms="SELECT DISTINCT node_id, atom_id, a.importance AS ai FROM node_diaries JOIN links l USING (diary_id) JOIN atoms a USING (atom_id) WHERE a.status = 'active'",
        gv_route="SELECT query_id, atom_id, rank, round(score, 6) AS score FROM (" + top(
            "SELECT query_id, atom_id, max(sim * ai) AS score FROM near_nodes JOIN node_atoms USING (node_id) WHERE sim > 0 GROUP BY 1, 2", "query_id", "score DESC, atom_id", k, "query_id, atom_id, score") + ")",
    )


GV = ("atoms", "diaries", "links", "recall_queries")
GRAPH = dict(terms=TERMS, nodes=WORD_NODES, mentions=WORD_MENTIONS)


@check("node_keyword_match", oracle("SELECT query_id, node_id FROM heads", "diaries", "recall_queries", terms=TERMS, nodes=WORD_NODES,
                                    **{k: v for k, v in graph_kw_ctes(10).items() if k in ("node_hits", "heads")}))
def _(spark, d):
    (q,) = tables(spark, d, "recall_queries")
    nodes, _m = word_graph(spark, d)
    return search.match_nodes(nodes, search.query_terms(q))


@check("graph_keyword_route", oracle("SELECT query_id, atom_id, rank, round(score, 6) AS score FROM gk_route", *GV, **GRAPH, **graph_kw_ctes(10)))
def _(spark, d):
    a, l, q = tables(spark, d, "atoms", "links", "recall_queries")
    nodes, m = word_graph(spark, d)
    return search.graph_keyword_route(a.drop("embedding"), l, nodes, m, search.query_terms(q), 10)


@check("graph_keyword_newest", oracle("SELECT query_id, atom_id, rank, round(score, 6) AS score FROM gk_route", *GV, **GRAPH, **graph_kw_ctes(10, 10, 30)))
def _(spark, d):
    a, l, q = tables(spark, d, "atoms", "links", "recall_queries")
    nodes, m = word_graph(spark, d)
    return search.graph_keyword_route(a.drop("embedding"), l, nodes, m, search.query_terms(q), 10, mode="reference")


@check("node_vector_search", oracle("SELECT query_id, node_id, rank, sim AS score FROM near_nodes", "diaries", "recall_queries", terms=TERMS, nodes=WORD_NODES,
                                    **{k: v for k, v in graph_vec_ctes(5, 15).items() if k in ("vector_nodes", "near_nodes")}))
def _(spark, d):
    (q,) = tables(spark, d, "recall_queries")
    nodes, _m = word_graph(spark, d)
    return search.vector_nodes(nodes, q, 15)


@check("graph_vector_route", oracle("SELECT query_id, atom_id, rank, score FROM gv_route", *GV, **GRAPH, **graph_vec_ctes(10)))
def _(spark, d):
    a, l, q = tables(spark, d, "atoms", "links", "recall_queries")
    nodes, m = word_graph(spark, d)
    return search.graph_vector_route(a.drop("embedding"), l, nodes, m, q, 10)


def rrf_cte(routes: list[str], k: int) -> str:
    u = " UNION ALL ".join(f"SELECT query_id, atom_id, rank FROM {r}" for r in routes)
    return top(f"SELECT query_id, atom_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best FROM ({u}) GROUP BY 1, 2", "query_id", "score DESC, best, atom_id", k, "query_id, atom_id, score")


@check("rrf_two_routes", oracle("SELECT query_id, atom_id, rank, score FROM fused", *RQ, **keyword_ctes(20), vec=vec_cte(20), fused=rrf_cte(["kw_route", "vec"], 10)))
def _(spark, d):
    a, q = tables(spark, d, "atoms", "recall_queries")
    return search.rrf([search.keyword_route(a.drop("embedding"), search.query_terms(q), 20), search.vector_atoms(a, q, 20)], 10)


def multi_ctes(k: int) -> dict[str, str]:
    return dict(keyword_ctes(2 * k), nodes=WORD_NODES, mentions=WORD_MENTIONS, vec=vec_cte(2 * k, "q.query_id IN (SELECT query_id FROM terms)"),
                **graph_kw_ctes(2 * k), **graph_vec_ctes(2 * k),
                doc_fused=rrf_cte(["kw_route", "vec"], k), graph_fused=rrf_cte(["gk_route", "gv_route"], k),
                fused=rrf_cte(["doc_fused", "graph_fused"], k))


@check("multi_route", oracle("SELECT query_id, atom_id, rank, score FROM fused", *GV, **multi_ctes(10)))
def _(spark, d):
    a, l, q = tables(spark, d, "atoms", "links", "recall_queries")
    nodes, m = word_graph(spark, d)
    return search.multi_route(a, l, nodes, m, search.query_terms(q), q, 10)


@check("multi_route_own", oracle("SELECT query_id, atom_id, rank, score FROM fused", *GV, **{
    "own": top("SELECT query_id, a.atom_id, a.importance FROM recall_queries q JOIN atoms a USING (user_id) WHERE a.status = 'active'", "query_id", "importance DESC, atom_id", 20, "query_id, atom_id"), **multi_ctes(10),
    "doc_fused": rrf_cte(["kw_route", "vec", "own"], 10), "graph_fused": rrf_cte(["gk_route", "gv_route"], 10), "fused": rrf_cte(["doc_fused", "graph_fused"], 10)}))
def _(spark, d):
    """A caller's route, the most important atoms of the asking user, beside the four."""
    a, l, q = tables(spark, d, "atoms", "links", "recall_queries")
    nodes, m = word_graph(spark, d)
    mine = q.select("query_id", "user_id").join(a.filter("status = 'active'").select("user_id", "atom_id", "importance"), "user_id")
    own = search.top_n(mine, ["query_id"], [F.desc("importance"), F.asc("atom_id")], 20)
    return search.multi_route(a, l, nodes, m, search.query_terms(q), q, 10, doc_routes=[own])


def recall_ctes(k: int, cand: int) -> dict[str, str]:
    return dict(
        multi_ctes(cand),
        filler=f"SELECT atom_id, importance FROM atoms WHERE status = 'active' ORDER BY importance DESC, atom_id DESC LIMIT {cand}",
        filled=top("""SELECT query_id, atom_id, 0 AS src, CAST(rank AS DOUBLE) AS o FROM fused
   UNION ALL SELECT q.query_id, f.atom_id, 1, -f.importance FROM recall_queries q, filler f WHERE NOT EXISTS (SELECT 1 FROM fused x WHERE x.query_id = q.query_id AND x.atom_id = f.atom_id)""",
                   "query_id", "src, o, atom_id DESC", cand, "query_id, atom_id"),
        friends="SELECT uid, friend, max(weight) AS weight FROM (SELECT from_user AS uid, to_user AS friend, weight FROM social UNION ALL SELECT to_user, from_user, weight FROM social) GROUP BY 1, 2",
        ranked=top("""SELECT f.query_id, f.atom_id, f.rank AS pos, round((CASE WHEN n > 1 THEN 1.0 - (f.rank - 1) * 1.0 / (n - 1) ELSE 1.0 END)
    * (1.0 + 0.3 * CASE WHEN a.user_id = q.user_id THEN 1.0 ELSE coalesce(w.weight, 0.0) END), 6) AS score
   FROM filled f JOIN (SELECT query_id, max(rank) AS n FROM filled GROUP BY 1) s USING (query_id) JOIN atoms a USING (atom_id) JOIN recall_queries q USING (query_id)
   LEFT JOIN friends w ON w.uid = q.user_id AND w.friend = a.user_id""", "query_id", "score DESC, pos", k, "query_id, atom_id, score"))


GS = GV + ("social",)


def recall_inputs(spark, d):
    a, l, q, s = tables(spark, d, "atoms", "links", "recall_queries", "social")
    nodes, m = word_graph(spark, d)
    return dict(queries=q.select("query_id", "user_id", "query"), atoms=a, links=l, nodes=nodes, mentions=m, edges=s,
                query_vectors=q.select("query_id", "embedding"))


@check("recall_indexed", oracle("SELECT query_id, atom_id, rank, score FROM ranked", *GS, **recall_ctes(5, 50)))
def _(spark, d):
    i = recall_inputs(spark, d)
    return recall_plan.recall(**i, k=5, **kept_index(spark, i["atoms"]))


@check("recall_topk", oracle("SELECT query_id, atom_id, rank, score FROM ranked", *GS, **recall_ctes(5, 50)))
def _(spark, d):
    return recall_plan.recall(**recall_inputs(spark, d), k=5)
