"""The registered query of each operator over the driver's tables, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import (
    content, hilbert, langid, packing, phrases, pieces, prefixtrie, pseudolm, quality, sharding, shortestpack, simhash, urlfilter,
)

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# What decides where no rule fits: names that no training text should come from.
GLOBS = (("block", "*ads-track.**"), ("block", "*adult-*.**"), ("block", "*free-bets.**"), ("block", "*cheap-pills.**"))
SHARDS = 8
SEQUENCE = 4096
END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"), ngram=3, budget=3)


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudolm.score(docs).select("doc_id", "n_words", "log_prob", "mean_log_prob")


def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hilbert.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def op4_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.stratified_shards(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, RULES, GLOBS).select("page_id", "host", "path", "rule", "verdict")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out() & F.col("lang").isNotNull())
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    return langid.identify(slim, labelled).select("doc_id", "held_out", "lang_pred", "score")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.encode(docs, model, decoded="decoded")
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")).alias("round_trip"),
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return content.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, SEQUENCE)
    return packing.pack(cut, SEQUENCE)


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = shortestpack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c goes on from the first crc32(c) % 6 turns of conversation c - c % 100."""
    lists = prefixtrie.turn_lists(table(spark, sf_dir, "conversations"))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    rebuilt = prefixtrie.spliced(lists, F.col("conv_id") - F.col("conv_id") % 100, shared, 5)
    nodes, members = prefixtrie.prefix_trie(rebuilt)
    named = prefixtrie.with_end_hashes(prefixtrie.with_parent(nodes), members)
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return phrases.collocations(docs, least=100, depth=5, top=2_000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_pseudo_likelihood, op3_hilbert, op4_interleave, op5_url_rules, op6_language, op7_pieces,
              op8_main_text, op9_bin_slack, op10_line_rules, op11_shortest_pack, op12_prefix_trie, op13_collocations)
}

ORACLES: dict[str, str] = {
    # CRC-32 bit by bit, lowest bit of each byte first
    "op4_interleave": """
WITH bits AS (
 SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
 SELECT doc_id, source, n + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
   list_filter(regexp_split_to_array(regexp_replace(h, '(..)', '\\1 ', 'g'), ' '), lambda x: x <> ''),
   lambda x: list_transform(range(8), lambda i: (('0x' || x)::BIGINT >> i) & 1)))),
   lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) AS text_crc32
 FROM bits),
ranked AS (
 SELECT *, md5('17|' || coalesce(doc_id::VARCHAR, '')) AS hash,
  row_number() OVER (PARTITION BY source ORDER BY md5('17|' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS place,
  count(*) OVER (PARTITION BY source) AS peers, count(*) OVER () AS total FROM crc),
positioned AS (
 SELECT *, row_number() OVER (ORDER BY (2 * place + 1)::DOUBLE / (2 * peers), source NULLS FIRST, hash, doc_id NULLS FIRST) - 1 AS pos FROM ranked),
cut AS (SELECT *, (pos * 8 // total)::INTEGER AS shard FROM positioned)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard,
 (row_number() OVER (PARTITION BY shard ORDER BY pos) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut""",
    "op5_url_rules": """
WITH parts AS (
 SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule, rule_verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
split AS (SELECT rule, rule_verdict, substr(rule, 1, position('/' IN rule) - 1) AS rh, substr(rule, position('/' IN rule)) AS rp FROM rules),
best AS (
 SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
 FROM parts JOIN split ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.rule_verdict,
  CASE WHEN regexp_matches(p.host || p.path, '^[^/]*(ads-track|free-bets|cheap-pills)[.]|^[^/]*adult-[^/]*[.]') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path""",
    "op10_line_rules": """
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS word,
  generate_subscripts(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) AS i FROM docs),
g AS (SELECT *, lead(word) OVER (PARTITION BY k ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY k ORDER BY i) AS c FROM w),
f AS (SELECT *, (c IS NOT NULL AND count(*) OVER (PARTITION BY k, word, b, c) > 1)::INTEGER AS again FROM g),
v AS (SELECT k, word, greatest(again, lag(again, 1, 0) OVER (PARTITION BY k ORDER BY i), lag(again, 2, 0) OVER (PARTITION BY k ORDER BY i)) AS hit FROM f),
counts AS (SELECT k, count(*) AS n_words, sum(length(word)) AS word_chars, sum(hit) AS n_repeat_words FROM v GROUP BY k),
lines AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
each AS (SELECT k, unnest(list_distinct(l)) AS line FROM lines),
bodies AS (
 SELECT *, length(regexp_replace(body, '[^|›•]', '', 'g')) + (length(body) - length(replace(body, ' » ', ''))) / 3.0 + (length(body) - length(replace(body, ' · ', ''))) / 3.0 AS fields
 FROM (SELECT k, line, rtrim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS body FROM each)),
good AS (
 SELECT k, sum(length(line)) AS kept_chars FROM bodies
 WHERE (length(body) >= 200 OR contains('.!?…:;"''‘‚“„«‹‽⁇⁈⁉。！．？：；｡؟۔؛।॥։՜՞።፧፨၊။។៕ฯ๚෴᠃᠉', right(body, 1)) OR regexp_matches(right(body, 1), '[\\p{Pe}\\p{Pf}]'))
  AND NOT (fields >= 3 AND length(body) < 25 * (fields + 1))
  AND length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) * 20 <= length(body)
  AND NOT (upper(body) = body AND lower(body) <> body AND length(body) >= 20)
  AND NOT (length(body) < 200 AND regexp_matches(lower(body), 'all rights reserved|cookie|javascript|terms of use|terms of service|privacy policy|lorem ipsum|subscribe to our newsletter|licensed under|released under the'))
 GROUP BY k),
sums AS (SELECT k, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS all_chars FROM lines),
base AS (
 SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, all_chars, coalesce(kept_chars, 0) AS kept_chars
 FROM docs LEFT JOIN counts USING (k) LEFT JOIN sums USING (k) LEFT JOIN good USING (k)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND all_chars - kept_chars <= 0.5 * all_chars AS kept FROM failed""",
    # CRC-32 as above; a prefix is the list of its turns, told apart by its MD5
    "op12_prefix_trie": """
WITH turns AS (
 SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
 FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
 SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
   range(1, length(conv_id::VARCHAR) + 1), lambda p: list_transform(range(8), lambda i: (ascii(substr(conv_id::VARCHAR, p, 1)) >> i) & 1)))),
   lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b::BIGINT) & 1))), 4294967295::BIGINT) % 6 AS h
 FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
 SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
 UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
lists AS (
 SELECT c.conv_id, coalesce(l.turns, []) AS turns, coalesce(l.lens, []) AS lens FROM convs c LEFT JOIN (
  SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY pos) AS turns, list(length(text) ORDER BY pos) AS lens
  FROM rebuilt GROUP BY conv_id) l USING (conv_id)),
steps AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns, lens FROM lists),
prefixes AS (
 SELECT conv_id, depth, md5(list_aggregate(turns[:depth], 'string_agg', '')) AS key, md5(list_aggregate(turns[:depth - 1], 'string_agg', '')) AS parent_key,
  CASE WHEN depth = 0 THEN 0 ELSE lens[depth] END AS size, len(turns) = depth AS ends FROM steps),
nodes AS (
 SELECT coalesce(key, '') AS key, depth, any_value(CASE WHEN depth = 1 THEN '' WHEN depth > 1 THEN parent_key END) AS parent_key, min(conv_id) AS conv_id,
  count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended
 FROM prefixes GROUP BY ALL),
kids AS (SELECT parent_key AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (key, depth)),
above AS (
 SELECT coalesce(p.key, '') AS key, p.depth, f.key AS below, any_value(f.saved) AS saved, any_value(f.n_children) AS n_children
 FROM full_nodes f JOIN prefixes q ON q.conv_id = f.conv_id AND q.depth = f.depth
 JOIN prefixes p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL),
sums AS (SELECT key, depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ended) AS ends_sha256
FROM full_nodes f JOIN sums s USING (key, depth) LEFT JOIN full_nodes p ON p.key = f.parent_key AND p.depth = f.depth - 1""",
    "op13_collocations": """
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
 FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
 SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase
 FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= 100),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
cands AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
kept AS (
 SELECT c.* FROM cands c WHERE NOT EXISTS (
  SELECT 1 FROM cands d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
 SELECT lang, phrase, a, c, list_aggregate(w[:c], 'string_agg', ' ') AS lp, list_aggregate(w[c + 1:], 'string_agg', ' ') AS rp
 FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
 SELECT t.lang, t.phrase, t.a, l.f AS l, r.f AS r, n, c, ((1000::HUGEINT * t.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
 FROM cuts t JOIN counts l ON l.lang = t.lang AND l.phrase = t.lp JOIN counts r ON r.lang = t.lang AND r.phrase = t.rp JOIN totals s ON s.lang = t.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000""",
}
