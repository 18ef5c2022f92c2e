"""The queries of this subpackage: opN_<name>(spark, sf_dir) over the whole of their tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, erasure, exact_dedup, language_id, lexical, lm_scoring, media, mixing, ngram_jaccard, piece_lattice, token_counts, token_output, url_filters
from .common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "copy", "copies", "shuffle_key", "text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the N-best encoding: the ids' number and SHA-256, the best score, the losses and changes of the next
    best, and whether decoding restored the text."""
    rows = piece_lattice.encode_documents(_table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_pieces", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), "score", "nbest_losses", F.to_json("nbest_changes").alias("nbest_changes"), "restored")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after two commits: all documents are inserted with provisional counts (a token per four bytes), and then
    revised to the exact ones under each tokenizer, in a batch that is replayed once."""
    counted = materialize(token_counts.count_tokens(_table(spark, sf_dir, "documents"), ["source", "lang"]), "token-counts")
    guess = F.transform("counts", lambda c: F.struct(c["tokenizer"].alias("tokenizer"), F.ceil(F.col("n_bytes") / 4).alias("tokens")))
    provisional = counted.withColumn("counts", guess)
    rollup = token_counts.TokenRollup(spark)
    rollup.commit("insert", token_counts.changes(provisional))
    for _ in range(2):
        rollup.commit("revise", token_counts.revisions(provisional, counted))
    return rollup.totals()


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_training_order(_table(spark, sf_dir, "documents"))[0]


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, *lm_scoring.train(docs), keep=["doc_id"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, keep=["doc_id", "held_out"])


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    return url_filters.judge(_table(spark, sf_dir, "pages"), rules, ["page_id"])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf_dir, "documents")).drop("raw")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_columns(_table(spark, sf_dir, "documents"), ["doc_id"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.erase(erasure.shop_sources(*[_table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")]))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows are written, and the digests are of what is read back from them."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(rows.unionByName(planted))
    return chat.digests(materialize(windows, "chat-windows"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Poisson inversion by a recursive table of each source's distribution; the same hash and the same order of operations.
_MIX_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
total AS (SELECT sum(w) AS sum_w, CAST(sum(n) AS DOUBLE) AS sum_n FROM counts),
rates AS (SELECT source, sum_n * w / sum_w / n AS rate FROM counts, total),
parts AS (SELECT source, greatest(1, CAST(ceil(rate / 500.0::DOUBLE) AS INT)) AS parts, rate / greatest(1, CAST(ceil(rate / 500.0::DOUBLE) AS INT)) AS mean FROM rates),
cdf(source, mean, parts, k, p, s) AS (
  SELECT source, mean, parts, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL
  SELECT source, mean, parts, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) FROM cdf
  WHERE k < CAST(ceil(mean + 12.0::DOUBLE * sqrt(mean) + 40.0::DOUBLE) AS INT)),
dist AS (SELECT source, parts, list(s ORDER BY k) AS c FROM cdf GROUP BY source, parts),
drawn AS (
  SELECT doc_id, d.source, text, CAST(list_sum(list_transform(range(1, parts + 1), lambda j:
    len(list_filter(c, lambda x: x <= CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(j AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)))) AS INT) AS copies
  FROM documents d JOIN dist ON d.source IS NOT DISTINCT FROM dist.source)
SELECT doc_id, source, copy, copies, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || '#' || CAST(copy AS VARCHAR)) AS shuffle_key, text
FROM (SELECT doc_id, source, text, copies, CAST(unnest(range(1, copies + 1)) AS INT) AS copy FROM drawn WHERE copies > 0)
"""

_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


_URL_SQL = r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hits ON u.page_id = hits.page_id
"""


_LEXICAL_SQL = r"""
WITH q AS (SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
d AS (SELECT r, doc_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
sizes AS (SELECT r, count(*) AS n FROM d GROUP BY r),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (r), whole GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""


#: A turn's cost, its start by a running sum, the grid, and the length of each window's members.
_CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS ord, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
c AS (SELECT *, 4 + (strlen(text) + 3) // 4 AS cost,
    14 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY ord, role <> 'system', role, text) AS k FROM r),
s AS (SELECT conv_id, cost AS held, chars AS system_chars FROM c WHERE k = 1 AND role = 'system' AND cost <= 512),
p AS (SELECT c.*, coalesce(held, 0) AS held, k = 1 AND held IS NOT NULL AS system,
    CAST(sum(cost) OVER (PARTITION BY c.conv_id ORDER BY k) AS BIGINT) - cost AS begun FROM c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (SELECT *, 768 - held AS room, CASE WHEN system THEN 0 ELSE begun - held END AS start, CASE WHEN system THEN 0 ELSE begun - held + cost END AS stop FROM p),
g AS (SELECT *, 2 * (start // room) + CASE WHEN system OR (stop - 1) // room = start // room THEN 0 ELSE 1 END AS code FROM q),
w AS (SELECT conv_id, code, min(start) AS first, bool_or(system) AS own FROM g GROUP BY conv_id, code),
extra AS (
  SELECT w.conv_id, sum(g.chars) AS chars FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND NOT g.system AND g.code < w.code AND g.start >= w.first - 256
  GROUP BY w.conv_id
  UNION ALL
  SELECT w.conv_id, sum(system_chars) FROM w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id WHERE NOT own GROUP BY w.conv_id),
e AS (SELECT conv_id, sum(chars) AS chars FROM extra GROUP BY conv_id),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM c GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(t.chars + coalesce(e.chars, 0) AS BIGINT) AS formatted_chars
FROM t LEFT JOIN e ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_chat_format": _CHAT_SQL, "op11_lexical_search": _LEXICAL_SQL, "op8_url_filters": _URL_SQL, "op1_source_mixing": _MIX_SQL, "op9_exact_dedup": _DEDUP_SQL}
