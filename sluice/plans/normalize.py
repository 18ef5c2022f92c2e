"""Normalization, text, JSON and entity queries on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import relational as R
from ..operators.facts import agent_of, dim_join
from ..sources.tables import read_table


def coerce_types(spark, d):
    raw = F.concat(F.when(F.col("event_id") % 5 == 0, " ").otherwise(""), F.when(F.col("event_id") % 7 == 0, "NaN").when(F.col("event_id") % 7 == 1, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).when(F.col("event_id") % 7 == 2, "yes").when(F.col("event_id") % 7 == 3, "").when(F.col("event_id") % 7 == 4, "3.9").otherwise("-3.9"))
    e = read_table(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", S.coerce_str("raw").alias("s"), S.coerce_int("raw").alias("i"), S.coerce_float("raw").alias("f"), S.coerce_bool("raw").alias("b"))


def status_bucket(spark, d):
    raw = F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 6 == 1, "Success").when(F.col("doc_id") % 6 == 2, "tool_error").when(F.col("doc_id") % 6 == 3, "unsupported_language").when(F.col("doc_id") % 6 == 4, "skipped")
    docs = read_table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return docs.select("doc_id", S.refactoring_status("raw").alias("refactoring"), S.maintainability_status("raw", F.when(F.col("doc_id") % 4 == 0, "failed")).alias("maintainability"))


def json_props(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), S.json_counts("props").alias("m"))
    return e.select("event_id", "k", F.size("m").alias("entries"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def map_positive(spark, d):
    n = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg((F.count(F.lit(1)) - 1).alias("n"))
    m = n.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    return m.select("l_orderkey", S.sorted_json(S.positive_counts("m")).alias("counts"))


def repo_key_from_url(spark, d):
    return read_table(spark, d, "pages").select("page_id", S.repo_key_from_url("url").alias("repo"))


def stable_keys(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("00"), F.col("o_custkey").cast("string"), F.lit(".0"))).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("R_"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string")).alias("repo"))
    return o.select("o_orderkey", S.stable_pr_key("repo", "o_orderkey").alias("key"), S.repository_key(F.concat(F.lit(" Owner / "), "repo")).alias("name"), S.repository_identity("repo", F.concat(F.lit("Owner/"), "repo")).alias("identity"))


def entity_ids(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", S.entity_id(F.lit("pr"), "o_orderkey", "o_custkey").alias("pk"), S.entity_id(F.lit("repo"), "o_custkey").alias("fk"))


def unpivot_roles(spark, d):
    """A base and a head row for each order; one row where both are the same."""
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("base"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("head"))
    roles = F.when(F.col("base") == F.col("head"), F.array(F.struct(F.lit("BASE_AND_HEAD").alias("role"), F.col("base").alias("repo")))).otherwise(F.array(F.struct(F.lit("BASE").alias("role"), F.col("base").alias("repo")), F.struct(F.lit("HEAD").alias("role"), F.col("head").alias("repo"))))
    return o.select("o_orderkey", F.explode(roles).alias("r")).select("o_orderkey", "r.role", "r.repo", F.concat_ws("::", F.col("o_orderkey").cast("string"), F.lit("repository_snapshot"), F.col("r.repo").cast("string"), F.col("r.role")).alias("key"))


def file_records(spark, d):
    """Lines as child rows with a positional key."""
    docs = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.select("doc_id", F.format_string("%d::file::%06d", F.col("doc_id"), F.col("pos")).alias("key"), F.length("line").alias("size"))


def referential_children(spark, d):
    """Child rows whose parent was kept, with its key."""
    kept = read_table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), S.entity_id(F.lit("pr"), "o_orderkey").alias("pr_id"))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(kept, "l_orderkey")


def label_encode(spark, d):
    labels = read_table(spark, d, "labels").select("doc_id", F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")).alias("l"))
    hot = S.multi_hot(["good", "toxic", "none"], F.array_compact("l"))
    return labels.select("doc_id", *[hot[i].alias(f"c{i}") for i in range(3)])


def char_ratio(spark, d):
    s = T.letter_stats("text")
    return read_table(spark, d, "documents").select("doc_id", s["letters"].alias("letters"), s["other"].alias("other"), s["ratio"].alias("ratio"), (s["ratio"] > 0.5).alias("rejected"))


def token_counts(spark, d):
    t = read_table(spark, d, "documents").select(F.explode(T.letter_tokens("text")).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocab_filter(spark, d):
    return token_counts(spark, d).where("n >= 20")


def strip_concepts(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", T.strip_concepts("text").alias("clean"))


def identifier_split(spark, d):
    return read_table(spark, d, "supplier").select("s_suppkey", F.concat_ws(" ", T.split_identifier(F.concat(F.lit("parseHTTPResponse2xx_"), "s_name"))).alias("words"))


def infer_language(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ["py", "H", "cjs", "tar.gz", "ipynb", "TSX", "", "m"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    path = F.concat(F.lit("src/a.b/f"), F.col("p_partkey").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return read_table(spark, d, "part").select("p_partkey", T.infer_language(path).alias("language"))


def canonical_label(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" & "), "p_brand").alias("raw"))
    return p.select("p_partkey", T.lookup_key("raw").alias("key"), T.smell_lookup_key(F.concat(F.lit("a.b:"), "raw")).alias("smell"))


#: -1 drops a topic, -2 keeps it, a list replaces it.
_RULES = [("small", -1, []), ("ring", -2, []), ("cog", 0, ["gear", "wheel"]), ("bolt", 0, ["screw"])]


def topic_rules(spark, d):
    rules = spark.createDataFrame(_RULES, "topic string, action int, to array<string>")
    t = read_table(spark, d, "part").select("p_partkey", F.explode(T.split_topics("p_name")).alias("topic"))
    out = F.when(F.col("action") == -1, F.array().cast("array<string>")).when(F.col("action") == 0, F.col("to")).otherwise(F.array("topic"))
    return dim_join(t, rules, "topic").select("p_partkey", F.explode(out).alias("topic")).distinct()


def rule_classifier(spark, d):
    c = read_table(spark, d, "conversations")
    branch = F.when(F.col("conv_id") % 7 == 0, "codex/fix").when(F.col("conv_id") % 7 == 1, "openhands-x").otherwise("main")
    author = F.when(F.col("conv_id") % 11 == 0, "claude[bot]").when(F.col("conv_id") % 11 == 1, "dependabot[bot]").otherwise("someone")
    c = c.select("conv_id", "turn", author.alias("author"), branch.alias("branch"), F.when(F.col("turn") == 0, F.lit("x About Codegen y")).otherwise(F.lit("")).alias("body"))
    return c.select("conv_id", "turn", agent_of("author", "branch", F.array("body")).alias("agent"), (agent_of("author", "branch", F.array("body")).isNotNull() | F.col("author").endswith("[bot]")).alias("agentic"))


def ordered_paths(spark, d):
    """Rank of paths by depth, then without regard to case, then as they are."""
    from pyspark.sql import Window as W

    p = read_table(spark, d, "part").select("p_brand", F.concat(F.when(F.col("p_size") % 2 == 0, "B/").otherwise("a/"), F.when(F.col("p_size") % 3 == 0, "x/").otherwise(""), F.col("p_partkey").cast("string")).alias("path"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy("p_brand").orderBy(*T.path_order("path"))))


def history_exclusion(spark, d):
    """New rows whose id or url is not in the history."""
    o = read_table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"))
    history = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, F.col("url")).alias("url"))
    return R.read_once(o, history, ["o_orderkey", "url"]).select("url").distinct()


_AGENT = """CASE WHEN author = 'claude[bot]' THEN 'claude' WHEN branch LIKE 'codex/%' THEN 'codex' WHEN body LIKE '%about codegen%' THEN 'codegen' WHEN branch LIKE 'openhands%' THEN 'openhands' END"""
_PATH = "'src/a.b/f' || p_partkey || CASE WHEN x = '' THEN '' ELSE '.' || x END"
QUERIES = {
    "coerce_types": (coerce_types, """WITH r AS (SELECT event_id, trim(CASE event_id % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN event_id || '.0' WHEN 2 THEN 'yes' WHEN 3 THEN '' WHEN 4 THEN '3.9' ELSE '-3.9' END) AS t FROM events)
        SELECT event_id, CASE WHEN lower(t) NOT IN ('', 'none', 'null', 'nan') THEN regexp_replace(t, '^([0-9]+)\\.0$', '\\1') END AS s, CAST(trunc(CASE WHEN lower(t) <> 'nan' THEN TRY_CAST(t AS DOUBLE) END) AS BIGINT) AS i, CASE WHEN lower(t) <> 'nan' THEN TRY_CAST(t AS DOUBLE) END AS f,
        CASE WHEN t IN ('1', 'yes') THEN true WHEN t IN ('0') THEN false END AS b FROM r"""),
    "status_bucket": (status_bucket, """WITH r AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 4 = 0 AS bad FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'success' WHEN 2 THEN 'failed' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'other' ELSE 'missing' END AS refactoring,
        CASE WHEN k IN (0, 5) THEN 'missing' WHEN k = 3 THEN 'unsupported' WHEN k = 2 OR bad THEN 'failed' WHEN k = 1 THEN 'success' ELSE 'other' END AS maintainability FROM r"""),
    "json_props": (json_props, """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k, CASE WHEN k > 0 THEN 1 ELSE 0 END AS entries, CASE WHEN k > 0 THEN k ELSE 0 END AS total FROM k"""),
    "map_positive": (map_positive, """WITH n AS (SELECT l_orderkey, l_returnflag, count(*) - 1 AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, '{' || coalesce(string_agg('"' || l_returnflag || '":' || n, ',' ORDER BY l_returnflag) FILTER (n > 0), '') || '}' AS counts FROM n GROUP BY l_orderkey"""),
    "repo_key_from_url": (repo_key_from_url, "SELECT page_id, CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)/([^/?#]+)') THEN lower(regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)/([^/?#]+)', 1) || '/' || regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)/([^/?#]+)', 2)) END AS repo FROM pages"),
    "stable_keys": (stable_keys, """WITH r AS (SELECT o_orderkey, o_custkey, CASE o_custkey % 3 WHEN 0 THEN '00' || o_custkey || '.0' WHEN 1 THEN 'R_' || o_custkey ELSE '' || o_custkey END AS repo FROM orders)
        SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 1 THEN o_custkey || '#' || o_orderkey END AS key, 'owner/' || lower(repo) AS name, CASE WHEN o_custkey % 3 <> 1 THEN 'repository-id:' || o_custkey ELSE 'repository-key:owner/' || lower(repo) END AS identity FROM r"""),
    "entity_ids": (entity_ids, "SELECT o_orderkey, substr(sha256('pr' || chr(0) || o_orderkey || chr(0) || o_custkey), 1, 32) AS pk, substr(sha256('repo' || chr(0) || o_custkey), 1, 32) AS fk FROM orders"),
    "unpivot_roles": (unpivot_roles, """WITH o AS (SELECT o_orderkey, o_custkey AS base, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS head FROM orders), r AS (SELECT o_orderkey, CASE WHEN base = head THEN 'BASE_AND_HEAD' ELSE 'BASE' END AS role, base AS repo FROM o UNION ALL SELECT o_orderkey, 'HEAD', head FROM o WHERE base <> head)
        SELECT *, o_orderkey || '::repository_snapshot::' || repo || '::' || role AS key FROM r"""),
    "file_records": (file_records, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, printf('%d::file::%06d', doc_id, pos) AS key, CAST(length(line) AS INT) AS size FROM l"),
    "referential_children": (referential_children, "SELECT l_orderkey, l_linenumber, substr(sha256('pr' || chr(0) || o_orderkey), 1, 32) AS pr_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'"),
    "label_encode": (label_encode, "SELECT doc_id, CAST(quality = 1 AS INT) AS c0, CAST(toxic = 1 AS INT) AS c1, 0 AS c2 FROM labels"),
    "char_ratio": (char_ratio, r"""WITH s AS (SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS INT) AS letters, CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) - length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS INT) AS other FROM documents)
        SELECT *, CASE WHEN letters > 0 THEN other / letters ELSE 0.0::DOUBLE END AS ratio, CASE WHEN letters > 0 THEN other / letters ELSE 0 END > 0.5 AS rejected FROM s"""),
    "token_counts": (token_counts, "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token"),
    "vocab_filter": (vocab_filter, "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token HAVING count(*) >= 20"),
    "strip_concepts": (strip_concepts, r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', ' ', 'g'), '`[^`]*`', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'),
        'https?://\S+|www\.\S+', ' ', 'g'), '\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+\b', ' ', 'g'), '(^|[^A-Za-z0-9_])@[A-Za-z0-9_-]+', '\1 ', 'g') AS clean FROM conversations"""),
    "identifier_split": (identifier_split, "SELECT s_suppkey, 'parse HTTP Response 2 xx ' || trim(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')) AS words FROM supplier"),
    "infer_language": (infer_language, f"WITH p AS (SELECT p_partkey, p_partkey % 8 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'Python' WHEN 1 THEN 'C' WHEN 4 THEN 'Jupyter Notebook' WHEN 5 THEN 'TypeScript' WHEN 7 THEN 'Objective-C' END AS language FROM p"),
    "canonical_label": (canonical_label, """WITH p AS (SELECT p_partkey, lower(p_type || ' & ' || p_brand) AS r FROM part) SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(r, '&', ' and '), '[_/-]+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g')) AS key,
        trim(regexp_replace(regexp_replace(regexp_replace('a.b:' || r, '[_./:-]+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g')) AS smell FROM p"""),
    "topic_rules": (topic_rules, """WITH t AS (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '[,;\\s]+')) AS topic FROM part), r(topic, action, t2) AS (VALUES ('small', -1, NULL), ('ring', -2, NULL), ('cog', 0, 'gear'), ('cog', 0, 'wheel'), ('bolt', 0, 'screw'))
        SELECT DISTINCT p_partkey, coalesce(t2, t.topic) AS topic FROM t LEFT JOIN r ON t.topic = r.topic WHERE coalesce(action, 0) <> -1 AND t.topic NOT IN ('', 'none', 'nan', 'null')"""),
    "rule_classifier": (rule_classifier, f"""WITH c AS (SELECT conv_id, turn, CASE conv_id % 11 WHEN 0 THEN 'claude[bot]' WHEN 1 THEN 'dependabot[bot]' ELSE 'someone' END AS author, CASE conv_id % 7 WHEN 0 THEN 'codex/fix' WHEN 1 THEN 'openhands-x' ELSE 'main' END AS branch, CASE WHEN turn = 0 THEN 'x about codegen y' ELSE '' END AS body FROM conversations),
        a AS (SELECT *, CASE WHEN branch LIKE 'codex/%' THEN 'codex' WHEN author = 'claude[bot]' THEN 'claude' WHEN body LIKE '%about codegen%' THEN 'codegen' WHEN branch LIKE 'openhands%' THEN 'openhands' END AS agent FROM c) SELECT conv_id, turn, agent, agent IS NOT NULL OR author LIKE '%[bot]' AS agentic FROM a"""),
    "ordered_paths": (ordered_paths, """WITH p AS (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'B/' ELSE 'a/' END || CASE WHEN p_size % 3 = 0 THEN 'x/' ELSE '' END || p_partkey AS path FROM part) SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY len(string_split(path, '/')), lower(path), path) AS INT) AS rank FROM p"""),
    "history_exclusion": (history_exclusion, "WITH o AS (SELECT o_orderkey, 'u' || o_custkey AS url FROM orders) SELECT DISTINCT url FROM o WHERE o_orderkey % 10 <> 0 AND url NOT IN (SELECT url FROM o WHERE o_orderkey % 20 = 0)"),
}
