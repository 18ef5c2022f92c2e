"""Record, curation and evaluation queries on stand-ins: customers as repositories, orders as pull requests, lines as operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as N
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import curation as C
from ..operators import learning as L
from ..operators import taxonomy as X
from ..operators import training as G
from ..sources.tables import read_table


def record_repositories(spark, d):
    """Keys and ids of repositories from records in four shapes, by the market segment."""
    c = read_table(spark, d, "customer")
    n, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    name = F.concat(F.lit("Org/Repo"), n)
    by_owner = F.to_json(F.struct(F.struct(F.lit("Org").alias("login")).alias("owner"), F.concat(F.lit("Repo"), n).alias("name"), n.alias("id")))
    by_url = F.to_json(F.struct(F.concat(F.lit("https://host.example/Org/Repo"), n).alias("url"), F.concat(F.lit("00"), n, F.lit(".0")).alias("database_id")))
    inner = F.to_json(F.struct(name.alias("repo_full_name"), n.alias("repository_id")))
    record = (
        F.when(seg == "BUILDING", F.to_json(F.struct(name.alias("repo_full_name"), n.alias("base_repository_id"))))
        .when(seg == "MACHINERY", F.to_json(F.struct(by_owner.alias("repository_metadata"))))
        .when(seg == "AUTOMOBILE", F.concat(F.lit('{"base_repository":'), by_url, F.lit("}")))
        .when(seg == "HOUSEHOLD", F.concat(F.lit('{"original_pr_payload":'), inner, F.lit("}")))
        .otherwise("[1]")
    )
    return c.select("c_custkey", N.record_repository_key(record).alias("repository_key"), N.record_repository_id(record).alias("repository_id"))


def snapshot_labels(spark, d):
    e = read_table(spark, d, "events")
    label = F.when(F.col("event_type") == "click", "After").when(F.col("event_type") == "view", "+7d").otherwise(F.lit(None).cast("string"))
    kind = F.when(F.col("value") < 2, "BEFORE").otherwise("future")
    return e.select("event_id", N.snapshot_label(label, kind, F.floor("value"), C.LABELS).alias("label"))


def tool_gates(spark, d):
    """Orders that are to be replaced, by the statuses of their lines."""
    li = read_table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("snapshot_label"), F.col("l_returnflag").alias("tool")).agg(F.max(F.when(F.col("l_quantity") > 45, "Failed").when(F.col("l_quantity") > 40, "missing_snapshot").otherwise("success")).alias("status"))
    s = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("snapshot_label", "tool", "status"))).alias("s"))
    o = read_table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.array_join(N.gate_reasons(F.col("o_totalprice") > 1000, F.col("s").isNotNull(), F.when(F.col("o_orderstatus") == "F", "crashed").otherwise("completed"), "s"), " ").alias("reasons"), N.snapshots_status(F.transform("s", lambda x: x["status"])).alias("status"))


def refactoring_values(spark, d):
    """Lines of an order as operations: the flag is the type, the part the file, the quantity the span."""
    at = lambda k: F.array(F.struct(F.concat(F.lit("f"), (F.col("l_partkey") % k).cast("string")).alias("file_path"), (F.col("l_suppkey") % 50).alias("start_line"), (F.col("l_suppkey") % 50 + F.col("l_linenumber")).alias("end_line")))
    li = read_table(spark, d, "lineitem").select("l_orderkey", F.struct(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("standardized_type"), F.col("l_linestatus").alias("level"), at(7).alias("source_locations"), at(5).alias("target_locations")).alias("o"))
    return C.refactoring_values(li.groupBy("l_orderkey").agg(F.collect_list("o").alias("ops")), "l_orderkey", "ops").drop("type_counts", "level_counts")


def longitudinal_results(spark, d):
    """The last event of each user and type as a snapshot, the user's last event as summary, the events as operations."""
    e = read_table(spark, d, "events").select(F.lit("c").alias("cohort"), F.lit("m").alias("input_mode"), F.col("user_id").cast("string").alias("pull_request_key"), F.col("event_type").alias("snapshot_label"), F.col("event_id").alias("line_number"), "value")
    out = C.longitudinal_results(e, e.drop("snapshot_label"), e.withColumnRenamed("value", "weight"))
    return out.select("pull_request_key", "snapshot_label", "value", F.col("pr_summary.value").alias("summary"), "operation_count", F.col("operations")[0]["weight"].alias("first_weight"))


def consumed_snapshots(spark, d):
    """Events as snapshot rows: matched to users by url where there is one, else by number; the first of a label counts."""
    e = read_table(spark, d, "events")
    u = F.col("user_id").cast("string")
    rows = e.select("event_id", F.when(F.col("value") < 90, "Success").otherwise("failed").alias("status"), F.lit("c").alias("cohort"), F.when(F.col("event_type") == "click", F.concat(F.lit("u"), u)).alias("pr_url"), F.lit("o/r").alias("repository_key"), F.when(F.col("event_type") != "view", F.col("user_id")).alias("pr_number"), F.when(F.col("value") < 10, "before").when(F.col("value") < 20, "after").alias("snapshot_label"), F.lit(None).cast("string").alias("snapshot_kind"), F.lit(None).cast("string").alias("days_after_merge"), "value")
    ids = e.select(F.col("user_id").alias("pr"), F.lit("c").alias("cohort"), F.concat(F.lit("u"), u).alias("pr_url"), F.lit("o/r").alias("repository_key"), F.col("user_id").alias("pr_number")).distinct()
    return C.consume_snapshots(rows, ids, ["event_id", "value"], ["event_id"])[0]


def collected_repositories(spark, d):
    """The first repositories (customers) by the first order that found them, with all orders' priorities and days."""
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderdate").cast("date").alias("bucket"), F.col("o_orderpriority").alias("query"), F.lit(1).alias("page"), F.col("o_orderkey").alias("metadata"))
    return G.collect_repositories(o, "repo", 100).select("repo", F.size("searches").alias("searches"), F.col("searches")[0]["bucket"].alias("first_day"))


def eligibility(spark, d):
    docs = read_table(spark, d, "documents").select(F.when(F.col("lang").isNotNull(), F.concat(F.lit("repository-id:"), F.col("doc_id").cast("string"))).alias("identity_key"), F.col("text").alias("prepared_text"), F.array(F.when(F.col("source").isNotNull(), F.lit(1)).otherwise(0)).alias("labels"))
    meta = read_table(spark, d, "labels").select(F.concat(F.lit("repository-id:"), F.col("doc_id").cast("string")).alias("identity_key"), (F.col("quality") * 30).cast("string").alias("stars"), F.when(F.col("toxic") == 0, "2024-05-06T00:00:00Z").otherwise("never").alias("created_at"))
    return G.eligibility_counts(G.eligible_records(docs, meta))


def capped_limits(spark, d):
    return A.capped_limits(read_table(spark, d, "lineitem").select((F.col("l_extendedprice") - 30000).alias("v")), "v")


def labels_by_share(spark, d):
    n = A.label_share(read_table(spark, d, "orders").select("o_orderpriority", "o_orderstatus"), ["o_orderpriority"], "o_orderstatus", 100.0)
    return A.labels_by_share(n, "o_orderpriority", "o_orderstatus", "share", ["F", "O", "P", "X"])


_TOPICS = 5


def _scored(spark, d):
    e = read_table(spark, d, "embeddings")
    pairs = lambda at: F.explode(F.array(*[F.struct(F.lit(f"t{i}").alias("topic"), F.col("embedding")[at + i].cast("double").alias("score")) for i in range(_TOPICS)]))
    of = lambda at: e.select("vec_id", pairs(at).alias("p")).select("vec_id", "p.topic", "p.score")
    return of(0), of(_TOPICS).where("score > 0.05").select("vec_id", "topic")


def threshold_metrics(spark, d):
    scored, truth = _scored(spark, d)
    return L.threshold_metrics(scored, truth, "vec_id", 0.0)


def word_lemmas(spark, d):
    """Words of all documents with their lemma; the vocabulary is the words themselves."""
    words = read_table(spark, d, "documents").select(F.explode(T.letter_tokens("text")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return X.lemmas(words, "w", words.select(F.col("w").alias("lemma")))


def cohort_order(spark, d):
    o = read_table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderpriority").startswith("1"), "Humans").when(F.col("o_orderpriority").startswith("2"), "Agents").when(F.col("o_orderpriority").startswith("3"), "cursor").otherwise(F.col("o_orderpriority")).alias("cohort"))
    return o.groupBy("cohort").agg(F.count(F.lit(1)).alias("n")).select("cohort", "n", N.cohort_order("cohort")["rank"].alias("rank"))


def language_spellings(spark, d):
    c = read_table(spark, d, "customer")
    given = F.array(F.col("c_mktsegment"), F.lower("c_mktsegment"), F.lit(" "), F.initcap(F.col("c_name")), F.upper("c_mktsegment"))
    return c.select("c_custkey", F.array_join(N.distinct_spellings(given), "|").alias("languages"), F.array_join(N.record_ids("c_name", "c_nationkey", F.col("c_custkey").cast("string")), "|").alias("ids"))


#: All decisions of the threshold metrics in SQL.
_DECISIONS = f"""s AS (SELECT vec_id, unnest(range({_TOPICS})) AS i, embedding FROM embeddings),
 t AS (SELECT vec_id, i, CASE WHEN CAST(embedding[i + 1] AS DOUBLE) > 0 THEN 1.0::DOUBLE ELSE 0 END AS p, CASE WHEN CAST(embedding[i + {_TOPICS} + 1] AS DOUBLE) > 0.05 THEN 1.0::DOUBLE ELSE 0 END AS y FROM s),
 k AS (SELECT vec_id, sum(p * y) AS tp, sum(p) AS pp, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY vec_id), l AS (SELECT i, sum(p * y) AS tp, sum(p) AS pp, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY i),
 a AS (SELECT sum(tp) AS tp, sum(pp) AS pp, sum(pos) AS pos, sum(n) AS n FROM l)"""
_F1, _P, _R = "coalesce(2 * tp / nullif(pp + pos, 0), 0)", "coalesce(tp / nullif(pp, 0), 0)", "coalesce(tp / nullif(pos, 0), 0)"
_AUC = "CASE WHEN pos > 0 AND pos < n THEN (1 + tp / pos - (pp - tp) / (n - pos)) / 2 END"
_AP = f"CASE WHEN pos > 0 THEN {_R} * {_P} + (1 - {_R}) * pos / n ELSE 0 END"
_EACH = ", ".join(f"(SELECT avg({x}) FROM l) AS {n}_macro, (SELECT sum(({x}) * pos) / sum(pos) FROM l) AS {n}_weighted, (SELECT avg({x}) FROM k) AS {n}_samples" for n, x in (("precision", _P), ("recall", _R), ("f1", _F1)))

_SEG = "c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')"

QUERIES = {
    "record_repositories": (record_repositories, f"SELECT c_custkey, CASE WHEN {_SEG} THEN 'org/repo' || c_custkey END AS repository_key, CASE WHEN {_SEG} THEN CAST(c_custkey AS VARCHAR) END AS repository_id FROM customer"),
    "snapshot_labels": (snapshot_labels, "SELECT event_id, CASE WHEN event_type = 'click' THEN 'after' WHEN value < 2 THEN 'before' WHEN event_type = 'view' THEN '+7d' WHEN floor(value) IN (3, 7, 31, 61) THEN '+' || CAST(floor(value) AS BIGINT) || 'd' END AS label FROM events"),
    "tool_gates": (tool_gates, """WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS label, l_returnflag AS tool, max(CASE WHEN l_quantity > 45 THEN 'Failed' WHEN l_quantity > 40 THEN 'missing_snapshot' ELSE 'success' END) AS status FROM lineitem GROUP BY ALL),
        g AS (SELECT l_orderkey, string_agg('refactoring_snapshot:' || label || ':' || tool || ':failed', ' ' ORDER BY label, tool) FILTER (status = 'Failed') AS bad, count(*) FILTER (status = 'success') AS good, count(*) FILTER (status = 'Failed') AS failed, count(*) AS n FROM l GROUP BY l_orderkey)
        SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 'missing_metrics' WHEN n IS NULL THEN 'missing_refactoring' ELSE concat_ws(' ', CASE WHEN o_orderstatus = 'F' THEN 'refactoring_stage:crashed' END, bad) END AS reasons,
        CASE WHEN n IS NULL THEN 'missing_snapshot' WHEN good = n THEN 'success' WHEN failed = 0 THEN 'partial_success' WHEN good > 0 THEN 'partial_failure' ELSE 'failed' END AS status FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"""),
    "refactoring_values": (refactoring_values, """WITH x AS (SELECT l_orderkey, coalesce(nullif(l_returnflag, 'N'), 'unclassified') AS t, 'f' || (l_partkey % 7) AS src, 'f' || (l_partkey % 5) AS dst, l_suppkey % 50 AS s, l_suppkey % 50 + l_linenumber AS e FROM lineitem),
        c AS (SELECT l_orderkey, t, count(*) AS n FROM x GROUP BY ALL), h AS (SELECT l_orderkey, sum(n) AS n, -sum(n / tot * log2(n / tot)) AS diversity FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS tot FROM c) GROUP BY l_orderkey),
        a AS (SELECT l_orderkey, count(*) AS k FROM (SELECT DISTINCT l_orderkey, dst, unnest(range(s, e + 1)) AS line FROM x) GROUP BY ALL), r AS (SELECT l_orderkey, count(*) AS k FROM (SELECT DISTINCT l_orderkey, src, unnest(range(s, e + 1)) AS line FROM x) GROUP BY ALL),
        f AS (SELECT l_orderkey, count(DISTINCT p) AS k FROM (SELECT l_orderkey, src AS p FROM x UNION ALL SELECT l_orderkey, dst FROM x) GROUP BY ALL)
        SELECT l_orderkey, CAST(h.n AS INT) AS refactor_count, abs(diversity) AS diversity, a.k AS added_lines, r.k AS removed_lines, a.k + r.k AS magnitude_lines, CAST(f.k AS INT) AS magnitude_files, CAST(h.n AS DOUBLE) / ((a.k + r.k) / 1000.0::DOUBLE) AS density FROM h JOIN a USING (l_orderkey) JOIN r USING (l_orderkey) JOIN f USING (l_orderkey)"""),
    "longitudinal_results": (longitudinal_results, """WITH g AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, count(*) AS n, arg_min(value, event_id) AS first_weight FROM events GROUP BY ALL), u AS (SELECT user_id, arg_max(value, event_id) AS summary FROM events GROUP BY ALL)
        SELECT CAST(user_id AS VARCHAR) AS pull_request_key, event_type AS snapshot_label, value, summary, CAST(n AS INT) AS operation_count, first_weight FROM g JOIN u USING (user_id)"""),
    "consumed_snapshots": (consumed_snapshots, """WITH r AS (SELECT user_id AS pr, CASE WHEN value < 10 THEN 'before' ELSE 'after' END AS label, event_id, value FROM events WHERE value < 20 AND event_type <> 'view')
        SELECT pr, label, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM r GROUP BY ALL"""),
    "collected_repositories": (collected_repositories, """WITH s AS (SELECT DISTINCT o_custkey AS repo, CAST(o_orderdate AS DATE) AS b, o_orderpriority AS q FROM orders), g AS (SELECT repo, count(*) AS searches, min({'b': b, 'q': q}) AS first FROM s GROUP BY repo)
        SELECT repo, CAST(searches AS INT) AS searches, first.b AS first_day FROM g ORDER BY first, repo LIMIT 100"""),
    "eligibility": (eligibility, r"""WITH j AS (SELECT d.*, l.doc_id IS NOT NULL AS hit, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
        r AS (SELECT CASE WHEN lang IS NULL THEN 'missing_identity' WHEN trim(coalesce(text, '')) = '' THEN 'empty_prepared_text' WHEN source IS NULL THEN 'empty_label_vector_after_topic_filter' WHEN NOT hit THEN 'missing_metadata' WHEN toxic <> 0 THEN 'invalid_repository_created_at' END AS reason, CASE WHEN quality = 0 THEN '0' ELSE '19+' END || '|2024-Q2' AS stratum FROM j)
        SELECT CASE WHEN reason IS NULL THEN 'stratum' ELSE 'excluded' END AS kind, CASE WHEN reason IS NULL THEN stratum ELSE reason END AS label, count(*) AS n FROM r GROUP BY ALL"""),
    "capped_limits": (capped_limits, """WITH x AS (SELECT l_extendedprice - 30000 AS v FROM lineitem), q AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM x), z AS (SELECT a - (b - a) * 0.06::DOUBLE AS lower, b + (b - a) * 0.06::DOUBLE AS upper FROM q)
        SELECT lower, upper, count(*) FILTER (v < lower) AS below_count, count(*) FILTER (v > upper) AS above_count, count(*) AS total_count, count(*) FILTER (v < lower OR v > upper) > 0 AS is_clipped FROM x, z GROUP BY lower, upper"""),
    "labels_by_share": (labels_by_share, """WITH n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) * 100.0::DOUBLE AS share FROM n), k AS (SELECT count(DISTINCT o_orderpriority) AS g FROM orders),
        l AS (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus, unnest(range(4)) AS i), m AS (SELECT l.o_orderstatus, i, coalesce(sum(share), 0) / any_value(g) AS mean_share FROM l CROSS JOIN k LEFT JOIN s USING (o_orderstatus) GROUP BY ALL)
        SELECT o_orderstatus, mean_share, CAST(row_number() OVER (ORDER BY mean_share DESC, i) AS INT) AS position FROM m"""),
    "threshold_metrics": (threshold_metrics, f"""WITH {_DECISIONS} SELECT {_P} AS precision, {_R} AS recall, {_F1} AS f1, (SELECT avg(CASE WHEN tp = pp AND tp = pos THEN 1.0::DOUBLE ELSE 0 END) FROM k) AS subset_accuracy, (pp + pos - 2 * tp) / n AS hamming_loss, (SELECT avg(pp) FROM k) AS mean_labels,
        (SELECT avg(CASE WHEN tp > 0 THEN 1.0::DOUBLE ELSE 0 END) FROM k) AS success_rate, (SELECT avg(CASE WHEN pp > 0 THEN 1.0::DOUBLE ELSE 0 END) FROM l) AS coverage, (SELECT avg(CASE WHEN pos > 0 AND pos < n THEN ((pos - tp) * (n - pos) + tp * (pp - tp)) / (pos * (n - pos)) ELSE 0 END) FROM k) AS ranking_loss,
        (SELECT avg(CASE WHEN pos = 0 THEN 0 WHEN pos > tp THEN n ELSE pp END) FROM k) AS coverage_error, {_EACH}, {_AUC} AS auc_micro, (SELECT avg({_AUC}) FROM l) AS auc_macro, (SELECT sum(({_AUC}) * pos) / sum(pos) FROM l) AS auc_weighted,
        {_AP} AS average_precision_micro, (SELECT avg({_AP}) FROM l) AS average_precision_macro FROM a"""),
    "word_lemmas": (word_lemmas, r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents), e(a, b) AS (VALUES ('', ''), ('s', ''), ('ses', 's'), ('ves', 'f'), ('xes', 'x'), ('zes', 'z'), ('ches', 'ch'), ('shes', 'sh'), ('men', 'man'), ('ies', 'y')),
        f AS (SELECT t, left(t, length(t) - length(a)) || b AS lemma FROM w, e WHERE ends_with(t, a) AND length(t) > length(a)) SELECT t AS token, (min({'n': length(lemma), 'l': lemma})).l AS lemma FROM f WHERE lemma IN (SELECT t FROM w) GROUP BY t"""),
    "cohort_order": (cohort_order, """SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'Humans' WHEN '2' THEN 'Agents' WHEN '3' THEN 'cursor' ELSE o_orderpriority END AS cohort, count(*) AS n, CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '2' THEN 8 WHEN '3' THEN 5 ELSE 9 END AS rank FROM orders GROUP BY ALL"""),
    "language_spellings": (language_spellings, """SELECT c_custkey, c_mktsegment || '|' || upper(left(c_name, 1)) || lower(substr(c_name, 2)) AS languages, CASE WHEN c_nationkey = c_custkey THEN c_name || '|' || c_nationkey ELSE c_name || '|' || c_nationkey || '|' || c_custkey END AS ids FROM customer"""),
}
