"""Change metrics and public tables on nested stand-ins: orders with their lines as files, events as snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import metrics as M
from ..operators import stats as Q
from ..operators import taxonomy as X
from ..sources.tables import read_table


def _nested(spark, d):
    li = read_table(spark, d, "lineitem")
    file = F.struct(F.concat(F.lit("f"), (F.col("l_partkey") % 40).cast("string")).alias("path"), F.col("l_returnflag").alias("language"), F.col("l_quantity").cast("long").alias("additions"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("long")).alias("deletions"))
    files = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", file.alias("f")))).alias("x")).select(F.col("l_orderkey").alias("o_orderkey"), F.transform("x", lambda x: x["f"]).alias("files"))
    totals = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey"))
    return read_table(spark, d, "orders").join(files, "o_orderkey").select("o_orderkey", totals.alias("additions"), totals.alias("deletions"), "files")


def pull_request_measures(spark, d):
    return M.pull_request_measures(_nested(spark, d), "o_orderkey", "files").withColumn("languages", F.array_join("languages", ","))


def dominant_file_language(spark, d):
    return M.dominant_file_language(_nested(spark, d), "o_orderkey", "files")


def nested_file_rows(spark, d):
    prs = _nested(spark, d).select(F.col("o_orderkey").cast("string").alias("id"), "files")
    return E.file_rows(prs).drop("position")


def touched_lines(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 300).alias("start"), (F.col("event_id") % 300 + F.col("event_id") % 7).alias("end"), F.when(F.col("event_id") % 5 < 2, "+3d").otherwise("+7d").alias("label"))
    zones = e.where("event_id % 2 = 0").select("user_id", "start", "end")
    return M.touched_lines(zones, e.where("event_id % 2 = 1").select("user_id", "label", "start", "end"), ["user_id"], ["label"])


def file_availability(spark, d):
    e = read_table(spark, d, "events").select("user_id", (F.col("event_id") % 50).cast("string").alias("path"), "event_id")
    status = F.when(F.col("event_id") % 100 < 30, "present").when(F.col("event_id") % 100 < 40, "deleted").when(F.col("event_id") % 100 < 45, "renamed")
    seen = e.groupBy("user_id", "path").agg(F.min("event_id").alias("event_id")).withColumn("status", status)
    return M.file_availability(e, seen, ["user_id"], "path", "status")


def retention_summary(spark, d):
    e = read_table(spark, d, "events").withColumn("status", M.operation_retention(F.col("event_id") % 4 != 0, F.col("event_id") % 3 != 0, F.col("event_id") % 9))
    return M.retention_summary(e, ["event_type"], "status")


def smell_categories(spark, d):
    n = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus", F.concat(F.lit("s"), (F.col("l_partkey") % 6).cast("string")).alias("smell")).agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("l_orderkey", "l_linestatus").agg(F.map_from_entries(F.collect_list(F.struct("smell", "n"))).alias("counts"))
    return E.smell_rows(m, ["l_orderkey"], "l_linestatus", "counts", {"s0": "bloaters", "s1": "couplers", "s2": "bloaters"})


def level_counts(spark, d):
    labels = ["extract_method", "Move-Class", "Rename Variable", "unclassified"]
    label = F.element_at(F.array(*map(F.lit, labels)), (F.col("l_partkey") % 4 + 1).cast("int"))
    n = read_table(spark, d, "lineitem").groupBy("l_orderkey", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))
    return X.level_counts(m, ["l_orderkey"], "counts", X.level_dim(spark, ["Move Class"]), ["low", "medium", "high"])


def top_predictions(spark, d):
    e = read_table(spark, d, "embeddings").select((F.col("vec_id") % 40).alias("repo"), F.struct(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("topic"), F.round(F.col("embedding")[1].cast("double"), 6).alias("score")).alias("p"))
    p = E.top_predictions(e.groupBy("repo").agg(F.collect_list("p").alias("ps")), "repo", "ps", 3)
    return p.select("repo", "top_topic", F.array_join(F.transform("predictions", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["topic"])), " ").alias("ranked"))


def repository_reasons(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("readme"), F.when(F.col("doc_id") % 10 != 1, F.col("source")).alias("description"))
    return docs.select("doc_id", E.repository_record_reason(most=0.03).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def value_ranks(spark, d):
    v = read_table(spark, d, "part").select("p_brand", F.col("p_size").alias("v"), F.lit("all").alias("f"))
    return Q.value_ranks(v, ["f"], "v", "p_brand").drop("f")


_FILES = """f AS (SELECT l_orderkey, l_linenumber, 'f' || (l_partkey % 40) AS path, l_returnflag AS language, CAST(l_quantity AS BIGINT) AS additions, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS deletions FROM lineitem)"""

QUERIES = {
    "pull_request_measures": (pull_request_measures, f"""WITH {_FILES}, g AS (SELECT l_orderkey, sum(additions) + sum(coalesce(deletions, 0)) AS lines, count(DISTINCT path) AS files, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM f GROUP BY ALL)
        SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 * o_custkey ELSE lines END AS BIGINT) AS changed_lines, CAST(files AS INT) AS files, languages FROM orders JOIN g ON l_orderkey = o_orderkey"""),
    "dominant_file_language": (dominant_file_language, f"""WITH {_FILES}, g AS (SELECT l_orderkey, language, sum(additions + coalesce(deletions, 0)) AS loc, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY loc DESC, n DESC, language) AS rn FROM g)
        SELECT l_orderkey AS o_orderkey, language FROM r WHERE rn = 1"""),
    "nested_file_rows": (nested_file_rows, f"""WITH {_FILES} SELECT printf('%s::file::%06d', CAST(l_orderkey AS VARCHAR), row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, path, language, additions) - 1) AS file_key, CAST(l_orderkey AS VARCHAR) AS pull_request_key, path, language, additions, deletions FROM f"""),
    "touched_lines": (touched_lines, """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 < 2 THEN '+3d' ELSE '+7d' END AS label, unnest(range(event_id % 300, event_id % 300 + event_id % 7 + 1)) AS line FROM events),
        z AS (SELECT DISTINCT user_id, line FROM e WHERE event_id % 2 = 0), c AS (SELECT DISTINCT user_id, label, line FROM e WHERE event_id % 2 = 1) SELECT user_id, label, count(*) AS touched_lines FROM z JOIN c USING (user_id, line) GROUP BY ALL"""),
    "file_availability": (file_availability, """WITH e AS (SELECT user_id, CAST(event_id % 50 AS VARCHAR) AS path, event_id FROM events), s AS (SELECT user_id, path, min(event_id) % 100 AS m FROM e GROUP BY ALL),
        j AS (SELECT w.user_id, CASE WHEN m < 30 THEN 'present' WHEN m < 40 THEN 'deleted' WHEN m < 45 THEN 'renamed' ELSE 'unknown' END AS st FROM (SELECT DISTINCT user_id, path FROM e) w LEFT JOIN s USING (user_id, path)),
        c AS (SELECT user_id, count(*) AS expected, count(*) FILTER (st = 'present') AS present, count(*) FILTER (st = 'deleted') AS deleted, count(*) FILTER (st = 'renamed') AS renamed, count(*) FILTER (st = 'unknown') AS unknown FROM j GROUP BY ALL)
        SELECT *, CASE WHEN present = expected THEN 'complete' WHEN present = 0 THEN 'all_missing' ELSE 'partial' END AS availability FROM c"""),
    "retention_summary": (retention_summary, """WITH s AS (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN 'u' WHEN event_id % 4 <> 0 AND event_id % 3 <> 0 THEN 'r' WHEN event_id % 4 <> 0 THEN 'w' ELSE 'n' END AS s FROM events)
        SELECT event_type, count(*) FILTER (s = 'r') AS retained, count(*) FILTER (s = 'w') AS weakly_retained, count(*) FILTER (s = 'n') AS not_retained, count(*) FILTER (s = 'u') AS unknown, count(*) AS total, count(*) FILTER (s IN ('r', 'w')) / count(*) AS retention_rate FROM s GROUP BY ALL"""),
    "smell_categories": (smell_categories, """SELECT l_orderkey, l_linestatus, count(*) FILTER (l_partkey % 6 IN (0, 2)) AS bloaters, count(*) FILTER (l_partkey % 6 = 1) AS couplers, count(*) FILTER (l_partkey % 6 > 2) AS others, count(*) AS total FROM lineitem GROUP BY ALL"""),
    "level_counts": (level_counts, "SELECT l_orderkey, count(*) FILTER (l_partkey % 4 = 2) AS low, count(*) FILTER (l_partkey % 4 = 0) AS medium, count(*) FILTER (l_partkey % 4 = 1) AS high FROM lineitem GROUP BY ALL"),
    "top_predictions": (top_predictions, """WITH e AS (SELECT vec_id % 40 AS repo, 't' || vec_id AS topic, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY round(CAST(embedding[2] AS DOUBLE), 6) DESC, 't' || vec_id) AS rank FROM embeddings)
        SELECT repo, max(topic) FILTER (rank = 1) AS top_topic, string_agg(rank || ':' || topic, ' ' ORDER BY rank) AS ranked FROM e WHERE rank <= 3 GROUP BY repo"""),
    "repository_reasons": (repository_reasons, r"""WITH s AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents),
        r AS (SELECT CASE WHEN doc_id % 10 = 0 OR trim(text) = '' THEN 'missing_readme' WHEN doc_id % 10 = 1 THEN 'missing_description' WHEN n > 0 AND (n - a) / n > 0.03::DOUBLE THEN 'non_english' END AS reason FROM s) SELECT reason, count(*) AS n FROM r GROUP BY ALL"""),
    "value_ranks": (value_ranks, "WITH r AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS v, rank() OVER (ORDER BY p_size) AS k, count(*) OVER (PARTITION BY p_size) AS ties FROM part) SELECT p_brand, v, count(*) AS n, any_value(ties) AS ties, any_value(k + (ties - 1) / 2.0::DOUBLE) AS rank FROM r GROUP BY p_brand, v"),
}
