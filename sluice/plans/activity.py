"""Activity, composition and distribution queries on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import times as D
from ..operators import aggregate as A
from ..sources.tables import read_table

#: SQL of the two authorship groups of orders.
AUTHORED = "CASE WHEN o_orderstatus = 'F' THEN 'agent' ELSE 'human' END"


def _orders(spark, d):
    return read_table(spark, d, "orders").withColumn("authorship", F.when(F.col("o_orderstatus") == "F", "agent").otherwise("human"))


def weekly_cumulative(spark, d):
    weeks = read_table(spark, d, "events").groupBy("event_type", D.week_start("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return A.cumulative(weeks, ["event_type"], "week", "n")


def hour_of_day(spark, d):
    return read_table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def scope_counts(spark, d):
    df = _orders(spark, d)
    return A.scope_counts(df, ["o_orderpriority", "authorship"], [F.count(F.lit(1)).alias("prs"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_distinct("o_custkey").alias("repositories")])


def popularity_buckets(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100)).alias("stars"))
    return c.select("c_custkey", "stars", S.popularity_bucket("stars").alias("bucket"), S.popularity_group("stars").alias("level"))


def label_share(spark, d):
    return A.label_share(_orders(spark, d), ["o_orderpriority"], "authorship", 100.0)


def dense_label_counts(spark, d):
    return A.dense_counts(_orders(spark, d), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P", "X"])


def top5_per_scope(spark, d):
    return A.top_n(read_table(spark, d, "lineitem").withColumn("part", F.col("l_partkey") % 50), ["l_returnflag"], "part")


def distribution_summary(spark, d):
    v = _orders(spark, d).withColumn("value", F.when(F.col("o_custkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    return A.distribution_summary(v, ["o_orderpriority"], "value")


def longitudinal_summary(spark, d):
    e = read_table(spark, d, "events").withColumn("day", F.dayofmonth("ts") % 5)
    return A.mean_interval(e, ["event_type", "day"], "value")


def attrition(spark, d):
    e = read_table(spark, d, "events").select("event_type", (F.dayofmonth("ts") % 5).alias("day"))
    return A.retention(e, ["event_type"], "day")


def shannon_diversity(spark, d):
    n = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("l_orderkey").agg(F.collect_list("n").alias("c")).select("l_orderkey", F.round(S.shannon("c"), 9).alias("diversity"))


def contingency(spark, d):
    return A.crosstab(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


def cumulative_reliable(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("touches"), (F.col("event_id") % 11 != 0).alias("reliable"))
    return A.reliable_cumulative(e, ["user_id"], "event_id", "touches", "reliable")


def time_buckets(spark, d):
    e = read_table(spark, d, "events").select(D.time_bucket("ts", "hour").alias("hour"), D.time_bucket("ts", "month").alias("month"), D.quarter("ts").alias("quarter"))
    return e.groupBy("hour", "month", "quarter").agg(F.count(F.lit(1)).alias("n"))


def long_values(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("price"))
    return A.long_values(p, ["p_partkey"], ["size", "price"]).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def numeric_summary(spark, d):
    return A.numeric_summary(read_table(spark, d, "part"), ["p_brand"], "p_size")


def balance(spark, d):
    return A.balance(read_table(spark, d, "orders"), "o_orderpriority")


def dup_line_density(spark, d):
    return A.line_duplication(read_table(spark, d, "documents"), "doc_id", "text")


def cohort_stats(spark, d):
    o, li = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("files"), F.sum("l_quantity").alias("lines"))
    return o.join(per, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("prs"), F.count("files").alias("with_files"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.sum("lines").alias("lines"), F.count_distinct("o_custkey").alias("repositories"))


def murphy_hill_groups(spark, d):
    """Conditional sums per level, 0 for those without counts."""
    o, li = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    level = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "medium").otherwise("high")
    n = li.where("l_quantity > 25").groupBy("l_orderkey").agg(*[F.count_if(level == x).alias(x) for x in ("low", "medium", "high")])
    out = o.join(n, o.o_orderkey == n.l_orderkey, "left")
    return out.select("o_orderkey", "o_orderpriority", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("low", "medium", "high")])


def coverage_by_group(spark, d):
    status = S.refactoring_status(F.concat(F.col("event_type"), F.when(F.col("event_id") % 4 == 0, "_error").when(F.col("event_id") % 4 == 1, " unsupported").otherwise("")))
    e = read_table(spark, d, "events").withColumn("status", F.when(F.col("event_id") % 9 == 0, S.refactoring_status(F.lit("Success"))).when(F.col("event_id") % 9 == 1, S.refactoring_status(F.lit(None).cast("string"))).otherwise(status))
    return e.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


_SUM = "count({v}) AS n, avg({v}) AS mean, quantile_cont({v}, 0.5) AS median, quantile_cont(CASE WHEN {v} <> 0 THEN {v} END, 0.5) AS median_nonzero, count(*) FILTER ({v} = 0) AS zero_count, count(*) FILTER ({v} = 0) * 100.0::DOUBLE / count({v}) AS zero_percentage, min({v}) AS min, max({v}) AS max, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3, quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS iqr"

QUERIES = {
    "weekly_cumulative": (weekly_cumulative, """SELECT event_type, week, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY week ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
        FROM (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY ALL)"""),
    "hour_of_day": (hour_of_day, "SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL"),
    "scope_counts": (scope_counts, f"""WITH o AS (SELECT *, {AUTHORED} AS authorship FROM orders)
        SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' WHEN grouping(authorship) = 0 THEN 'authorship' ELSE 'overall' END AS scope,
        CASE WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority WHEN grouping(authorship) = 0 THEN authorship ELSE 'overall' END AS label,
        count(*) AS prs, count(*) FILTER (o_orderstatus = 'O') AS open, count(DISTINCT o_custkey) AS repositories FROM o GROUP BY GROUPING SETS ((), (o_orderpriority), (authorship))"""),
    "popularity_buckets": (popularity_buckets, """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS stars FROM customer)
        SELECT c_custkey, stars, CASE WHEN coalesce(stars, 0) <= 0 THEN 'pop0' WHEN stars <= 18 THEN 'pop1' ELSE 'pop2' END AS bucket,
        CASE WHEN stars IS NULL THEN NULL WHEN stars <= 0 THEN 'low' WHEN stars <= 18 THEN 'medium' ELSE 'high' END AS level FROM c"""),
    "label_share": (label_share, f"""WITH n AS (SELECT o_orderpriority, {AUTHORED} AS authorship, count(*) AS n FROM orders GROUP BY ALL)
        SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) * 100.0::DOUBLE AS share FROM n"""),
    "dense_label_counts": (dense_label_counts, """SELECT p.o_orderpriority, l.o_orderstatus, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) p
        CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) l(o_orderstatus) LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND o.o_orderstatus = l.o_orderstatus GROUP BY ALL"""),
    "top5_per_scope": (top5_per_scope, """WITH n AS (SELECT l_returnflag, l_partkey % 50 AS part, count(*) AS n FROM lineitem GROUP BY ALL),
        r AS (SELECT *, n / sum(n) OVER (PARTITION BY l_returnflag) AS share, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, part) AS INT) AS rank FROM n) SELECT * FROM r WHERE rank <= 5"""),
    "distribution_summary": (distribution_summary, "WITH v AS (SELECT o_orderpriority, CASE WHEN o_custkey % 7 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS value FROM orders) SELECT o_orderpriority, " + _SUM.format(v="value") + " FROM v GROUP BY o_orderpriority"),
    "longitudinal_summary": (longitudinal_summary, """WITH g AS (SELECT event_type, CAST(day(ts) % 5 AS INT) AS day, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS s FROM events GROUP BY ALL),
        h AS (SELECT *, CASE WHEN n > 1 THEN 1.96::DOUBLE * s / sqrt(n) ELSE 0 END AS half FROM g) SELECT event_type, day, n, mean, greatest(0.0::DOUBLE, mean - half) AS ci_low, mean + half AS ci_high FROM h"""),
    "attrition": (attrition, """WITH n AS (SELECT event_type, CAST(day(ts) % 5 AS INT) AS day, count(*) AS n FROM events GROUP BY ALL),
        b AS (SELECT *, first_value(n) OVER (PARTITION BY event_type ORDER BY day) AS baseline FROM n) SELECT *, n / baseline AS retained FROM b"""),
    "shannon_diversity": (shannon_diversity, """WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, n / sum(n) OVER (PARTITION BY l_orderkey) AS p FROM n)
        SELECT l_orderkey, round(0.0 - sum(p * log2(p)), 9) AS diversity FROM p GROUP BY l_orderkey"""),
    "contingency": (contingency, """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS "O", count(*) FILTER (l_linestatus = 'F') AS "F" FROM lineitem GROUP BY l_returnflag"""),
    "cumulative_reliable": (cumulative_reliable, """WITH e AS (SELECT user_id, event_id, event_id % 3 AS touches, event_id % 11 <> 0 AS reliable FROM events)
        SELECT *, CASE WHEN bool_and(reliable) OVER w THEN CAST(sum(touches) OVER w AS BIGINT) END AS running FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""),
    "time_buckets": (time_buckets, "SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, strftime(ts, '%Y-%m') AS month, year(ts) || '-Q' || quarter(ts) AS quarter, count(*) AS n FROM events GROUP BY ALL"),
    "long_values": (long_values, """WITH v AS (SELECT 'size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'price', p_retailprice FROM part WHERE p_retailprice > 1000)
        SELECT metric, count(*) AS n, min(value) AS least, max(value) AS most FROM v WHERE value IS NOT NULL GROUP BY metric"""),
    "numeric_summary": (numeric_summary, "SELECT p_brand, count(p_size) AS n, CAST(min(p_size) AS DOUBLE) AS min, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS median, avg(p_size) AS mean, CAST(max(p_size) AS DOUBLE) AS max FROM part GROUP BY p_brand"),
    "balance": (balance, """WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_orderpriority)
        SELECT min(n) AS min, max(n) AS max, avg(n) AS mean, stddev_pop(n) AS std, stddev_pop(n) / avg(n) AS cv, count(n) * stddev_pop(n) * stddev_pop(n) / avg(n) AS chi2 FROM n"""),
    "dup_line_density": (dup_line_density, r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g')) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS c FROM l WHERE line <> '' GROUP BY ALL)
        SELECT doc_id, CAST(sum(c) AS BIGINT) AS lines, CAST(sum(c - 1) AS BIGINT) AS duplicated, sum(c - 1) * 100.0::DOUBLE / sum(c) AS density FROM c GROUP BY doc_id"""),
    "cohort_stats": (cohort_stats, """WITH f AS (SELECT l_orderkey, count(*) AS files, sum(l_quantity) AS lines FROM lineitem GROUP BY ALL)
        SELECT o_orderpriority, count(*) AS prs, count(files) AS with_files, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, sum(lines) AS lines, count(DISTINCT o_custkey) AS repositories FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY ALL"""),
    "murphy_hill_groups": (murphy_hill_groups, """WITH n AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS low, count(*) FILTER (l_returnflag = 'N') AS medium, count(*) FILTER (l_returnflag = 'R') AS high FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
        SELECT o_orderkey, o_orderpriority, coalesce(low, 0) AS low, coalesce(medium, 0) AS medium, coalesce(high, 0) AS high FROM orders LEFT JOIN n ON o_orderkey = l_orderkey"""),
    "coverage_by_group": (coverage_by_group, """SELECT event_type, CASE WHEN event_id % 9 = 0 THEN 'success' WHEN event_id % 9 = 1 THEN 'missing' WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 4 = 1 THEN 'unsupported'
        WHEN event_type LIKE '%error%' THEN 'failed' ELSE 'other' END AS status, count(*) AS n FROM events GROUP BY ALL"""),
}
