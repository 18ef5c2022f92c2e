"""Statistics and sampling on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import sampling as B
from ..operators import stats as Q
from ..sources.tables import read_table


def _two(spark, d):
    return read_table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "agent").otherwise("human").alias("g"), F.floor(F.col("o_totalprice") / 1000).alias("v"))


def mann_whitney_u(spark, d):
    out = Q.mann_whitney(_two(spark, d), ["o_orderpriority"], "v", "g", "agent", "human")
    return out.select("o_orderpriority", "n1", "n2", "u", F.round("delta", 9).alias("delta"), F.round("z", 6).alias("z"))


def cliffs_delta(spark, d):
    out = Q.mann_whitney(_two(spark, d).withColumn("f", F.lit("all")), ["f"], "v", "g", "agent", "human")
    return out.select("n1", "n2", F.round("delta", 9).alias("delta"))


def kruskal_h(spark, d):
    out = Q.kruskal(_two(spark, d).withColumn("f", F.lit("all")), ["f"], "v", "o_orderpriority")
    return out.select("k", "n", F.round("h", 6).alias("h"), F.round("epsilon_squared", 9).alias("epsilon_squared"))


def chi_square(spark, d):
    out = Q.chi_square(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select(F.round("chi2", 4).alias("chi2"), "dof", "n", F.round("cramers_v", 9).alias("cramers_v"))


def bh_adjust(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 17 != 0, (F.col("o_totalprice") % 1000) / F.lit(1000.0)).alias("p_value"))
    return Q.benjamini_hochberg(o, ["o_orderpriority"]).withColumn("p_adjusted", F.round("p_adjusted", 9))


def median_ci(spark, d):
    """The median of each cohort and its interval by order statistics."""
    return Q.median_interval(_two(spark, d), ["o_orderpriority"], "v")


def delta_ci(spark, d):
    """Cliff's delta of each cohort and its interval."""
    out = Q.delta_interval(_two(spark, d), ["o_orderpriority"], "v", "g", "agent", "human")
    return out.select("o_orderpriority", *[F.round(c, 8).alias(c) for c in ("delta", "ci_low", "ci_high")])


def small_sample_p(spark, d):
    """Exact p-values where a customer has few orders of either kind, none of them tied."""
    o = read_table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "agent").otherwise("human").alias("g"), "o_totalprice")
    return Q.mann_whitney_p(Q.mann_whitney(o, ["o_custkey"], "o_totalprice", "g", "agent", "human", ties=True)).select("o_custkey", "n1", "n2", "u", "tied", F.round("p_value", 9).alias("p_value"))


def comparison_panel(spark, d):
    """Agent against human in each cohort, with p-values adjusted within the panel."""
    out = Q.normal_p(Q.mann_whitney(_two(spark, d), ["o_orderpriority"], "v", "g", "agent", "human")).withColumn("panel", F.lit(1))
    return Q.benjamini_hochberg(out, ["panel"]).withColumn("significant", F.col("p_adjusted") <= 0.001)


def cut_points(spark, d):
    return B.cut_points(read_table(spark, d, "customer").select(F.floor(F.col("c_acctbal") / 500).alias("v")), "v", 4)


def assigned_buckets(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 500)).alias("v"))
    cuts = sorted(r.cut for r in B.cut_points(c, "v", 4).collect())  # fewer than the buckets
    return c.select("c_custkey", B.assign_bucket(F.col("v"), cuts).alias("bucket"))


def largest_remainder(spark, d):
    sizes = read_table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return B.proportional_quotas(sizes, "c_mktsegment", "n", 37)


def hash_bottom_k(spark, d):
    return B.bottom_k(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 20, "o_orderkey")


def stratified_sample(spark, d):
    out = B.stratified_sample(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], 150, "o_orderkey")
    return out.drop("rank")


def train_test_split(spark, d):
    return B.train_test_split(read_table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang"], 0.2, "doc_id")


def hour_quota(spark, d):
    return B.quota_by_hour(read_table(spark, d, "events").select("event_id", "ts"), "ts", 2, "event_id")


def blended_weights(spark, d):
    sizes = read_table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return B.blended_weights(sizes, ["o_orderpriority", "o_orderstatus"], "n", 0.3).withColumn("weight", F.round("weight", 9))


def precision_at_k(spark, d):
    """Precision and recall at 5 of scores by vector against odd labels."""
    e = read_table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("hit"), (F.col("vec_id") % 25).alias("q"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    r = e.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    g = r.groupBy("q").agg(F.sum(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)).alias("hits"), F.sum("hit").alias("labels"))
    return g.select("q", "hits", "labels", (F.col("hits") / F.lit(5.0)).alias("precision"), F.when(F.col("labels") > 0, F.col("hits") / F.least(F.lit(5), "labels")).alias("recall"))


_V = "v AS (SELECT o_orderpriority AS f, CASE WHEN o_orderstatus = 'F' THEN 'agent' ELSE 'human' END AS g, floor(o_totalprice / 1000) AS v FROM orders)"


def _mwu(fam):
    return f"""WITH {_V}, r AS (SELECT *, rank() OVER (PARTITION BY {fam} ORDER BY v) + (count(*) OVER (PARTITION BY {fam}, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY {fam}, v) AS t FROM v),
    s AS (SELECT {fam} AS fam, count(*) FILTER (g = 'agent') AS n1, count(*) FILTER (g = 'human') AS n2, sum(rk) FILTER (g = 'agent') AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS tie, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, CAST(n1 AS DOUBLE) * n2 AS m FROM s)"""


_Z = 1.9599639845400536  # of a probability of 0.95
_SIZES = "s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT *, n * 37.0::DOUBLE / sum(n) OVER () AS e FROM s)"
_CUTS = """c AS (SELECT c_custkey, greatest(0, CAST(floor(c_acctbal / 500) AS BIGINT)) AS v FROM customer), n AS (SELECT v, count(*) AS n FROM c GROUP BY v), r AS (SELECT v, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER () AS total, max(v) OVER () AS top FROM n),
 cuts AS (SELECT DISTINCT min(v) AS cut FROM r, (VALUES (1), (2), (3)) i(i) WHERE v < top AND cum >= total * i / 4.0::DOUBLE GROUP BY i)"""
_PRI = "sha256(concat_ws(chr(0), '42', CAST({} AS VARCHAR)))"

QUERIES = {
    "mann_whitney_u": (mann_whitney_u, _mwu("f") + " SELECT fam AS o_orderpriority, n1, n2, u, round(2 * u / m - 1, 9) AS delta, round((abs(u - m / 2) - 0.5) / sqrt(m / 12 * ((n + 1) - tie / (n * (n - 1)))), 6) AS z FROM u"),
    "cliffs_delta": (cliffs_delta, _mwu("1") + " SELECT n1, n2, round(2 * u / m - 1, 9) AS delta FROM u"),
    "kruskal_h": (kruskal_h, f"""WITH {_V}, r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY v) AS t FROM v),
        g AS (SELECT f, count(*) AS m, sum(rk) AS r, sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM r GROUP BY f), s AS (SELECT count(*) AS k, CAST(sum(m) AS DOUBLE) AS n, sum(r * r / m) AS s, sum(tie) AS tie FROM g),
        h AS (SELECT k, n, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h FROM s) SELECT k, CAST(n AS BIGINT) AS n, round(h, 6) AS h, round(h * (n + 1) / (n * n - 1), 9) AS epsilon_squared FROM h"""),
    "chi_square": (chi_square, """WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS o FROM lineitem GROUP BY ALL), e AS (SELECT a.a, b.b, coalesce(o.o, 0) AS o, a.t * b.t / n.t AS e, n.t AS n
        FROM (SELECT a, sum(o) AS t FROM o GROUP BY a) a CROSS JOIN (SELECT b, sum(o) AS t FROM o GROUP BY b) b CROSS JOIN (SELECT sum(o) AS t FROM o) n LEFT JOIN o ON o.a = a.a AND o.b = b.b),
        s AS (SELECT sum((o - e) * (o - e) / e) AS chi2, count(DISTINCT a) - 1 AS r, count(DISTINCT b) - 1 AS c, any_value(n) AS n FROM e) SELECT round(chi2, 4) AS chi2, r * c AS dof, CAST(n AS BIGINT) AS n, round(sqrt(chi2 / (n * least(r, c))), 9) AS cramers_v FROM s"""),
    "bh_adjust": (bh_adjust, """WITH p AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 17 <> 0 THEN (o_totalprice % 1000) / 1000.0::DOUBLE END AS p FROM orders), r AS (SELECT *, count(p) OVER (PARTITION BY o_orderpriority) AS m, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p, o_orderkey) AS k FROM p WHERE p IS NOT NULL)
        SELECT o_orderkey, o_orderpriority, p AS p_value, round(least(1.0::DOUBLE, min(p * m / k) OVER (PARTITION BY o_orderpriority ORDER BY k DESC)), 9) AS p_adjusted FROM r UNION ALL SELECT o_orderkey, o_orderpriority, NULL, NULL FROM p WHERE p IS NULL"""),
    "median_ci": (median_ci, f"""WITH {_V}, r AS (SELECT f, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY f ORDER BY v) AS k, count(*) OVER (PARTITION BY f) AS n FROM v WHERE v IS NOT NULL)
        SELECT f AS o_orderpriority, n, median(v) AS median, min(v) FILTER (k >= greatest(1, floor((n - {_Z}::DOUBLE * sqrt(n)) / 2))) AS ci_low,
          min(v) FILTER (k >= least(n, ceil((n + {_Z}::DOUBLE * sqrt(n)) / 2) + 1)) AS ci_high FROM r GROUP BY f, n"""),
    "delta_ci": (delta_ci, f"""WITH {_V}, c AS (SELECT f, v, count(*) FILTER (g = 'agent') AS a, count(*) FILTER (g = 'human') AS b FROM v WHERE v IS NOT NULL GROUP BY f, v),
        s AS (SELECT *, CAST(sum(a) OVER w AS DOUBLE) AS ca, CAST(sum(b) OVER w AS DOUBLE) AS cb, CAST(sum(a) OVER (PARTITION BY f) AS DOUBLE) AS n1, CAST(sum(b) OVER (PARTITION BY f) AS DOUBLE) AS n2 FROM c WINDOW w AS (PARTITION BY f ORDER BY v)),
        d AS (SELECT *, (2 * (cb - b) + b - n2) / n2 AS d1, (2 * (ca - a) + a - n1) / n1 AS d2 FROM s), e AS (SELECT f, n1, n2, sum(a * d1) / n1 AS delta, sum(a * d1 * d1) AS q1, sum(b * d2 * d2) AS q2, sum(CAST(a AS DOUBLE) * b) AS even FROM d GROUP BY f, n1, n2),
        g AS (SELECT *, greatest((n2 * n2 * (q1 - n1 * delta * delta) + n1 * n1 * (q2 - n2 * delta * delta) - (n1 * n2 - even - n1 * n2 * delta * delta)) / (n1 * n2 * (n1 - 1) * (n2 - 1)), (1 - delta * delta) / (n1 * n2 - 1)) AS var, {_Z}::DOUBLE AS z FROM e),
        h AS (SELECT f, delta, z * sqrt(var) * sqrt(pow(1 - delta * delta, 2) + z * z * var) AS reach, 1 - delta * delta + z * z * var AS base, delta - delta * delta * delta AS mid FROM g)
        SELECT f AS o_orderpriority, round(delta, 8) AS delta, round(greatest(-1, (mid - reach) / base), 8) AS ci_low, round(least(1, (mid + reach) / base), 8) AS ci_high FROM h"""),
    "small_sample_p": (small_sample_p, None),
    "comparison_panel": (comparison_panel, None),
    "cut_points": (cut_points, f"WITH {_CUTS} SELECT cut FROM cuts"),
    "assigned_buckets": (assigned_buckets, f"WITH {_CUTS} SELECT c_custkey, 'pop' || (SELECT count(*) FROM cuts WHERE cut < c.v) AS bucket FROM c"),
    "largest_remainder": (largest_remainder, f"WITH {_SIZES} SELECT c_mktsegment, n, CAST(least(n, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, c_mktsegment) <= 37 - sum(floor(e)) OVER () THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM x"),
    "hash_bottom_k": (hash_bottom_k, f"SELECT o_orderkey, o_orderpriority, CAST(rn AS INT) AS rank FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_PRI.format('o_orderkey')}, o_orderkey) AS rn FROM orders) WHERE rn <= 20"),
    "stratified_sample": (stratified_sample, f"""WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), x AS (SELECT *, n * 150.0::DOUBLE / sum(n) OVER () AS e FROM s),
        q AS (SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, o_orderpriority || chr(31) || o_orderstatus DESC) <= 150 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM x),
        r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY {_PRI.format('o_orderkey')}, o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_orderpriority, o_orderstatus FROM r JOIN q USING (o_orderpriority, o_orderstatus) WHERE rn <= quota"""),
    "train_test_split": (train_test_split, f"""WITH r AS (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY {_PRI.format('doc_id')}, doc_id) AS rn FROM documents)
        SELECT doc_id, lang, source, CASE WHEN n >= 2 AND rn <= greatest(1, least(n - 1, floor(n * 0.2::DOUBLE))) THEN 'test' ELSE 'train' END AS split FROM r"""),
    "hour_quota": (hour_quota, f"SELECT event_id, ts, hour, CAST(rn AS INT) AS rank FROM (SELECT event_id, ts, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY {_PRI.format('event_id')}, event_id) AS rn FROM events) WHERE rn <= 2"),
    "blended_weights": (blended_weights, """WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT count(DISTINCT o_orderpriority) AS a, count(DISTINCT o_orderstatus) AS b, sum(n) AS t FROM s)
        SELECT o_orderpriority, o_orderstatus, n, round((0.7::DOUBLE * sum(n) OVER (PARTITION BY o_orderpriority) / t + 0.3::DOUBLE / a) * (0.7::DOUBLE * sum(n) OVER (PARTITION BY o_orderstatus) / t + 0.3::DOUBLE / b), 9) AS weight FROM s, k"""),
    "precision_at_k": (precision_at_k, """WITH e AS (SELECT vec_id, label % 2 AS hit, vec_id % 25 AS q, row_number() OVER (PARTITION BY vec_id % 25 ORDER BY round(CAST(embedding[1] AS DOUBLE), 6) DESC, vec_id) AS rank FROM embeddings),
        g AS (SELECT q, CAST(sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS BIGINT) AS hits, CAST(sum(hit) AS BIGINT) AS labels FROM e GROUP BY q) SELECT q, hits, labels, hits / 5.0::DOUBLE AS precision, CASE WHEN labels > 0 THEN hits / least(5, labels) END AS recall FROM g"""),
}
