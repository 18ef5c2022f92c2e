"""Joins, deduplication and line ranges on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources.tables import read_table


def dedup_first_row(spark, d):
    """The first row of each key by order, line and part, which is a total order of the rows."""
    key = S.stable_pr_key(F.col("l_partkey") % 100, F.when(F.col("l_suppkey") % 10 != 3, F.col("l_suppkey") % 10)).alias("key")
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key)
    return R.first_rows(li, ["key"], ["l_orderkey", "l_linenumber", "l_partkey"])


def latest_per_key(spark, d):
    return R.latest_rows(read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


def _levels(spark, d):
    c = read_table(spark, d, "customer")
    ids = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("id:"), "c_mktsegment").alias("domain"))
    keys = c.groupBy((F.col("c_custkey") % 100).alias("repo")).agg(F.concat(F.lit("key:"), F.min("c_mktsegment")).alias("domain"))
    return ids, keys


def fallback_join(spark, d):
    ids, keys = _levels(spark, d)
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 100).alias("repo"))
    both = ids.withColumn("repo", F.lit(None).cast("long"))
    a = o.join(both.drop("repo").withColumnRenamed("domain", "by_id"), "o_custkey", "left").join(keys.withColumnRenamed("domain", "by_key"), "repo", "left")
    return a.select("o_orderkey", F.coalesce("by_id", "by_key").alias("domain"))


def union_join(spark, d):
    ids, keys = _levels(spark, d)
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 100).alias("repo"))
    return o.join(ids, "o_custkey").select("o_orderkey", "domain").unionByName(o.join(keys, "repo").select("o_orderkey", "domain")).distinct()


def semi_join(spark, d):
    big = read_table(spark, d, "lineitem").where("l_quantity >= 49").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.keep_matching(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), big, ["o_orderkey"])


def anti_join(spark, d):
    big = read_table(spark, d, "lineitem").where("l_quantity >= 20").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.keep_matching(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), big, ["o_orderkey"], matching=False)


def asof_next(spark, d):
    e = read_table(spark, d, "events")
    targets = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return R.asof_next(targets, e.where("event_type <> 'click'").select("user_id", F.col("ts").alias("at"), "event_id").withColumnRenamed("event_id", "next"), ["user_id"], "ts", "at", "next")


def _ranges(spark, d):
    e = read_table(spark, d, "events")
    return e.select("user_id", "event_id", (F.col("event_id") % 400).alias("start"), (F.col("event_id") % 400 + F.col("event_id") % 13).alias("end"))


def merge_ranges(spark, d):
    return R.merge_ranges(_ranges(spark, d), ["user_id"])


def covered_lines(spark, d):
    return R.covered_lines(_ranges(spark, d), ["user_id"])


def interval_overlap(spark, d):
    r = _ranges(spark, d)
    pairs = R.interval_overlap(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"), ["user_id"], 32)
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("lines"))


def before_after_delta(spark, d):
    label = F.when(F.col("event_id") % 3 == 0, "before").when(F.col("event_id") % 3 == 1, "after").otherwise("other")
    e = read_table(spark, d, "events").groupBy("user_id", label.alias("label")).agg(F.max("event_id").alias("v"))
    return R.before_after(e, ["user_id"], "label", "before", "after", "v")


def nearest_replacement(spark, d):
    """For every part whose price has 85 cents or more a part of its brand that has fewer: by size, price, and key."""
    p = read_table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.floor("p_retailprice").alias("lines"), (F.col("p_retailprice") - F.floor("p_retailprice") >= 0.85).alias("failed"))
    t = p.where("failed").withColumnRenamed("p_partkey", "target")
    return R.nearest_in_buckets(t, p.where("not failed"), ["p_brand"], "p_size", "lines", "target", "p_partkey")


def multiset_difference(spark, d):
    n = read_table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).alias("side"), (F.col("l_partkey") % 20).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return R.multiset_difference(n.where("side = 0"), n.where("side = 1"), ["l_returnflag", "part"], "n")


def dominant_language(spark, d):
    """Per order the return flag with most quantity, then most lines, then by name."""
    g = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("loc"), F.count(F.lit(1)).alias("files"))
    return R.first_rows(g, ["l_orderkey"], [F.desc("loc"), F.desc("files"), F.asc("l_returnflag")])


def domain_rollup(spark, d):
    """Per label: count, sum, maximum and the vector with the first rank."""
    e = read_table(spark, d, "embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("topic_count"), F.max("score").alias("score_max"), F.min_by("vec_id", F.struct((-F.col("score")).alias("s"), "vec_id")).alias("top_topic"))


_LEVELS = """ids AS (SELECT c_custkey AS o_custkey, 'id:' || c_mktsegment AS domain FROM customer WHERE c_custkey % 2 = 0),
 keys AS (SELECT c_custkey % 100 AS repo, 'key:' || min(c_mktsegment) AS domain FROM customer GROUP BY ALL), o AS (SELECT o_orderkey, o_custkey, o_custkey % 100 AS repo FROM orders)"""
_RANGES = "r AS (SELECT user_id, event_id, event_id % 400 AS s, event_id % 400 + event_id % 13 AS e FROM events)"
# equal ranges count once: the two windows are sorted apart, and may order equal rows differently
_ISLANDS = f"""{_RANGES}, u AS (SELECT DISTINCT user_id, s, e FROM r), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM u),
 i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f), m AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, island)"""

QUERIES = {
    "dedup_first_row": (dedup_first_row, """WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 100) || '#' || CASE WHEN l_suppkey % 10 <> 3 THEN l_suppkey % 10 END AS key FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM k) SELECT l_orderkey, l_linenumber, l_partkey, key FROM r WHERE key IS NULL OR rn = 1"""),
    "latest_per_key": (latest_per_key, "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "fallback_join": (fallback_join, f"WITH {_LEVELS} SELECT o_orderkey, coalesce(ids.domain, keys.domain) AS domain FROM o LEFT JOIN ids USING (o_custkey) LEFT JOIN keys ON o.repo = keys.repo"),
    "union_join": (union_join, f"WITH {_LEVELS} SELECT o_orderkey, domain FROM o JOIN ids USING (o_custkey) UNION SELECT o_orderkey, domain FROM o JOIN keys USING (repo)"),
    "semi_join": (semi_join, "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)"),
    "anti_join": (anti_join, "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 20)"),
    "asof_next": (asof_next, """WITH t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), n AS (SELECT t.event_id, min(e.ts) AS next_at FROM t LEFT JOIN events e ON e.user_id = t.user_id AND e.ts > t.ts AND e.event_type <> 'click' GROUP BY t.event_id)
        SELECT t.event_id, t.user_id, t.ts, n.next_at, (SELECT min(event_id) FROM events e WHERE e.user_id = t.user_id AND e.ts = n.next_at AND e.event_type <> 'click') AS next_value FROM t JOIN n USING (event_id)"""),
    "merge_ranges": (merge_ranges, f'WITH {_ISLANDS} SELECT user_id, s AS start, e AS "end" FROM m'),
    "covered_lines": (covered_lines, f"WITH {_ISLANDS} SELECT user_id, CAST(sum(e - s + 1) AS BIGINT) AS lines FROM m GROUP BY user_id"),
    "interval_overlap": (interval_overlap, f"WITH {_RANGES} SELECT a.user_id, count(*) AS pairs, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) AS BIGINT) AS lines FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND a.s <= b.e AND b.s <= a.e GROUP BY a.user_id"),
    "before_after_delta": (before_after_delta, """SELECT user_id, max(event_id) FILTER (event_id % 3 = 0) AS before, max(event_id) FILTER (event_id % 3 = 1) AS after, max(event_id) FILTER (event_id % 3 = 1) - max(event_id) FILTER (event_id % 3 = 0) AS delta
        FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 3 = 0) > 0 AND count(*) FILTER (event_id % 3 = 1) > 0"""),
    "nearest_replacement": (nearest_replacement, """WITH p AS (SELECT p_partkey, p_brand, p_size, CAST(floor(p_retailprice) AS BIGINT) AS lines, p_retailprice - floor(p_retailprice) >= 0.85 AS failed FROM part),
        j AS (SELECT t.p_partkey AS target, p.p_partkey, p.p_size, p.lines, row_number() OVER (PARTITION BY t.p_partkey ORDER BY abs(p.p_size - t.p_size), abs(p.lines - t.lines), p.lines, p.p_partkey) AS rn
        FROM p t JOIN p ON t.p_brand = p.p_brand AND t.failed AND NOT p.failed) SELECT target, p_partkey, p_size, lines FROM j WHERE rn = 1"""),
    "multiset_difference": (multiset_difference, "SELECT l_returnflag, l_partkey % 20 AS part, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) > 0"),
    "dominant_language": (dominant_language, "WITH g AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS loc, count(*) AS files FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, loc, files FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY loc DESC, files DESC, l_returnflag) AS rn FROM g) WHERE rn = 1"),
    "domain_rollup": (domain_rollup, "WITH e AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS score FROM embeddings) SELECT label, count(*) AS topic_count, max(score) AS score_max, (SELECT vec_id FROM e f WHERE f.label = e.label ORDER BY score DESC, vec_id LIMIT 1) AS top_topic FROM e GROUP BY label"),
}
