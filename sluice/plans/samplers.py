"""The full sampler on sales: status stands for the language, month and a popularity bucket for time and stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampler as P
from ..operators import sampling as B
from ..sources.tables import read_table

LABELS = ["held", "open", "done"]
ALPHAS = {"month": 0.25, "stars": 0.5}


def _strata(spark, d):
    """Sales by status, month and a bucket of their total; the buckets never split equal totals."""
    s = read_table(spark, d, "sales").select("sale_id", "status", F.date_format("sold_at", "yyyy-MM").alias("month"), F.greatest(F.lit(0), F.floor("total")).alias("v"))
    cuts = sorted(r.cut for r in B.cut_points(s.where("v IS NOT NULL"), "v", 4).collect())  # fewer than the buckets
    return s.select("sale_id", "status", "month", F.when(F.col("v").isNotNull(), B.assign_bucket(F.col("v"), cuts)).alias("stars"))


def _target(spark, d):
    return read_table(spark, d, "sales").count() // 5


def quota_sample(spark, d):
    """A fifth of the sales, a third of them of each status: one status has too few, and its deficit spills."""
    return P.sample(_strata(spark, d), "status", ["month", "stars"], LABELS, _target(spark, d), "sale_id", ALPHAS)


def bucket_sample(spark, d):
    """As above by existing strata and their sizes alone; the deficit is dealt over the strata of all statuses."""
    return P.sample(_strata(spark, d), "status", ["month", "stars"], LABELS, _target(spark, d), "sale_id", spill=["status", "month", "stars"])


def _sample_sql(alphas: dict[str, float], spill: list[str]) -> str:
    """The same allocation by windows over the strata, and the smallest hashes by rank."""

    def filled(source: str, group: str, order: str) -> str:
        """Rounds of one unit each: unit j of a stratum comes in round j; the first `need` units in turn are dealt."""
        return f"""(SELECT * EXCLUDE (j), count(j) AS extra FROM (
          SELECT x.*, CASE WHEN row_number() OVER (PARTITION BY {group} ORDER BY u.j, {order}) <= need THEN u.j END AS j
          FROM {source} x, LATERAL (SELECT unnest(range(1, greatest(least(room, need), 0) + 1)) AS j) u) GROUP BY ALL)"""

    soft = " * ".join(f"({1 - a}::DOUBLE * sum(n) OVER (PARTITION BY status, {d}) / sum(n) OVER (PARTITION BY status) + {a}::DOUBLE / kinds_{d})" for d, a in alphas.items()) or "CAST(n AS DOUBLE)"
    kinds = "".join(f", count(DISTINCT {d}) OVER (PARTITION BY status) AS kinds_{d}" for d in alphas)
    keys, spilt = "status, month, stars", ", ".join(spill)
    pri = "sha256(concat_ws(chr(0), '{}', CAST(sale_id AS VARCHAR)))"
    return f"""WITH v AS (SELECT sale_id, status, strftime(sold_at, '%Y-%m') AS month, CAST(greatest(0, floor(total)) AS BIGINT) AS v FROM sales),
    vn AS (SELECT v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY v),
    vr AS (SELECT v, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER () AS total, max(v) OVER () AS top FROM vn),
    cuts AS (SELECT DISTINCT min(v) AS cut FROM vr, (VALUES (1), (2), (3)) i(i) WHERE v < top AND cum >= total * i / 4.0::DOUBLE GROUP BY i),
    s AS (SELECT sale_id, coalesce(status, 'unknown') AS status, coalesce(month, 'unknown') AS month,
      coalesce('pop' || CASE WHEN v IS NOT NULL THEN (SELECT count(*) FROM cuts WHERE cut < v) END, 'unknown') AS stars FROM v),
    t AS (SELECT count(*) // 5 AS target FROM sales),
    sizes AS (SELECT status, month, stars, count(*) AS n FROM s GROUP BY ALL),
    labels AS (SELECT status, target // 3 + CASE WHEN i < target % 3 THEN 1 ELSE 0 END AS quota
      FROM (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(LABELS))}) l(status, i), t),
    w0 AS (SELECT sizes.*, coalesce(quota, 0) AS quota{kinds} FROM sizes LEFT JOIN labels USING (status)),
    w AS (SELECT {keys}, n, quota, {soft} AS w FROM w0),
    e AS (SELECT {keys}, n, w / sum(w) OVER (PARTITION BY status) * quota AS exact, quota, sum(n) OVER (PARTITION BY status) AS total FROM w),
    b AS (SELECT *, CASE WHEN total <= quota THEN n ELSE CAST(least(floor(exact), n) AS BIGINT) END AS base FROM e),
    r AS (SELECT *, exact - base AS rest, n - base AS room, CAST(least(quota, total) - sum(base) OVER (PARTITION BY status) AS BIGINT) AS need FROM b),
    got AS (SELECT {keys}, sum(extra) AS extra FROM {filled("r", "status", "rest DESC, month, stars")} GROUP BY ALL),
    take AS (SELECT {keys}, n, base + coalesce(extra, 0) AS take FROM r LEFT JOIN got USING ({keys})),
    one AS (SELECT sale_id, {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {pri.format('42')}, sale_id) <= take AS picked FROM s JOIN take USING ({keys})),
    more AS (SELECT {spilt}, CAST(sum(n - take) AS BIGINT) AS n FROM take GROUP BY ALL),
    m1 AS (SELECT more.*, CAST(target - (SELECT sum(take) FROM take) AS BIGINT) AS goal, sum(n) OVER () AS total FROM more, t),
    m2 AS (SELECT *, CAST(n AS DOUBLE) / total * goal AS exact FROM m1),
    m3 AS (SELECT *, CASE WHEN total <= goal THEN n ELSE CAST(least(floor(exact), n) AS BIGINT) END AS base, 0 AS g FROM m2),
    m4 AS (SELECT *, exact - base AS rest, n - base AS room, CAST(least(goal, total) - sum(base) OVER () AS BIGINT) AS need FROM m3),
    got2 AS (SELECT {spilt}, sum(extra) AS extra FROM {filled("m4", "g", "rest DESC, " + spilt)} GROUP BY ALL),
    spill AS (SELECT {spilt}, base + coalesce(extra, 0) AS extra FROM m4 LEFT JOIN got2 USING ({spilt})),
    two AS (SELECT sale_id, {keys}, row_number() OVER (PARTITION BY {spilt} ORDER BY {pri.format('42:spill')}, sale_id) <= extra AS picked
      FROM one JOIN spill USING ({spilt}) WHERE NOT one.picked)
    SELECT sale_id, {keys}, 1 AS pass FROM one WHERE picked UNION ALL SELECT sale_id, {keys}, 2 FROM two WHERE picked"""


QUERIES = {
    "quota_sample": (quota_sample, _sample_sql(ALPHAS, ["month", "stars"])),
    "bucket_sample": (bucket_sample, _sample_sql({}, ["status", "month", "stars"])),
}
