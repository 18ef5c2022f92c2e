"""Rank statistics, effect sizes and corrections. Ranks come from counts by distinct value, so ties cost nothing and no
group is gathered; p-values need a few rows only."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import match, running, same


def value_ranks(df: DataFrame, family: list[str], value: str, group: str) -> DataFrame:
    """Per (family, group, value): n, ties (of the family) and the average rank in the family."""
    v = F.col(value).cast("double")
    per = df.where(v.isNotNull()).groupBy(*family, group, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ties = per.groupBy(*family, "v").agg(F.sum("n").alias("ties"))
    run = running(ties, family, [F.col("v").asc()], "ties", "__run")
    ranked = run.select(*family, "v", "ties", (F.col("__run") - F.col("ties") + (F.col("ties") + 1) / F.lit(2.0)).alias("rank"))
    return per.join(ranked, [*family, "v"])


def mann_whitney(df: DataFrame, family: list[str], value: str, group: str, first: str, second: str, ties: bool = False) -> DataFrame:
    """U of the first group, Cliff's delta, the tie-corrected normal z with continuity correction, and both sizes; with ties,
    also whether any value is tied."""
    r = value_ranks(df.where(F.col(group).isin(first, second)), family, value, group)
    one = F.col(group) == first
    out = r.groupBy(*family).agg(
        F.sum(F.when(one, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("n2"),
        F.sum(F.when(one, F.col("n") * F.col("rank")).otherwise(F.lit(0.0))).alias("r1"),
        # a value's ties are counted once for each of its two groups' shares
        F.sum(F.col("n") * (F.col("ties").cast("double") * F.col("ties") - 1)).alias("tie"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    out = out.where("n1 > 0 and n2 > 0").withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = (F.abs(F.col("u") - n1 * n2 / 2) - F.lit(0.5)) / F.nullif(sd, F.lit(0.0))
    tied = [(F.col("tie") > 0).alias("tied")] if ties else []
    return out.select(*family, "n1", "n2", "u", (F.col("u") * 2 / (n1 * n2) - 1).alias("delta"), z.alias("z"), *tied)


def normal_p(df: DataFrame, z: str = "z", out: str = "p_value") -> DataFrame:
    """Two-sided p-values of standard normal z; 1 where there is none."""

    @F.pandas_udf("double")
    def p(s: pd.Series) -> pd.Series:
        return s.map(lambda x: 1.0 if pd.isna(x) else min(1.0, math.erfc(max(x, 0.0) / math.sqrt(2))))

    return df.withColumn(out, p(z))


def kruskal(df: DataFrame, family: list[str], value: str, group: str) -> DataFrame:
    """H with tie correction, groups, n and epsilon squared; constant data have H 0."""
    r = value_ranks(df, family, value, group)
    per = r.groupBy(*family, group).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum(F.col("n") * (F.col("ties").cast("double") * F.col("ties") - 1)).alias("tie"))
    out = per.groupBy(*family).agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("tie").alias("tie"))
    n = F.col("n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("s") - F.lit(3.0) * (n + 1)
    c = F.lit(1.0) - F.col("tie") / (n * n * n - n)
    out = out.where("k > 1").withColumn("h", F.when(c > 0, h / c).otherwise(F.lit(0.0)))
    return out.select(*family, "k", "n", "h", (F.col("h") * (n + 1) / (n * n - 1)).alias("epsilon_squared"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Pearson's chi-square without correction, degrees of freedom, n and Cramer's V, from counts. Empty cells count by
    their expectation: sum of o^2/e less n."""
    o = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).cast("double").alias("o"))
    r, c = o.groupBy(row).agg(F.sum("o").alias("r")), o.groupBy(column).agg(F.sum("o").alias("c"))
    cells = o.join(r, row).join(c, column)
    out = cells.agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.sum("o").alias("n"), F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("cols"))
    out = out.withColumn("chi2", F.col("n") * (F.col("s") - F.lit(1.0)))
    return out.select("chi2", ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"), F.col("n").cast("long").alias("n"), F.sqrt(F.greatest(F.lit(0.0), F.col("chi2")) / (F.col("n") * F.least(F.col("rows") - 1, F.col("cols") - 1))).alias("cramers_v"))


def chi_square_p(df: DataFrame, statistic: str = "chi2", dof: str = "dof", out: str = "p_value") -> DataFrame:
    """Upper tail of the chi-square distribution by the incomplete gamma function's series or continued fraction."""

    def upper(x: float, k: float) -> float:
        a, x = k / 2, x / 2
        if x <= 0:
            return 1.0
        front = math.exp(-x + a * math.log(x) - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= x / n
                total += term
            return max(0.0, 1 - total * front)
        b, c = x + 1 - a, 1e300
        d = h = 1 / b
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * h

    @F.pandas_udf("double")
    def p(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([upper(x, n) for x, n in zip(s, k)])

    return df.withColumn(out, p(F.col(statistic), F.col(dof).cast("double")))


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p_value", out: str = "p_adjusted", tie: list[str] | None = None) -> DataFrame:
    """False-discovery-rate adjusted p-values within each family; null stays null."""
    clean = F.when(F.col(p).isNotNull() & ~F.isnan(p), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p).cast("double"))))
    have, none = df.withColumn("__p", clean).where("__p is not null"), df.withColumn("__p", clean).where("__p is null")
    counts = have.groupBy(*family, "__p").agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, family, [F.col("__p").asc()], "__n", "__rank")
    sizes = counts.groupBy(*family).agg(F.sum("__n").alias("__m"))
    scaled = ranked.join(sizes, same(ranked, sizes, family)).select(*[ranked[c] for c in ranked.columns], (F.col("__p") * F.col("__m") / F.col("__rank")).alias("__q"))
    best = running(scaled, family, [F.col("__p").desc()], "__q", "__best", F.min)
    met = have.join(best, same(have, best, [*family, "__p"]))
    adjusted = met.select(*[have[c] for c in df.columns], F.least(F.lit(1.0), F.col("__best")).alias(out))
    return adjusted.unionByName(none.withColumn(out, F.lit(None).cast("double")).drop("__p"))


def _z(level: float) -> float:
    return NormalDist().inv_cdf((1 + level) / 2)


def median_interval(df: DataFrame, group: list[str], value: str, level: float = 0.95) -> DataFrame:
    """n, the median of each group and the interval between two of its order statistics that holds the population's median
    with the given probability at least about: ranks (n -/+ z sqrt(n)) / 2, outwards. All values count, by distinct value."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(*group, v.alias("v")).agg(F.count(F.lit(1)).alias("m"))
    run = running(counts, group, [F.col("v").asc()], "m", "cum")
    sizes = run.groupBy(*group).agg(F.max("cum").alias("n"))
    ranked, n = match(run, sizes, group), F.col("n")
    reach = F.lit(_z(level)) * F.sqrt(n.cast("double"))
    ranks = {"low": F.floor((n + 1) / F.lit(2)), "high": F.floor(n / F.lit(2)) + 1}
    ranks |= {"ci_low": F.greatest(F.lit(1), F.floor((n - reach) / 2)), "ci_high": F.least(n, F.ceil((n + reach) / 2) + 1)}
    out = ranked.groupBy(*group, "n").agg(*[F.min(F.when(F.col("cum") >= k, F.col("v"))).alias(name) for name, k in ranks.items()])
    return out.select(*group, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "ci_low", "ci_high")


def delta_interval(df: DataFrame, family: list[str], value: str, group: str, first: str, second: str, level: float = 0.95) -> DataFrame:
    """Cliff's delta of each family with its interval, by the unbiased variance over all pairs and the asymmetric limits. A
    value's pairs are counted from running sums by distinct value, so that no pairs are made; both groups have two rows at
    least."""
    some = df.where(F.col(group).isin(first, second))
    own = value_ranks(some, family, value, group)
    own = running(own.withColumnRenamed("rank", "pooled"), [*family, group], [F.col("v").asc()], "n", "cum")
    # rows of the other group below the value, and equal to it
    own = own.withColumn("below", F.col("pooled") - (F.col("ties") + 1) / F.lit(2.0) - (F.col("cum") - F.col("n"))).withColumn("equal", F.col("ties") - F.col("n"))
    one = F.col(group) == first
    sizes = own.groupBy(*family).agg(F.sum(F.when(one, F.col("n"))).cast("double").alias("n1"), F.sum(F.when(~one, F.col("n"))).cast("double").alias("n2"))
    rows = match(own, sizes.where("n1 >= 2 AND n2 >= 2"), family)
    other = F.when(one, F.col("n2")).otherwise(F.col("n1"))
    rows = rows.withColumn("d", (F.col("below") * 2 + F.col("equal") - other) / other)
    n, d = F.col("n"), F.col("d")
    sums = rows.groupBy(*family, "n1", "n2").agg(
        F.sum(F.when(one, n * d)).alias("s1"), F.sum(F.when(one, n * d * d)).alias("q1"), F.sum(F.when(~one, n * d)).alias("s2"), F.sum(F.when(~one, n * d * d)).alias("q2"),
        F.sum(F.when(one, n * F.col("equal"))).alias("even"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    sums = sums.withColumn("delta", F.col("s1") / n1)
    delta = F.col("delta")
    # sums of squares about delta: of rows of either group (the second's mean is -delta), and of all pairs (-1, 0 or 1)
    rows_1, rows_2 = F.col("q1") - n1 * delta * delta, F.col("q2") - n2 * delta * delta
    pairs = n1 * n2 - F.col("even") - n1 * n2 * delta * delta
    variance = (n2 * n2 * rows_1 + n1 * n1 * rows_2 - pairs) / (n1 * n2 * (n1 - 1) * (n2 - 1))
    sums = sums.withColumn("var", F.greatest(variance, (F.lit(1.0) - delta * delta) / (n1 * n2 - 1)))
    z = _z(level)
    reach = F.lit(z) * F.sqrt("var") * F.sqrt(F.pow(F.lit(1.0) - delta * delta, F.lit(2.0)) + F.lit(z * z) * F.col("var"))
    base, centre = F.lit(1.0) - delta * delta + F.lit(z * z) * F.col("var"), delta - delta * delta * delta
    least = F.least(n1, n2)
    edge = (least - F.lit(z * z)) / (least + F.lit(z * z))  # groups that don't overlap
    low = F.when(delta >= 1, edge).when(delta <= -1, F.lit(-1.0)).otherwise((centre - reach) / base)
    high = F.when(delta <= -1, -edge).when(delta >= 1, F.lit(1.0)).otherwise((centre + reach) / base)
    return sums.select(*family, "delta", F.greatest(F.lit(-1.0), low).alias("ci_low"), F.least(F.lit(1.0), high).alias("ci_high"))


#: A sample this small, without ties, gets its p-value from the exact distribution of U.
EXACT = 8


def u_tail(n1: int, n2: int, u: float) -> float:
    """The share of all orders of n1 and n2 distinct values whose U is u or more. The numbers of orders by U are the
    coefficients of the Gaussian binomial; a factor (1 - x^(n + i)) / (1 - x^i) at a time is exact in whole numbers."""
    k, n = min(n1, n2), max(n1, n2)
    ways = [1] + [0] * (k * n)
    for i in range(1, k + 1):
        for at in range(k * n, n + i - 1, -1):
            ways[at] -= ways[at - n - i]
        for at in range(i, k * n + 1):
            ways[at] += ways[at - i]
    return sum(ways[math.ceil(u) :]) / math.comb(n1 + n2, k)


def mann_whitney_p(df: DataFrame, out: str = "p_value") -> DataFrame:
    """Two-sided p-values of mann_whitney(..., ties=True): exact where a group has EXACT rows at most, the other 2000 at most
    (beyond which the counts are long and the normal form is close), and no value is tied; else normal."""

    @F.pandas_udf("double")
    def p(n1: pd.Series, n2: pd.Series, u: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
        def one(a, b, x, t, s):
            if not t and min(a, b) <= EXACT and max(a, b) <= 2000:
                return min(1.0, 2 * u_tail(int(a), int(b), max(x, a * b - x)))
            return 1.0 if pd.isna(s) else min(1.0, math.erfc(max(s, 0.0) / math.sqrt(2)))

        return pd.Series([one(*row) for row in zip(n1, n2, u, tied, z)], dtype="float64")

    return df.withColumn(out, p("n1", "n2", "u", "tied", "z"))
