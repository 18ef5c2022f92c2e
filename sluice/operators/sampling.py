"""Deterministic sampling: a row's place is the hash of seed and key, so it depends on no order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .picking import pick, priority
from .ranks import running


def cut_points(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Values that end a quantile without splitting equal ones; the largest value ends none. Rows (cut)."""
    counts = df.groupBy(F.greatest(F.lit(0), F.col(value)).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = running(counts, [], [F.col("v").asc()], "n", "cum")
    total, top = run.agg(F.max("cum"), F.max("v")).first()
    at = run.where(F.col("v") < F.lit(top)).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(buckets - 1))))
    at = at.where(F.col("cum") >= F.lit(total) * F.col("i") / F.lit(float(buckets)))
    return at.groupBy("i").agg(F.min("v").alias("cut")).select("cut").distinct()


def assign_bucket(value: Column, cuts: list[int], prefix: str = "pop") -> Column:
    """The number of cuts below the value."""
    if not cuts:
        return F.lit(f"{prefix}0")
    return F.concat(F.lit(prefix), F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)).cast("string"))


def proportional_quotas(strata: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """Largest remainder: the floor of each stratum's share, the rest to the largest remainders, ties by key."""
    total = F.sum(size).over(W.partitionBy())
    exact = F.col(size).cast("double") * target / total
    out = strata.withColumn("__base", F.floor(exact)).withColumn("__rest", exact - F.floor(exact))
    left = F.lit(target) - F.sum("__base").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc("__rest"), key))
    out = out.withColumn("quota", F.col("__base") + F.when(rank <= left, 1).otherwise(0))
    return out.withColumn("quota", F.least("quota", F.col(size))).drop("__base", "__rest")


def allocate(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Quotas proportional to sizes and capped by them; a cap's surplus goes on by remainder in turn. For stratum counts."""
    sizes = {k: max(0, int(v)) for k, v in sizes.items()}
    total = sum(sizes.values())
    if target <= 0:
        return dict.fromkeys(sizes, 0)
    if total <= target:
        return sizes
    exact = {k: v * target / total for k, v in sizes.items()}
    out = {k: min(sizes[k], int(x)) for k, x in exact.items()}
    order = sorted((k for k in sizes if sizes[k]), key=lambda k: (exact[k] - out[k], k), reverse=True)
    while (left := target - sum(out.values())) > 0:
        for k in [k for k in order if out[k] < sizes[k]][:left]:
            out[k] += 1
    return out


def even_quotas(labels: list[str], target: int) -> dict[str, int]:
    return {x: target // len(labels) + (i < target % len(labels)) for i, x in enumerate(labels)} if labels and target > 0 else {}


def blended_weights(strata: DataFrame, dims: list[str], size: str, alpha: float) -> DataFrame:
    """The product over dims of (1 - alpha) times the observed share plus alpha times an even one."""
    total, weight, out = F.sum(size).over(W.partitionBy()), F.lit(1.0), strata
    for d in dims:
        share = F.sum(size).over(W.partitionBy(d)) / total
        k = F.size(F.collect_set(d).over(W.partitionBy()))
        weight = weight * (F.lit(1 - alpha) * share + F.lit(alpha) / k)
    return out.withColumn("weight", weight)


def sample_by_quota(df: DataFrame, strata: list[str], quotas: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Of each stratum the rows with the smallest priority, up to its quota."""
    return pick(df, strata, quotas, "quota", id_col, seed).where("picked").drop("picked")


def stratified_sample(df: DataFrame, strata: list[str], target: int, id_col: str, seed: int = 42) -> DataFrame:
    """Proportional to the strata's sizes. Only their counts go to the driver."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).collect()
    keyed = {"\x1f".join(str(r[s]) for s in strata): r for r in sizes}
    quota = allocate({k: r.n for k, r in keyed.items()}, target)
    spark = df.sparkSession
    rows = [(*[keyed[k][s] for s in strata], q) for k, q in quota.items() if q]
    schema = df.select(*strata).schema.add("quota", "long")
    return sample_by_quota(df, strata, spark.createDataFrame(rows, schema), id_col, seed)


def bottom_k(df: DataFrame, strata: list[str], k: int, id_col: str, seed: int = 42) -> DataFrame:
    """A uniform sample of k rows a stratum; the limit is pushed below the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*strata).orderBy(priority(seed, id_col), id_col))).where(F.col("rank") <= k)


def train_test_split(df: DataFrame, strata: list[str], fraction: float, id_col: str, seed: int = 42) -> DataFrame:
    """split is test for the first floor(n * fraction) rows of a stratum by priority, 1 at least and n - 1 at most."""
    n = F.col("n")
    k = F.when(n < 2, 0).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(fraction)))))
    quotas = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).select(*strata, k.alias("quota"))
    return pick(df, strata, quotas, "quota", id_col, seed).withColumn("split", F.when(F.col("picked"), "test").otherwise("train")).drop("picked")


def quota_by_hour(df: DataFrame, ts: str, quota: int, id_col: str, seed: int = 42) -> DataFrame:
    return bottom_k(df.withColumn("hour", F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")), ["hour"], quota, id_col, seed)


def spread_indices(n: int, k: int) -> list[int]:
    """k of n slots, evenly spaced."""
    return [i * n // k for i in range(k)] if k > 0 else []
