"""Joins, deduplication and ranges as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: list, order: list, keep_null_keys: bool = True) -> DataFrame:
    """The first row of each key in the given order. Rows with a null in the key are not deduplicated, if kept at all."""
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    null = F.lit(False)
    for c in cols:
        null = null | c.isNull()
    rn = F.row_number().over(W.partitionBy(*cols).orderBy(*order))
    kept = df.where(~null).withColumn("__rn", rn).where("__rn = 1").drop("__rn")
    return kept.unionByName(df.where(null)) if keep_null_keys else kept


def latest_rows(df: DataFrame, key: list[str], rank: list[str]) -> DataFrame:
    """The row with the greatest rank of each key, by a partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in key and c not in rank]
    top = df.groupBy(*key).agg(F.max(F.struct(*rank, *rest)).alias("__top"))
    return top.select(*[F.col(c) if c in key else F.col(f"__top.{c}").alias(c) for c in df.columns])


def fallback_join(left: DataFrame, right: DataFrame, first: list[str], second: list[str], values: list[str]) -> DataFrame:
    """Left join on the first keys; rows without a match are joined on the second. right has one row of each key."""
    a = right.select(*first, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(True).alias("__hit"))
    b = right.select(*second, *[F.col(v).alias(f"__b_{v}") for v in values])
    out = left.join(a, first, "left").join(b, second, "left")
    return out.select(*left.columns, *[F.when(F.col("__hit"), F.col(f"__a_{v}")).otherwise(F.col(f"__b_{v}")).alias(v) for v in values])


def union_join(left: DataFrame, right: DataFrame, conditions: list[list[str]], id_col: str, value: str) -> DataFrame:
    """Distinct values that match on any of the key lists."""
    parts = [left.join(right.select(*keys, value), keys).select(id_col, value) for keys in conditions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str], matching: bool = True) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi" if matching else "left_anti")


def lookup_in_order(requests: DataFrame, rows: DataFrame, on: str, order: str) -> DataFrame:
    """The rows asked for, in the order of the requests."""
    return requests.select(on, order).join(rows, on).orderBy(order)


def asof_next(targets: DataFrame, events: DataFrame, by: list[str], at: str, event_at: str, value: str, out: str = "next_value", out_at: str = "next_at") -> DataFrame:
    """The earliest event after each target, strictly, without a range join: both sides share one sort by time, and
    the next event is looked up backwards in it. Of events at one time the smallest value counts."""
    e = events.groupBy(*by, F.col(event_at).alias("__t")).agg(F.min(value).alias("__v"))
    e = e.select(*by, "__t", F.lit(0).alias("__kind"), F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")).alias("__e"), F.lit(None).cast(targets.schema[at].dataType).alias("__at"))
    names = [c for c in targets.columns if c not in by]
    t = targets.select(*by, F.col(at).alias("__t"), F.lit(1).alias("__kind"), *names)
    both = t.unionByName(e.drop("__at"), allowMissingColumns=True)
    # from the last time back, targets before events of their own time: the rows before a target have later events only, and
    # a running frame is kept up in one pass, where one that ends with the partition is computed anew for each row
    back = W.partitionBy(*by).orderBy(F.desc("__t"), F.desc("__kind")).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("__n", F.last("__e", ignorenulls=True).over(back)).where("__kind = 1").select(*targets.columns, F.col("__n.t").alias(out_at), F.col("__n.v").alias(out))


def interval_overlap(left: DataFrame, right: DataFrame, by: list[str], bin_size: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of closed intervals that overlap, with the overlap's length. Both are dealt into bins; a pair counts in the
    bin where its overlap starts."""

    def binned(df: DataFrame, side: str) -> DataFrame:
        lo, hi = F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size)
        return df.select(*[F.col(c).alias(c if c in by else f"{side}_{c}") for c in df.columns], F.explode(F.sequence(lo, hi)).alias("__bin"))

    lo = F.greatest(f"left_{start}", f"right_{start}")
    hi = F.least(f"left_{end}", f"right_{end}")
    both = binned(left, "left").join(binned(right, "right"), [*by, "__bin"]).where((lo <= hi) & (F.floor(lo / bin_size) == F.col("__bin")))
    return both.withColumn("overlap", hi - lo + 1).drop("__bin")


def merge_ranges(df: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Closed ranges united where they overlap or touch (gap 1 joins neighbours). Equal ranges count once, so that start and
    end order the rows of both windows without ties, and a window's task holds distinct ranges only."""
    w = W.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.select(*by, start, end).distinct().withColumn("__new", F.when(F.col(start) <= before + gap, 0).otherwise(1))
    island = flagged.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def covered_lines(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Distinct lines that ranges cover: the merged ranges' lengths."""
    return merge_ranges(df, by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start) + 1).alias("lines"))


def before_after(df: DataFrame, key: list[str], label: str, before: str, after: str, value: str) -> DataFrame:
    """Rows of keys that have both labels, with before, after and delta. One aggregation instead of a self-join."""
    pick = [F.max(F.when(F.col(label) == x, F.col(value))).alias(n) for x, n in ((before, "before"), (after, "after"))]
    return df.where(F.col(label).isin(before, after)).groupBy(*key).agg(*pick).where("before is not null and after is not null").withColumn("delta", F.col("after") - F.col("before"))


def nearest(targets: DataFrame, pool: DataFrame, by: list[str], distance: list[Column], id_col: str) -> DataFrame:
    """For each target the pool row of the same group with the least distance tuple."""
    return first_rows(targets.join(pool, by), [id_col], distance, keep_null_keys=False)


def nearest_in_buckets(targets: DataFrame, pool: DataFrame, by: list[str], bucket: str, value: str, target_id: str, pool_id: str) -> DataFrame:
    """For each target the pool row of its group with the nearest bucket, then the nearest value, the least value and the least
    id: (target_id, pool_id, bucket, value). Only distinct buckets are paired; in a bucket, one sort each way finds the next
    value below and above, so a large group costs no pairs."""
    have = pool.select(*by, F.col(bucket).alias("__b")).distinct()
    want = targets.select(*by, F.col(bucket).alias("__t")).distinct()
    gaps = want.join(have, by).withColumn("__gap", F.abs(F.col("__b") - F.col("__t")))
    near = gaps.join(gaps.groupBy(*by, "__t").agg(F.min("__gap").alias("__gap")), [*by, "__t", "__gap"]).drop("__gap")
    t = targets.select(*by, F.col(bucket).alias("__t"), F.col(value).alias("__v"), F.col(target_id).alias("__id")).join(near, [*by, "__t"]).select(*by, "__b", "__v", "__id", F.lit(1).alias("__kind"))
    p = pool.groupBy(*by, F.col(bucket).alias("__b"), F.col(value).alias("__v")).agg(F.min(pool_id).alias("__p"))
    p = p.select(*by, "__b", "__v", F.struct(F.col("__v").alias("v"), F.col("__p").alias("p"), F.col("__b").alias("b")).alias("__c"), F.lit(0).alias("__kind"))
    both = t.unionByName(p, allowMissingColumns=True)
    w = W.partitionBy(*by, "__b")
    at = lambda order: F.last("__c", ignorenulls=True).over(w.orderBy(order, "__kind").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("__lo", at(F.asc("__v"))).withColumn("__hi", at(F.desc("__v"))).where("__kind = 1")
    c = found.select("__id", "__v", F.explode(F.array_compact(F.array("__lo", "__hi"))).alias("c"))
    best = c.groupBy("__id").agg(F.min(F.struct(F.abs(F.col("c.v") - F.col("__v")).alias("d"), F.col("c.v").alias("v"), F.col("c.p").alias("p"), F.col("c.b").alias("b"))).alias("m"))
    return best.select(F.col("__id").alias(target_id), F.col("m.p").alias(pool_id), F.col("m.b").alias(bucket), F.col("m.v").alias(value))


def read_once(df: DataFrame, target: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows none of whose keys is known to the target, each key once."""
    out = df.dropDuplicates(keys)
    for k in keys if target is not None else []:
        out = out.join(target.select(F.col(k)).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return out


def multiset_difference(left: DataFrame, right: DataFrame, key: list[str], count: str) -> DataFrame:
    """Counts of left less those of right; only positive rests."""
    signed = left.select(*key, F.col(count)).unionByName(right.select(*key, (-F.col(count)).alias(count)))
    return signed.groupBy(*key).agg(F.sum(count).alias(count)).where(F.col(count) > 0)
