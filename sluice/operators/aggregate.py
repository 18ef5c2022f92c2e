"""Scopes, shares, summaries and series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from .ranks import match, place, quantiles


def scope_counts(df: DataFrame, dims: list[str], measures: list[Column]) -> DataFrame:
    """Measures overall and by each dim alone, in one aggregation by grouping sets: rows (scope, label, measures...)."""
    view = df.select(*[F.col(d).cast("string").alias(d) for d in dims], *[c for c in df.columns if c not in dims])
    sets = view.groupingSets([[], *[[F.col(d)] for d in dims]], *[F.col(d) for d in dims]).agg(*measures, F.grouping_id(*dims).alias("__g"))
    n = len(dims)
    scope, label = F.lit("overall"), F.lit("overall")
    for i, d in enumerate(dims):
        mine = F.col("__g") == (1 << n) - 1 - (1 << (n - 1 - i))
        scope, label = F.when(mine, d).otherwise(scope), F.when(mine, F.col(d)).otherwise(label)
    return sets.select(scope.alias("scope"), label.alias("label"), *[c for c in sets.columns if c not in dims and c != "__g"])


def label_share(df: DataFrame, group: list[str], label: str, scale: float = 1.0) -> DataFrame:
    """Counts by label with their share of the group, times scale."""
    n = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*group)) * F.lit(scale))


def dense_counts(df: DataFrame, group: list[str], label: str, labels: list[str]) -> DataFrame:
    """Counts for every one of the labels in each group, 0 where there is none: one pass, no label table."""
    counts = df.groupBy(*group).agg(*[F.count_if(F.col(label) == x).alias(f"__{i}") for i, x in enumerate(labels)])
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"__{i}").alias("n")) for i, x in enumerate(labels)]))
    return counts.select(*group, pairs.alias("p")).select(*group, F.col("p.label").alias(label), F.col("p.n").alias("n"))


def top_n(df: DataFrame, group: list[str], label: str, n: int = 5) -> DataFrame:
    """The n most frequent labels of each group by (count desc, label), with rank and share of the group."""
    counts = label_share(df, group, label)
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), F.asc(label)))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def distribution_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, median, median of the nonzero, zeros and their percentage, min, max, quartiles and their range."""
    rows = df.select(*group, F.col(value).cast("double").alias("__v")).where("__v is not null")
    v = F.col("__v")
    out = written(rows.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.count_if(v == 0).alias("zero_count"), F.count_if(v < 0).alias("__below"), F.min(v).alias("min"), F.max(v).alias("max")), "summary")
    last = F.col("n") - 1
    # ranks of the nonzero values are ranks of all of them, past the zeros from the first positive one on
    mid = (last - F.col("zero_count")) / F.lit(2.0)
    past = lambda r: r + F.when(r < F.col("__below"), 0).otherwise(F.col("zero_count"))
    nonzero = F.when(mid >= 0, F.struct(past(F.floor(mid)).alias("low"), past(F.ceil(mid)).alias("high"), (mid - F.floor(mid)).alias("part")))
    places = [place(last * F.lit(x)).alias(name) for x, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    out = match(out, quantiles(rows, group, "__v", out.select(*group, *places, nonzero.alias("median_nonzero"))), group)
    return out.select(*group, "n", "mean", "median", "median_nonzero", "zero_count", (F.col("zero_count") * F.lit(100.0) / F.col("n")).alias("zero_percentage"), "min", "max", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def mean_interval(df: DataFrame, group: list[str], value: str, nonnegative: bool = True) -> DataFrame:
    """n, mean and the normal 95 % interval of the mean; the lower end is 0 at least for values that can't be negative."""
    v = F.col(value).cast("double")
    out = df.where(v.isNotNull()).groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("__s"))
    half = F.when(F.col("n") > 1, F.lit(1.96) * F.col("__s") / F.sqrt("n")).otherwise(F.lit(0.0))
    low = F.col("mean") - half
    return out.select(*group, "n", "mean", (F.greatest(F.lit(0.0), low) if nonnegative else low).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def retention(df: DataFrame, group: list[str], day: str) -> DataFrame:
    """Counts of a series by day with the first day's count as baseline and the share that is left."""
    n = df.groupBy(*group, day).agg(F.count(F.lit(1)).alias("n"))
    base = F.first("n").over(W.partitionBy(*group).orderBy(day).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return n.withColumn("baseline", base).withColumn("retained", F.col("n") / F.col("baseline"))


def cumulative(df: DataFrame, group: list[str], order: str, value: str, out: str = "running") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def reliable_cumulative(df: DataFrame, group: list[str], order: str, value: str, reliable: str) -> DataFrame:
    """The running sum, null from the first unreliable row on."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("running", F.when(F.bool_and(reliable).over(w), F.sum(value).over(w)))


def crosstab(df: DataFrame, row: str, column: str, labels: list[str]) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == x).alias(x) for x in labels])


def long_values(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Rows (keys, metric, value) of the metrics that are not null."""
    return df.unpivot(keys, metrics, "metric", "value").where("value is not null")


def line_duplication(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines, repeated lines (occurrences beyond the first) and their percentage, per key; lines trimmed, blanks dropped.

    Lines are counted by (key, line) first, so a hot key is spread and summed from its partial counts."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("l")).select(key, F.trim(F.regexp_replace("l", r"[ \t]+", " ")).alias("line")).where("line != ''")
    per = lines.groupBy(key, "line").agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy(key).agg(F.sum("c").alias("lines"), F.sum(F.col("c") - 1).alias("duplicated"))
    return out.withColumn("density", F.col("duplicated") * F.lit(100.0) / F.col("lines"))


def capped_limits(df: DataFrame, value: str, low: float = 1.0, high: float = 99.0, from_zero: bool = True) -> DataFrame:
    """Limits of an axis from the low and high percentiles, a little wider, with the values that fall outside. Values that are
    none negative start at 0, if from_zero; without a finite value there is no row."""
    v = F.col(value).cast("double")
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(v.alias("v"))
    least, most, n = finite.agg(F.min("v"), F.max("v"), F.count("v")).first()
    kind = "lower double, upper double, below_count long, above_count long, total_count long, is_clipped boolean"
    if not n:
        return df.sparkSession.createDataFrame([], kind)
    at = df.sparkSession.range(1).select(*[place(F.lit((n - 1) * (p / 100))).alias(name) for p, name in ((low, "low"), (high, "high"))])
    q = quantiles(finite, [], "v", at).first()
    zero = from_zero and least >= 0
    lower, upper = (0.0 if zero else q[0]), (0.0 if not zero and most <= 0 else q[1])
    pad = (upper - lower) * 0.06 if upper != lower else max(abs(lower) * 0.08, 0.05)
    lower, upper = (0.0 if zero else lower - pad), upper + pad
    below, above = F.count_if(F.col("v") < lower), F.count_if(F.col("v") > upper)
    return finite.agg(F.lit(lower).alias("lower"), F.lit(upper).alias("upper"), below.alias("below_count"), above.alias("above_count"), F.count("v").alias("total_count"), (below + above > 0).alias("is_clipped"))


def labels_by_share(df: DataFrame, group: str, label: str, share: str, labels: list[str]) -> DataFrame:
    """The labels by their mean share over all groups, a group without a label counting 0; ties in the given order."""
    groups = df.select(group).distinct().count()
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(label))
    out = df.where(F.col(label).isin(*labels)).groupBy(label).agg((F.sum(F.col(share).cast("double")) / F.lit(float(max(groups, 1)))).alias("mean_share"))
    all_labels = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string").join(out, label, "left")
    return all_labels.withColumn("mean_share", F.coalesce("mean_share", F.lit(0.0))).withColumn("position", F.row_number().over(W.orderBy(F.desc("mean_share"), place)))


def numeric_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    rows = df.select(*group, F.col(value).cast("double").alias("__v"))
    out = written(rows.groupBy(*group).agg(F.count("__v").alias("n"), F.min("__v").alias("min"), F.avg("__v").alias("mean"), F.max("__v").alias("max")), "summary")
    mid = F.when(F.col("n") > 0, place((F.col("n") - 1) * F.lit(0.5)))
    return match(out, quantiles(rows, group, "__v", out.select(*group, mid.alias("median"))), group).select(*group, "n", "min", "median", "mean", "max")


def balance(df: DataFrame, dim: str) -> DataFrame:
    """How even the counts of dim's labels are: min, max, mean, population deviation, variation and chi-square."""
    n = df.groupBy(dim).agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = n.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.count("n").alias("k"))
    return out.select("min", "max", "mean", "std", (F.col("std") / F.col("mean")).alias("cv"), (F.col("k") * F.col("std") * F.col("std") / F.col("mean")).alias("chi2"))


def lift_segments(shares: list[float], least: float = 6.0) -> list[float]:
    """Heights that sum to 100 in proportion to the shares, none that is not zero below `least`."""
    live = [i for i, x in enumerate(shares) if x > 0]
    if least * len(live) >= 100:
        return [100.0 / len(live) if x > 0 else 0.0 for x in shares]
    out = [0.0] * len(shares)
    space = 100.0
    while live:
        scale = space / sum(shares[i] for i in live)
        low = [i for i in live if shares[i] * scale < least]
        if not low:
            for i in live:
                out[i] = shares[i] * scale
            break
        for i in low:
            out[i] = least
        space -= least * len(low)
        live = [i for i in live if i not in low]
    return out


def lifted_shares(df: DataFrame, group: list[str], label: str, n: str, least: float = 6.0) -> DataFrame:
    """Adds the share (0 to 100) and its lifted height; labels of a group are few, so a group is an array."""
    @F.pandas_udf("array<double>")
    def lift(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: lift_segments(list(xs), least))

    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(label, n))).alias("__r"), F.sum(n).alias("__t"))
    g = g.withColumn("__s", F.transform("__r", lambda x: x[n] * F.lit(100.0) / F.col("__t"))).withColumn("__h", lift("__s"))
    rows = g.select(*group, F.explode(F.arrays_zip("__r", "__s", "__h")).alias("z"))
    return rows.select(*group, F.col(f"z.__r.{label}").alias(label), F.col(f"z.__r.{n}").alias(n), F.col("z.__s").alias("share"), F.col("z.__h").alias("height"))
