"""Per-change metrics: longitudinal values, retention, overlaps and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import TIMEPOINTS
from .relational import interval_overlap, merge_ranges


def refactoring_series(df: DataFrame, key: list[str], ref_count: str, snapshots: str) -> DataFrame:
    """(key, label, metric, value) of a map label -> snapshot struct (refactoring_tool_collected, refactor_count,
    trackable, retention_rate, touched_lines, touching_commits); 0d is the baseline: all retained, nothing touched."""
    long = df.select(*key, ref_count, F.explode(snapshots).alias("label", "s")).where(F.col("label").isin(*TIMEPOINTS) & (F.col("label") != "0d"))
    pair = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    s = F.col("s")
    later = long.select(*key, "label", F.explode(F.array(
        pair("RefCount", F.when(s["refactoring_tool_collected"], s["refactor_count"])),
        pair("RefRetentionRate", F.when(s["trackable"] > 0, s["retention_rate"])),
        pair("RefZoneFutureTouchedLines", F.when(F.col(ref_count) > 0, s["touched_lines"] / F.col(ref_count))),
        pair("FutureTouchingCommits", s["touching_commits"]),
    )).alias("m"))
    first = df.where(F.col(ref_count) > 0).select(*key, F.lit("0d").alias("label"), F.explode(F.array(pair("RefCount", F.col(ref_count)), pair("RefRetentionRate", F.lit(1.0)), pair("RefZoneFutureTouchedLines", F.lit(0.0)), pair("FutureTouchingCommits", F.lit(0.0)))).alias("m"))
    out = first.unionByName(later).select(*key, "label", "m.metric", "m.value")
    return nonnegative(out.where("value is not null"))


def nonnegative(df: DataFrame, signed: list[str] | None = None) -> DataFrame:
    """Without negative values, but for the metrics that may have them."""
    return df.where((F.col("value") >= 0) | (F.col("metric").isin(*signed) if signed else F.lit(False)))


def measures(loc, cyclomatic, volume, smells, duplicated, comments) -> list[Column]:
    """NLOC, KLOC and the densities by it."""
    return [
        S._col(loc).cast("double").alias("NLOC"), S.kloc(loc).alias("KLOC"), S._col(smells).cast("double").alias("SmellCount"), S.per_kloc(smells, loc).alias("CodeSmellDensity"),
        S._col(cyclomatic).cast("double").alias("CC"), S.per_kloc(cyclomatic, loc).alias("CCDensity"), S._col(volume).cast("double").alias("HV"), S.per_kloc(volume, loc).alias("HVDensity"),
        S._col(duplicated).cast("double").alias("DuplicationDensity"), S._col(comments).cast("double").alias("CommentDensity"),
    ]


def operation_retention(file_present, element_present, expected) -> Column:
    """retained, weakly_retained, not_retained or unknown: whether an operation's file and code element are still there."""
    return (
        F.when(F.coalesce(S._col(expected), F.lit(0)) == 0, "unknown")
        .when(S._col(file_present) & S._col(element_present), "retained")
        .when(S._col(file_present), "weakly_retained")
        .otherwise("not_retained")
    )


def retention_summary(df: DataFrame, key: list[str], status: str) -> DataFrame:
    """Counts by status and the rate: the retained and weakly retained of all operations, 0 without any."""
    names = ("retained", "weakly_retained", "not_retained", "unknown")
    out = df.groupBy(*key).agg(*[F.count_if(F.col(status) == x).alias(x) for x in names], F.count(F.lit(1)).alias("total"))
    return out.withColumn("retention_rate", S.ratio(F.col("retained") + F.col("weakly_retained"), "total"))


def touched_lines(zones: DataFrame, changes: DataFrame, by: list[str], per: list[str]) -> DataFrame:
    """Distinct lines of the zones that later changes touch. Zones are merged first, so no line counts twice."""
    z = merge_ranges(zones, by)
    c = merge_ranges(changes, [*by, *per])
    out = interval_overlap(z, c, by, 64)
    return out.groupBy(*by, *[F.col(f"right_{p}").alias(p) for p in per]).agg(F.sum("overlap").alias("touched_lines"))


def file_availability(expected: DataFrame, seen: DataFrame, by: list[str], path: str, status: str) -> DataFrame:
    """complete, partial or all_missing per group, with counts of present, deleted, renamed and unknown files."""
    j = expected.select(*by, path).distinct().join(seen.select(*by, path, status), [*by, path], "left")
    s = F.coalesce(status, F.lit("unknown"))
    out = j.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), *[F.count_if(s == x).alias(x) for x in ("present", "deleted", "renamed", "unknown")])
    return out.withColumn("availability", F.when(F.col("present") == F.col("expected"), "complete").when(F.col("present") == 0, "all_missing").otherwise("partial"))


def pull_request_measures(df: DataFrame, key: str, files: str) -> DataFrame:
    """Changed lines (the totals, else the sums over files), distinct files and languages of nested file changes."""
    add, rem = _file_sum(files, "additions"), _file_sum(files, "deletions")
    return df.select(key, F.coalesce(F.col("additions") + F.col("deletions"), add + rem).alias("changed_lines"), F.size(F.array_distinct(F.transform(files, lambda f: f["path"]))).alias("files"), F.array_sort(F.array_compact(F.array_distinct(F.transform(files, lambda f: f["language"])))).alias("languages"))


def _file_sum(files: str, field: str) -> Column:
    return F.aggregate(F.col(files), F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f[field].cast("long"), F.lit(0).cast("long")))


def dominant_file_language(df: DataFrame, key: str, files: str) -> DataFrame:
    """The language with most changed lines, then most files, then by name."""
    long = df.select(key, F.explode(files).alias("f")).where("f.language is not null").groupBy(key, F.col("f.language").alias("language"))
    n = long.agg(F.sum(F.coalesce(F.col("f.additions"), F.lit(0)) + F.coalesce(F.col("f.deletions"), F.lit(0))).alias("loc"), F.count(F.lit(1)).alias("files"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("loc")).alias("l"), (-F.col("files")).alias("f"), "language")).alias("m")).select(key, F.col("m.language").alias("language"))
