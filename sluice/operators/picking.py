"""Choice of a stratum's rows with the smallest hashes, up to a quota. Histograms of the hash find the threshold, so that no
stratum is sorted or gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from .ranks import match

#: Hexadecimal digits of a level of the histogram: 4096 bins. Two levels leave a 16-millionth of a stratum to be ranked.
DIGITS = 3


def priority(seed, *parts) -> Column:
    """SHA-256 of NUL-joined parts as hex; its order is that of the number."""
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def _edge(rows: DataFrame, strata: list[str], bin_: str, need: str) -> DataFrame:
    """Per stratum the first bin in which the rows, counted from the lowest, reach the need, and the need left for it."""
    counts = rows.groupBy(*strata, bin_).agg(F.count(F.lit(1)).alias("n"), F.first(need).alias("need"))
    run = F.sum("n").over(W.partitionBy(*strata).orderBy(bin_).rowsBetween(W.unboundedPreceding, 0))
    edge = counts.withColumn("run", run).where("run >= need AND run - n < need")
    return edge.select(*strata, F.col(bin_).alias("edge"), (F.col("need") - F.col("run") + F.col("n")).alias("left"))


def _at_edge(rows: DataFrame, edges: DataFrame, strata: list[str], bin_: str) -> DataFrame:
    """The rows of the edge bins, with the need that is left."""
    met = match(rows, edges.withColumnRenamed("edge", bin_), [*strata, bin_])
    return met.drop("need").withColumnRenamed("left", "need")


def thresholds(df: DataFrame, strata: list[str], quotas: DataFrame, quota: str, id_col: str, seed) -> DataFrame:
    """Per stratum whose rows exceed its quota (above 0), the hash and id of the last row that the quota covers: `last`."""
    hashed = df.select(*strata, F.col(id_col).alias("id"), priority(seed, id_col).alias("hash"))
    rows = match(hashed, quotas.where(F.col(quota) > 0).select(*strata, F.col(quota).cast("long").alias("need")), strata)
    for level in range(2):
        rows = rows.withColumn("bin", F.substring("hash", 1 + level * DIGITS, DIGITS))
        rows = _at_edge(rows, written(_edge(rows, strata, "bin", "need"), "edges"), strata, "bin").drop("bin")
    turn = F.row_number().over(W.partitionBy(*strata).orderBy("hash", "id"))
    return rows.withColumn("turn", turn).where("turn = need").select(*strata, F.struct("hash", "id").alias("last"))


def pick(df: DataFrame, strata: list[str], quotas: DataFrame, quota: str, id_col: str, seed=42) -> DataFrame:
    """df with `picked`: whether the row is among the quota's smallest priorities of its stratum. id_col is unique."""
    last = written(thresholds(df, strata, quotas, quota, id_col, seed), "thresholds")
    both = match(quotas.select(*strata, F.col(quota).alias("__quota")), last.withColumnRenamed("last", "__last"), strata, "left")
    met = match(df, both, strata, "left")
    inside = F.col("__last").isNull() | (F.struct(priority(seed, id_col).alias("hash"), F.col(id_col).alias("id")) <= F.col("__last"))
    return met.select(*df.columns, (F.coalesce(F.col("__quota"), F.lit(0)) > 0).__and__(inside).alias("picked"))
