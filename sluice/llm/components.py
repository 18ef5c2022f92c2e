"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table_files, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b). Large: each node's larger neighbours move to its least neighbour or itself; small: its
    smaller neighbours and itself do."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        moved = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node that links reach.

    Each round is written to the shared folder, so a lost executor costs one round at most. The rounds needed grow with
    the logarithm of the longest path; the edge count never grows. Self-loops and nulls are left out.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        after = materialize(_stars(_stars(now, True), False), "edges")
        mark = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))).first()
        drop_table_files(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
