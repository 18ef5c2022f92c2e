"""Running sums and minima over families of any size, by two levels: rows are dealt by range, each range is summed by itself,
and the totals of the ranges before it are added. A window covers one range of a family at most."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def match(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b's other columns by keys, where null equals null. b may come from a; its other names are new to a."""
    names = [f"__key{i}" for i in range(len(keys))]
    right = b.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in b.columns if c not in keys])
    return a.join(right, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], F.lit(True)), how).drop(*names)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys, where null equals null; true without keys."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def _dealt(df: DataFrame, family: list[str], order: list[Column]) -> DataFrame:
    """df in ranges by family and order, as a written table with the range's number."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(ranges, *[F.col(f) for f in family], *order).withColumn("__range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, family: list[str], order: list[Column], value: str, name: str, fold: Callable[[Column], Column] = F.sum) -> DataFrame:
    """df with `name`: the fold (F.sum, F.min or F.max) of `value` over the family's rows up to each, in the given order.

    Rows that are equal in family and order lie in one range; their order among each other is left open. There are as many
    ranges as the session has shuffle partitions.
    """
    dealt = _dealt(df, family, order)
    own = W.partitionBy(*family, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*family).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*family, "__range").agg(fold(F.col(value)).alias("__total"))
    # one row a range of a family
    offsets = written(totals.select(*family, "__range", fold(F.col("__total")).over(before).alias("__before")), "range-offsets")
    local = dealt.withColumn("__own", fold(F.col(value)).over(own))
    both = local.join(offsets, same(local, offsets, [*family, "__range"]), "left")
    whole = {F.sum: lambda: F.col("__own") + F.coalesce("__before", F.lit(0)), F.min: lambda: F.least("__own", "__before"), F.max: lambda: F.greatest("__own", "__before")}[fold]()
    return both.select(*[local[c] for c in df.columns], whole.alias(name))


def place(at: Column) -> Column:
    """A position from 0, with a fraction, for `quantiles`: the ranks beside it and the share of the upper one."""
    return F.struct(F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"))


def values_at(df: DataFrame, family: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(family, __rank, __v): the value at each of the ranks (family, __rank; from 0) in its family's values without nulls. Equal
    values are counted first; of the ranges only those that hold a rank are sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*family, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = _dealt(counts, family, [F.col("__v")])
    upto = W.partitionBy(*family).orderBy("__range").rowsBetween(W.unboundedPreceding, 0)
    # one row a range of a family
    totals = dealt.groupBy(*family, "__range").agg(F.sum("__n").alias("__total"))
    ends = written(totals.select(*family, F.col("__range").alias("__in"), F.sum("__total").over(upto).alias("__end"), "__total"), "range-ends")
    held = match(ranks, ends, family).where("__rank >= __end - __total AND __rank < __end")
    hit = held.groupBy(*family, F.col("__in").alias("__range")).agg(F.first("__end").alias("__end"), F.first("__total").alias("__total"), F.collect_set("__rank").alias("__ranks"))
    own = W.partitionBy(*family, "__range").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    rows = match(dealt, hit, [*family, "__range"]).withColumn("__run", F.col("__end") - F.col("__total") + F.sum("__n").over(own))
    here = rows.select(*family, "__v", F.explode(F.filter("__ranks", lambda r: (r < F.col("__run")) & (r >= F.col("__run") - F.col("__n")))).alias("__rank"))
    return here.select(*family, "__rank", "__v")


def quantiles(df: DataFrame, family: list[str], value: str, at: DataFrame) -> DataFrame:
    """`at` (one row a family; its other columns are places, or null) with the exact values there, in proportion between the two
    ranks beside a place. No family lies in one task, and none is held in a buffer."""
    names = [c for c in at.columns if c not in family]
    ranks = F.array_distinct(F.array_compact(F.flatten(F.array(*[F.array(f"{c}.low", f"{c}.high") for c in names]))))
    found = values_at(df, family, value, at.select(*family, F.explode(ranks).alias("__rank")))
    # a few ranks a family
    held = found.groupBy(*family).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__held"))
    both = match(at, held, family, "left")

    def between(c: str) -> Column:
        low, high, part = F.col("__held")[F.col(f"{c}.low")], F.col("__held")[F.col(f"{c}.high")], F.col(f"{c}.part")
        return F.when(low == high, low).otherwise((F.lit(1.0) - part) * low + part * high).alias(c)

    return both.select(*family, *map(between, names))
