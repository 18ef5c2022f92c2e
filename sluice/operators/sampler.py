"""The stratified sampler: even language quotas, soft-balanced strata within a language, and a pass that spills what
languages can't fill over the remaining strata. Allocation runs over the strata's counts; rows are chosen by the smallest
hashes of their stratum, up to a threshold that histograms of the hash find, so that no stratum is sorted or gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from .picking import pick
from .sampling import even_quotas


def water_fill(strata: DataFrame, group: list[str], need: str, room: str, order: list[Column], out: str) -> DataFrame:
    """strata with `out`: `need` units of each group dealt in turn to its strata, one a round, until their room is used.

    In closed form: with the rooms ascending, all strata are full up to the last room that the need covers; the others get
    equal shares, and the rest goes one each to the first of them in the given order.
    """
    by_room, whole = W.partitionBy(*group).orderBy(room, *order), W.partitionBy(*group)
    up_to = by_room.rowsBetween(W.unboundedPreceding, 0)
    more = F.count(F.lit(1)).over(whole) - F.row_number().over(by_room)
    # what is dealt once every stratum has this one's room or all of its own
    ranked = strata.withColumn("__dealt", F.sum(room).over(up_to) + F.col(room) * more).withColumn("__more", more)
    fits = F.when(F.col("__dealt") <= F.col(need), F.struct(F.col("__dealt").alias("dealt"), F.col(room).alias("room"), F.col("__more").alias("more")))
    full = F.max(fits).over(whole)
    level = F.coalesce(full["room"], F.lit(0))
    left = F.col(need) - F.coalesce(full["dealt"], F.lit(0))
    open_ = F.col(room) > level
    ranked = ranked.withColumn("__level", level).withColumn("__left", left).withColumn("__open", open_)
    sharers = F.sum(F.col("__open").cast("long")).over(whole)
    turn = F.row_number().over(W.partitionBy(*group, "__open").orderBy(*order))
    share = F.expr("__left div greatest(__sharers, 1L)")
    ranked = ranked.withColumn("__sharers", sharers).withColumn("__turn", turn)
    got = F.col("__level") + share + F.when(F.col("__turn") <= F.col("__left") - share * F.col("__sharers"), 1).otherwise(0)
    ranked = ranked.withColumn(out, F.when(F.col("__open"), got).otherwise(F.col(room)))
    return ranked.drop("__dealt", "__more", "__level", "__left", "__open", "__sharers", "__turn")


def deal(strata: DataFrame, group: list[str], size: str, weight: str, target: str, order: list[Column], out: str) -> DataFrame:
    """strata with `out`: each group's target by weighted shares, rounded down and capped by the sizes; what is left goes by
    water_fill, the largest remainders first."""
    whole = W.partitionBy(*group)
    total, weights = F.sum(size).over(whole), F.sum(weight).over(whole)
    exact = F.when(weights > 0, F.col(weight) / weights).otherwise(F.col(size) / total) * F.col(target)
    base = F.when(total <= F.col(target), F.col(size)).otherwise(F.least(F.floor(exact), F.col(size)))
    some = strata.withColumn("__base", base).withColumn("__rest", exact - F.col("__base")).withColumn("__room", F.col(size) - F.col("__base"))
    need = F.least(F.col(target), total) - F.sum("__base").over(whole)
    filled = water_fill(some.withColumn("__need", need), group, "__need", "__room", [F.desc("__rest"), *order], "__extra")
    return filled.withColumn(out, F.col("__base") + F.col("__extra")).drop("__base", "__rest", "__room", "__need", "__extra")


def balance_weights(strata: DataFrame, group: str, size: str, alphas: dict[str, float]) -> Column:
    """Within each group the product over the dimensions of (1 - alpha) times the observed share plus alpha times an even one."""
    weight, total = F.lit(1.0), F.sum(size).over(W.partitionBy(group))
    for d, alpha in alphas.items():
        share = F.sum(size).over(W.partitionBy(group, d)) / total
        kinds = F.size(F.collect_set(d).over(W.partitionBy(group)))
        weight = weight * (F.lit(1.0 - alpha) * share + F.lit(alpha) / kinds)
    return weight


def allocate(sizes: DataFrame, language: str, dims: list[str], size: str, labels: list[str], target: int, alphas: dict[str, float], spill: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the strata with `take`, the spill strata with `extra`). A language that has too few rows takes all it has; its deficit
    is dealt over the strata by `spill` of all rows that are not taken, by their sizes. Sizes of dims may not be null."""
    order = [F.col(d) for d in dims]
    quota = F.lit(0)
    for x, n in even_quotas(labels, target).items():
        quota = F.when(F.col(language) == x, n).otherwise(quota)
    soft = any(alphas.values())
    weighted = sizes.withColumn("__w", balance_weights(sizes, language, size, alphas) if soft else F.col(size).cast("double"))
    first = deal(weighted.withColumn("__quota", quota.cast("long")), [language], size, "__w", "__quota", order, "take").drop("__w", "__quota")
    first = written(first, "allocation")
    need = target - (first.agg(F.sum("take")).first()[0] or 0)
    rest = first.groupBy(*spill).agg(F.sum(F.col(size) - F.col("take")).alias("size")).withColumn("__w", F.col("size").cast("double")).withColumn("__need", F.lit(need).cast("long"))
    extra = deal(rest.withColumn("__all", F.lit(0)), ["__all"], "size", "__w", "__need", [F.col(d) for d in spill], "extra")
    return first, extra.select(*spill, "extra")


def sample(df: DataFrame, language: str, dims: list[str], labels: list[str], target: int, id_col: str, alphas: dict[str, float] | None = None, spill: list[str] | None = None, seed: int = 42) -> DataFrame:
    """The sample, with `pass`: 1 by language quota, 2 by the spill; 0 if the table has no more rows than the target.

    Strata are language and dims; a null dimension is a stratum `unknown`. alphas weigh dimensions towards even shares. The
    spill runs over dims, or over the columns named.
    """
    df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in [language, *dims]})
    sizes = written(df.groupBy(language, *dims).agg(F.count(F.lit(1)).alias("n")), "strata")
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= target:
        return df.withColumn("pass", F.lit(0))
    spill = spill or dims
    take, extra = allocate(sizes, language, dims, "n", labels, target, alphas or {}, spill)
    marked = written(pick(df, [language, *dims], take, "take", id_col, seed), "first-pass")
    rest = marked.where("NOT picked").drop("picked")
    more = pick(rest, spill, extra, "extra", id_col, f"{seed}:spill").where("picked").drop("picked")
    return marked.where("picked").drop("picked").withColumn("pass", F.lit(1)).unionByName(more.withColumn("pass", F.lit(2)))


def quota_topups(candidates: DataFrame, selected: DataFrame, attempted: DataFrame, language: str, quotas: dict[str, int], target: int, id_col: str, order: list[str]) -> DataFrame:
    """Candidates that were not attempted, up to each language's deficit, in the order of the quotas and within the target."""
    have = {r[0]: r[1] for r in selected.groupBy(language).count().where(F.col(language).isin(list(quotas))).collect()}
    free, total = {}, target - selected.count()
    fresh = candidates.join(attempted.select(id_col), id_col, "left_anti")
    there = {r[0]: r[1] for r in fresh.groupBy(language).count().where(F.col(language).isin(list(quotas))).collect()}
    for x, n in quotas.items():
        free[x] = max(0, min(n - have.get(x, 0), total, there.get(x, 0)))
        total -= free[x]
    most = F.coalesce(*[F.when(F.col(language) == x, n) for x, n in free.items()], F.lit(0))
    top = max([0, *free.values()])
    # the limit is a number, so it is pushed below the shuffle
    ranked = fresh.withColumn("turn", F.row_number().over(W.partitionBy(language).orderBy(*order, id_col))).where(F.col("turn") <= top)
    return ranked.where(F.col("turn") <= most)
