"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

A source's mean repetition rate is target rows times its weight over its rows. Each document gets a uniform number from a
seeded hash of its doc_id; the Poisson distribution of its source's rate is inverted at that number, the document is
exploded by the count, and all copies are put in the order of a hash of (seed, doc_id, copy).

The keys of the global order are uniform, so the range partition of a key is known without sampling, and a hot source
spreads over all partitions. A rate above 500 is split into parts, each inverted at its own number, which sum to the
same distribution without underflow.

Defined results: null is a source of its own. A null doc_id hashes as the empty text; rows that repeat a doc_id get the
same count. A source without a weight gets weight 0, an empty table an empty result. Columns are carried as they are; an
added column whose name is taken has an underscore put after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, shuffle_partitions

#: A rate is inverted in parts of at most this mean.
PART = 500.0
#: Sources whose distributions may be broadcast: a distribution has at most 813 terms of 8 bytes, so 8 MB at most.
BROADCAST_SOURCES = 1_000


def unit_interval(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 digest of key."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, target_rows: float | None = None, source_col: str = "source") -> DataFrame:
    """Per source: its rows, its mean repetition rate, the parts of the rate and the distribution of one part.

    Without weights a source weighs its rows to the power of temperature. target_rows is the expected size of the
    mixture, by default that of docs.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    counts = materialize(counts.withColumn("w", weight), "source-counts")
    sum_w, sum_n = counts.agg(F.sum("w"), F.sum("n")).first()
    target = float(sum_n or 0) if target_rows is None else float(target_rows)
    rates = counts.withColumn("rate", F.lit(target) * F.col("w") / F.lit(float(sum_w)) / F.col("n") if sum_w else F.lit(0.0))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("mean", F.col("rate") / F.col("parts"))
    # beyond the last term the distribution's tail is under 2 ** -53, less than one step of unit_interval
    last = F.ceil(F.col("mean") + F.lit(12.0) * F.sqrt("mean") + F.lit(40.0)).cast("int")
    first = F.exp(-F.col("mean"))
    start = F.struct(F.array(first).alias("cdf"), first.alias("p"), first.alias("s"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        s = acc["s"] + p
        return F.struct(F.concat(acc["cdf"], F.array(s)).alias("cdf"), p.alias("p"), s.alias("s"))

    return rates.select("source", "n", "rate", "parts", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"]).alias("cdf"))


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, target_rows: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixture: docs' columns and copy (from 1), copies, rate, shuffle_key, in the order of shuffle_key."""
    spark = docs.sparkSession
    rates = materialize(source_rates(docs, weights, temperature, target_rows, source_col), "rates")
    small = rates.count() <= BROADCAST_SOURCES
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    if small:
        rates = F.broadcast(rates)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))

    def drawn(acc: Column, j: Column) -> Column:
        u = unit_interval(F.concat(key, F.lit(":"), j.cast("string")))
        return acc + F.size(F.filter("__cdf", lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), drawn)
    out = docs.join(rates, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__copies", copies).where(F.col("__copies") > 0)
    own = [docs[c] for c in docs.columns]
    out = out.select(*own, "__copies", "__rate", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    order = F.md5(F.concat(key, F.lit("#"), F.col("__copy").cast("string")).cast("binary"))
    out = out.withColumn("__key", order)
    n = shuffle_partitions(spark)
    slot = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * n).cast("int")
    out = out.repartitionById(n, slot).sortWithinPartitions("__key")
    names = zip(["__copy", "__copies", "__rate", "__key"], free_names(["copy", "copies", "rate", "shuffle_key"], docs.columns))
    return out.select(*[out[c] for c in docs.columns], *[F.col(k).alias(v) for k, v in names])
