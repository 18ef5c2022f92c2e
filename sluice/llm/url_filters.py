"""URL filters by a sort-merge range join.

A host is turned into a canonical key: its labels from the last to the first, each followed by a dot (a.b.com is
com.b.a.). A rule for a host and all its subdomains is then the interval of keys that begin with its key; two such
intervals are nested or apart. Pages and rules are laid out by key in range partitions and sorted, rules before pages of
the same key. One sweep keeps the stack of rules whose interval is open; each level of the stack holds its host's path
rules. A page is judged by the rules of the stack whose path begins its own path: the one with the longest host and path
together wins, of equally long ones the longer host.

The partition cuts are quantiles of a bounded sample of (key, path), so that one host with a third of all pages is cut
by path into many partitions; a page's judgement depends on nothing but the page and the rules. A rule goes to each
partition that its interval overlaps, found by bisection of the cuts. Only the cuts (one a partition) go to the driver
and back.

Defined results: a null url, or one without "://", has an empty host and path and no rule. Rules that repeat a host and
path: block wins. A null page_id is carried. An empty table, or no rules, gives the method's own verdict, allow.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from operator import neg

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .common import free_names, map_arrow, materialize, shuffle_partitions

DEFAULT = "allow"
#: Sampled keys a cut; a sample is this many times the partitions.
SAMPLE = 40

#: Rules as (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, a dot after each; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


OUT = "rule string, verdict string"


def _sweep(n_keep: int):
    """Over (bucket, key, kind, path, rank, keep...) sorted so; kind 0 is a rule (keep is null, path its path), 1 a page."""

    def run(batches):
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # key, rules by path, their lengths from the longest
        bucket = None
        for b in batches:
            buckets, keys, kinds, paths, rules, verdicts = (b.column(i).to_pylist() for i in range(6))
            pick, out_rule, out_verdict = [], [], []
            for i in range(b.num_rows):
                key = keys[i]
                if buckets[i] != bucket:
                    bucket, stack = buckets[i], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kinds[i] == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    held = stack[-1][1]
                    if held.get(paths[i], ("", ""))[1] != "block":
                        held[paths[i]] = (rules[i], verdicts[i])
                    if len(paths[i]) not in stack[-1][2]:
                        insort(stack[-1][2], len(paths[i]), key=neg)
                    continue
                pick.append(i)
                best = None
                for host, held, lengths in reversed(stack):
                    # the longest path rule of this host; shorter prefixes lose to it
                    for n in lengths:
                        if (hit := held.get(paths[i][:n])) and len(paths[i]) >= n:
                            rank = (len(host) + n, len(host))
                            if best is None or rank > best[0]:
                                best = (rank, hit)
                            break
                out_rule.append(best[1][0] if best else None)
                out_verdict.append(best[1][1] if best else DEFAULT)
            got = b.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns[6:], pa.array(out_rule, pa.string()), pa.array(out_verdict, pa.string())], names=[*b.schema.names[6:], "rule", "verdict"])

    return run


def _bucketed(df: DataFrame, cuts: list[tuple[str, str]], high: bool) -> DataFrame:
    """With bucket, the number of cuts at or below (key, path); high: also last, that of the end of the key's interval.

    A pair that is several cuts is hot (one url that is repeated, or all urls without a host): its rows are dealt over the
    buckets between these cuts in turn. An interval begins before all cuts that equal its start, so that it reaches them."""

    def run(batches):
        for b in batches:
            keys, paths = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not high:
                ends = [(bisect_left(cuts, x), bisect_right(cuts, x)) for x in zip(keys, paths)]
                cols = [pa.array([last if last - first < 2 else first + 1 + i % (last - first) for i, (first, last) in enumerate(ends)], pa.int32())]
            else:
                cols = [pa.array([bisect_left(cuts, (k, "")) for k in keys], pa.int32())]
                # the interval ends before the key with its last dot made the next character
                cols.append(pa.array([bisect_right(cuts, (k[:-1] + "/", "")) if k else len(cuts) for k in keys], pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "bucket", "last"][: b.num_columns + len(cols)])

    schema = StructType(list(df.schema.fields)).add("bucket", IntegerType())
    return map_arrow(df, run, schema.add("last", IntegerType()) if high else schema)


def judge(pages: DataFrame, rules: DataFrame, keep: list[str], url_col: str = "url", partitions: int | None = None) -> DataFrame:
    """The columns of `keep` with host, path, rule and verdict, a row per page. An added column whose name is taken has an
    underscore put after it.

    rules has host, path and verdict. A rule is written as its host and path.
    """
    spark = pages.sparkSession
    n = partitions or shuffle_partitions(spark)
    url = F.col(url_col)
    added = free_names(["host", "path", "rule", "verdict"], keep)
    own = [f"__k{i}" for i in range(len(keep))]
    held = pages.select(host_key(url_host(url)).alias("__key"), url_path(url).alias("__path"), *[F.col(c).alias(k) for c, k in zip(keep, own)], url_host(url).alias("host"), url_path(url).alias("path"))
    held = materialize(held, "urls")
    # the sample: the smallest hashes, so it is the same on every run and no larger than SAMPLE * n
    order = F.xxhash64("__key", "__path", *own)
    sample = held.select("__key", "__path", order.alias("h")).orderBy("h", "__key", "__path").limit(SAMPLE * n).collect()
    sample = sorted((r[0], r[1]) for r in sample)
    cuts = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    marks = rules.select(host_key(lower_ascii(F.col("host"))).alias("__key"), F.col("path").alias("__path"), F.concat("host", "path").alias("rule"), F.col("verdict"))
    marks = _bucketed(marks, cuts, True).withColumn("bucket", F.explode(F.sequence("bucket", "last"))).drop("last")
    nulls = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in [*own, "host", "path"]]
    marks = marks.select("bucket", "__key", F.lit(0).alias("kind"), "__path", "rule", "verdict", *nulls)
    rows = _bucketed(held, cuts, False).select("bucket", "__key", F.lit(1).alias("kind"), "__path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), *own, "host", "path")
    laid = marks.union(rows).repartitionById(n, "bucket").sortWithinPartitions("bucket", "__key", "kind", "__path")
    out = map_arrow(laid, _sweep(len(keep)), StructType([*held.drop("__key", "__path").schema.fields, *StructType.fromDDL(OUT).fields]))
    return out.toDF(*keep, *added)
