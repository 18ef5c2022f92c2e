"""Public, keyed relational tables from nested pull requests and curated aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import TIMEPOINTS


def pull_request_key(df: DataFrame) -> DataFrame:
    """Adds pull_request_key: id, else dedup_key, else url, else a fixed text."""
    have = [c for c in ("id", "dedup_key", "url") if c in df.columns]
    return df.withColumn("pull_request_key", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in have], F.lit("unknown_pull_request")))


def with_ids(df: DataFrame, entity: str, primary: list[str], foreign: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds the entity's id from its natural key, and ids of what it refers to, from (entity, key) alike."""
    out = df.withColumn(f"{entity}_id", S.entity_id(F.lit(entity), *primary))
    for name, cols in (foreign or {}).items():
        out = out.withColumn(f"{name}_id", S.entity_id(F.lit(name), *cols))
    return out


def file_rows(prs: DataFrame) -> DataFrame:
    """A row per nested file change; the key is positional."""
    f = pull_request_key(prs).select("pull_request_key", F.posexplode("files").alias("position", "f"))
    return f.select(F.format_string("%s::file::%06d", "pull_request_key", "position").alias("file_key"), "pull_request_key", "position", "f.*")


def repository_roles(prs: DataFrame, base: str, head: str, fields: list[str]) -> DataFrame:
    """A row per role; BASE_AND_HEAD where both repositories are the same with the same values."""
    p = pull_request_key(prs)
    body = lambda c: F.to_json(F.struct(*[F.col(f"{c}.{x}") for x in fields]))
    same = (F.col(f"{base}.id") == F.col(f"{head}.id")) & (body(base) == body(head))
    one = lambda role, c: F.struct(F.lit(role).alias("role"), *[F.col(f"{c}.{x}").alias(x) for x in fields])
    rows = F.when(same, F.array(one("BASE_AND_HEAD", base))).otherwise(F.filter(F.array(F.when(F.col(base).isNotNull(), one("BASE", base)), F.when(F.col(head).isNotNull(), one("HEAD", head))), lambda x: x.isNotNull()))
    out = p.select("pull_request_key", F.explode(rows).alias("r")).select("pull_request_key", "r.*")
    return out.withColumn("repository_snapshot_key", F.concat_ws("::", "pull_request_key", F.lit("repository_snapshot"), F.coalesce(F.col("id").cast("string"), F.lit("unknown")), "role"))


def snapshot_rows(df: DataFrame, key: list[str], before: str, after: str, future: str) -> DataFrame:
    """before, after and the known future labels as rows (key, label, days, s) in that order."""
    now = F.array(F.struct(F.lit("before").alias("label"), F.lit(None).cast("int").alias("days"), F.col(before).alias("s")), F.struct(F.lit("after").alias("label"), F.lit(0).alias("days"), F.col(after).alias("s")))
    later = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(d).alias("days"), F.element_at(future, x).alias("s")) for x, d in TIMEPOINTS.items() if d])
    return df.select(*key, F.explode(F.filter(F.concat(now, later), lambda x: x["s"].isNotNull())).alias("r")).select(*key, "r.*")


def smell_rows(df: DataFrame, key: list[str], label: str, counts: str, categories: dict[str, str]) -> DataFrame:
    """One row per label with a column per category and the total; smells without a category count as others."""
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]) if categories else F.create_map().cast("map<string,string>")
    names = sorted(set(categories.values()) | {"others"})
    long = df.select(*key, label, F.explode_outer(counts).alias("smell", "n")).withColumn("category", F.coalesce(F.element_at(table, F.col("smell")), F.lit("others")))
    return long.groupBy(*key, label).agg(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c) for c in names], F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def availability(df: DataFrame, key: list[str], sources: list[str]) -> DataFrame:
    """For each key and known label the first source (maps label -> flag) that says anything; false otherwise."""
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(d).alias("days"), F.coalesce(*[F.element_at(s, x) for s in sources], F.lit(False)).alias("available")) for x, d in TIMEPOINTS.items() if d]))
    return df.select(*key, rows.alias("r")).select(*key, "r.*")


def top_predictions(df: DataFrame, key: str, predictions: str, k: int) -> DataFrame:
    """The k best of an array of (topic, score), renumbered from 1, with the best one apart."""
    best = F.slice(F.array_sort(F.transform(predictions, lambda p: F.struct((-p["score"]).alias("s"), p["topic"].alias("topic")))), 1, k)
    out = F.transform(best, lambda p, i: F.struct((i + 1).alias("rank"), p["topic"].alias("topic"), (-p["s"]).alias("score")))
    return df.select(key, out.alias("predictions")).withColumn("top_topic", F.try_element_at("predictions", F.lit(1))["topic"])


def first_by_processing(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Global first row of each stable key; null keys stay."""
    from .relational import first_rows

    return first_rows(df, key, order)


def merge_statistics(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Sums of two tables of counts by cohort, with a total row."""
    names = [c for c in a.columns if c != by]
    both = a.unionByName(b).groupBy(by).agg(*[F.sum(c).alias(c) for c in names])
    return both.unionByName(both.agg(*[F.sum(c).alias(c) for c in names]).withColumn(by, F.lit("total")))


def reject_reason(checks: list[tuple[str, object]]):
    """The name of the first check that holds, else null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        out = F.when(holds, name).otherwise(out)
    return out


def repository_record_reason(readme: str = "readme", description: str = "description", text: str | None = None, most: float = 0.5):
    """Why a repository is left out: no readme, no description, or too many letters other than a to z."""
    from ..functions.text import letter_stats

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return reject_reason([("missing_readme", blank(readme)), ("missing_description", blank(description)), ("non_english", letter_stats(text or readme)["ratio"] > most)])


def aggregate_rules(topics: str, rules: list[tuple[list[str], str]]):
    """Rules in turn: where all required topics are there they are replaced by the canonical one."""
    out = F.col(topics)
    for need, to in rules:
        wanted = F.array(*map(F.lit, need))
        out = F.when(F.size(F.array_except(wanted, out)) == 0, F.array_distinct(F.concat(F.array_except(out, wanted), F.array(F.lit(to))))).otherwise(out)
    return F.array_sort(out)


def ordered_series(df: DataFrame, by: list[str], days: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(days, value))), lambda x: x[value]).alias("series"))


def numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
