"""The fact table of pull requests: rules, exclusion, deduplication and status, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import AGENT_RULES, TOPIC_CONFIDENCE, TOPIC_GROUPS
from .relational import first_rows

#: Rows of a dimension table that may be broadcast; beyond it the join is left to the engine.
BROADCAST_ROWS = 50_000


def dim_join(df: DataFrame, dim: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join with a dimension table; it is broadcast only if its counted size is within the bound."""
    small = dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(dim) if small else dim, on, how)


def _contains(marker: str):
    return lambda t: F.lower(t).contains(marker)


def agent_of(author, branch, texts, rules: dict | None = None) -> Column:
    """The first agent whose author, branch prefix or marker (in any of an array of texts) fits; else null."""
    author, branch = F.lower(S._col(author)), F.lower(S._col(branch))
    out = F.lit(None).cast("string")
    for name, (authors, prefixes, markers) in reversed((rules or AGENT_RULES).items()):
        fits = F.lit(False)
        if authors:
            fits = fits | author.isin(*[a.lower() for a in authors])
        for p in prefixes:
            fits = fits | branch.startswith(p.lower())
        for m in markers:
            fits = fits | F.exists(S._col(texts), _contains(m.lower()))
        out = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(out)
    return out


def is_excluded_agent(by_agent, agent, cohort, excluded: list[str]) -> Column:
    names = [x.lower() for x in excluded]
    return F.coalesce(S._col(by_agent), F.lit(False)) & (F.lower(S._col(agent)).isin(*names) | F.lower(S._col(cohort)).isin(*names)) if names else F.lit(False)


def pr_facts(rows: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """One row per pull request from curated rows (cohort, id, url, number, created_at, additions, deletions,
    changed_files, authored_by_agent, author_agent, language, repository_id, repository_name, stars, source_file,
    row_index). Rows without a stable key are all kept; of the others the first by (cohort, file, row)."""
    facts = rows.select(
        "cohort", "source_file", "row_index", S.coerce_str("id").alias("id"), S.coerce_str("url").alias("url"), S.coerce_int("number").alias("number"), S.parse_timestamp("created_at").alias("created_at"),
        S.coerce_int("additions").alias("additions"), S.coerce_int("deletions").alias("deletions"), S.coerce_int("changed_files").alias("changed_files"),
        S.coerce_bool("authored_by_agent", False).alias("by_agent"), S.coerce_str("author_agent").alias("agent"), S.normalize_language("language").alias("language"),
        S.stable_numeric_id("repository_id").alias("repository_id"), S.repository_key("repository_name").alias("repository_key"), S.coerce_int("stars").alias("stars"),
    )
    facts = facts.withColumns({
        "changed_lines": F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0)),
        "dedup_key": F.concat("cohort", F.lit(":"), S.stable_pr_key("repository_id", "number")),
        "popularity": S.popularity_bucket("stars"),
    })
    facts = facts.where(~is_excluded_agent("by_agent", "agent", "cohort", excluded or []))
    return first_rows(facts, ["dedup_key"], ["cohort", "source_file", "row_index"])


def topic_assignments(predictions: DataFrame) -> DataFrame:
    """(repository_id, repository_key, domain, confidence) from nested predictions: first of each (repository, domain)
    without regard to case, canonical domains only, from the least confidence up."""
    t = predictions.select(S.stable_numeric_id("repository_id").alias("repository_id"), S.repository_key("repository_key").alias("repository_key"), F.posexplode("predicted_topic_domains").alias("pos", "p"))
    t = t.select("repository_id", "repository_key", "pos", F.col("p.topic_domain").alias("raw"), F.coalesce(S.coerce_float("p.score_max"), S.coerce_float("p.top_topic_score"), S.coerce_float("p.score_sum")).alias("confidence"))
    canonical = F.lit(None).cast("string")
    for g in TOPIC_GROUPS:
        canonical = F.when(F.lower(F.trim("raw")) == g.lower(), g).otherwise(canonical)
    t = t.withColumn("domain", canonical).where("domain is not null")
    t = first_rows(t.withColumn("repository", F.coalesce("repository_id", "repository_key")), ["repository", "domain"], ["pos"], keep_null_keys=False)
    return t.where(F.col("confidence") >= TOPIC_CONFIDENCE).select("repository_id", "repository_key", "domain", "confidence")
