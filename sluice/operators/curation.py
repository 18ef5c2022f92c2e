"""Curated aggregates: their public tables, snapshot rows, errors and run statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records as N
from ..functions import scalars as S
from ..functions import times as D
from ..functions.constants import TIMEPOINTS
from ..sources.readers import has_path, path_or_null
from . import relational as R

# The numbers of a snapshot's metric row.
METRIC_FIELDS = ["loc", "comment_ratio", "cyclomatic_complexity", "halstead_volume", "halstead_difficulty", "halstead_effort", "halstead_bugprop", "halstead_timerequired", "maintainability_index", "fanout_internal", "fanout_external", "operands_sum", "operands_uniq", "operators_sum", "operators_uniq"]

# Statuses of a run's stages and snapshots, and of its tools, that are no errors.
RUN_DONE = ["success", "partial_success", "completed", "missing_snapshot"]
TOOL_DONE = ["completed", "skipped"]

# Columns of a pull request that are not stable between reads of it.
UNSTABLE = ["timeline_items", "comments", "reviews", "comments_count", "reviews_count", "mergeable", "mergeable_state", "mergeable_method", "review_decision"]

LABELS = [x for x, d in TIMEPOINTS.items() if d]


def _first(df: DataFrame, *paths: str, kind: str = "string") -> Column:
    """The first value among the paths that the schema has, as kind."""
    return F.coalesce(*[F.col(p).cast(kind) for p in paths if has_path(df.schema, p)], F.lit(None).cast(kind))


def _json(df: DataFrame, path: str) -> Column:
    return F.to_json(F.col(path)) if has_path(df.schema, path) else F.lit(None).cast("string")


# ------------------------------------------------------------------ typed records


def cast_scalars(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to int, bool or str where they exist; `uncast` maps a column to its text where the cast failed, so that
    nothing is lost."""
    how = {"int": S.coerce_int, "bool": S.coerce_bool, "str": lambda c: F.col(c).cast("string")}
    have = {k: v for k, v in kinds.items() if k in df.columns}
    lost = [F.when(F.col(k).isNotNull() & how[v](k).isNull(), F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))) for k, v in have.items()]
    uncast = F.map_from_entries(F.array_compact(F.array(*lost))) if lost else F.create_map().cast("map<string,string>")
    return df.select(*[how[have[c]](c).alias(c) if c in have else F.col(c) for c in df.columns], uncast.alias("uncast"))


def decode_columns(df: DataFrame, nested: dict[str, str], kinds: dict[str, str] | None = None) -> DataFrame:
    """JSON text columns as their types (DDL by column); text that is no object or list is null. label_count is filled from
    labels, 0 where these are no list."""
    out = df
    if "labels" in df.columns and isinstance(df.schema["labels"].dataType, T.StringType):
        held = F.col("label_count") if "label_count" in df.columns else F.lit(None).cast("long")
        out = out.withColumn("label_count", F.coalesce(held, F.json_array_length("labels").cast("long"), F.lit(0).cast("long")))
    for c, ddl in nested.items():
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            one = ddl.startswith("array<struct<")
            out = out.withColumn(c, N.json_list(c, ddl[6:-1]) if one else F.when(S.looks_like_json(c), F.from_json(c, ddl)))
    return cast_scalars(out, kinds) if kinds else out


def typed_pull_requests(df: DataFrame, schema: T.StructType, kinds: dict[str, str]) -> DataFrame:
    """Exactly the schema's columns: scalars cast, nested ones decoded, files without broken entries and null if empty."""
    nested = {f.name: f.dataType.simpleString() for f in schema.fields if isinstance(f.dataType, T.StructType | T.ArrayType)}
    out = cast_scalars(decode_columns(df, nested), kinds).drop("uncast")
    out = out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    if "files" in nested:
        kept = F.filter("files", lambda x: x.isNotNull())
        out = out.withColumn("files", F.when(F.size(kept) > 0, kept))
    return out


def without_unstable(df: DataFrame) -> DataFrame:
    """Without the columns that change between reads; nested columns are JSON text, so that batches have one schema."""
    kinds = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields if f.name not in UNSTABLE])


def prefer_raw(df: DataFrame, raw: str, fields: list[str]) -> DataFrame:
    """The fields from the raw payload (a map) where it has them at all, null values included; else the typed column."""
    pick = lambda n: F.when(F.coalesce(F.map_contains_key(raw, F.lit(n)), F.lit(False)), F.element_at(raw, n)).otherwise(path_or_null(df, n).cast("string"))
    return df.select(*[c for c in df.columns if c not in fields], *[pick(n).alias(n) for n in fields])


def repository_payload(df: DataFrame, raw: str, typed: str, full: str, peek: str) -> Column:
    """The best repository payload: full in raw, full in typed, peek in raw, peek in typed (structs of JSON text)."""
    return _first(df, f"{raw}.{full}", f"{typed}.{full}", f"{raw}.{peek}", f"{typed}.{peek}")


def public_pull_requests(df: DataFrame, kinds: dict[str, str], nested: list[str] | None = None) -> DataFrame:
    """Standardized pull requests with their keys. kinds: column -> string, bool, int, float, timestamp or json; nested: more
    columns, kept as JSON text (the full form). Needs cohort and source_file."""
    fields = [N.standardize(c, k).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c, k in kinds.items()]
    whole = [_json(df, c).alias(c) for c in nested or []]
    key = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("id", "url") if c in df.columns], F.lit("unknown_pull_request"))
    base, head = (F.concat_ws("::", key, F.lit("repository_snapshot"), F.coalesce(path_or_null(df, f"{r}.id").cast("string"), F.lit("unknown")), F.lit(r.split("_")[0].upper())) for r in ("base_repository", "head_repository"))
    return df.select(
        *fields, *whole, key.alias("pull_request_key"), base.alias("base_repository_snapshot_key"), head.alias("head_repository_snapshot_key"),
        (~F.lower("cohort").isin("human", "humans")).alias("authored_by_agent"), "cohort", N.dedup_key(path_or_null(df, "url"), path_or_null(df, "id")).alias("dedup_key"), F.col("source_file").alias("source_parquet_file"),
    )


def repositories_from_search(df: DataFrame, payload: str, role: str, key: str) -> DataFrame:
    """A row per REST repository payload (a struct): names, flags and counts, absent ones with the contract's defaults."""
    p = lambda path, kind="string": path_or_null(df, f"{payload}.{path}", kind).cast(kind)
    text, flag, count = (lambda x: F.coalesce(p(x), F.lit(""))), (lambda x: F.coalesce(p(x, "boolean"), F.lit(False))), (lambda x: F.coalesce(p(x, "long"), F.lit(0)))
    topics = F.coalesce(F.col(f"{payload}.topics"), F.array().cast("array<string>")) if has_path(df.schema, f"{payload}.topics") else F.array().cast("array<string>")
    return df.select(
        p("id").alias("id"), F.col(key).alias("pr_id"), F.lit(role).alias("role"), text("name").alias("name"), text("full_name").alias("name_with_owner"), text("html_url").alias("url"), text("ssh_url").alias("ssh_url"),
        count("stargazers_count").alias("stargazer_count"), flag("fork").alias("is_fork"), flag("archived").alias("is_archived"), flag("disabled").alias("is_disabled"), flag("archived").alias("is_locked"), flag("private").alias("is_private"),
        (F.coalesce(p("mirror_url"), F.lit("")) != "").alias("is_mirror"), flag("is_template").alias("is_template"), F.coalesce(p("owner.type") == "Organization", F.lit(False)).alias("is_in_organization"), p("owner.login").alias("owner_login"),
        count("forks_count").alias("fork_count"), flag("allow_forking").alias("forking_allowed"), text("created_at").alias("created_at"), F.coalesce(p("visibility"), F.when(flag("private"), "private").otherwise("public")).alias("visibility"),
        F.size(topics).alias("topics_count"), topics.alias("repository_topics"), F.coalesce(p("watchers_count", "long"), count("subscribers_count")).alias("watchers"), p("license.name").alias("license_name"), p("default_branch").alias("default_branch"),
        p("language").alias("primary_language"), p("description").alias("description"), p("size", "long").alias("size_kb"), p("open_issues_count", "long").alias("open_issues_count"), p("pushed_at").alias("pushed_at"), p("updated_at").alias("updated_at"),
    )


# ------------------------------------------------------------------ aggregates as public rows


def curated_pull_requests(df: DataFrame) -> DataFrame:
    """The public row of each aggregate (cohort, pull_request_key, pr struct, metrics struct, sampling struct if there is one)."""
    meta = lambda *names: S.first_present(*[_first(df, f"pr.sampling_metadata.{n}", f"sampling.{n}", f"pr.{n}") for n in names])
    repo = lambda side, f: _first(df, f"pr.{side}_repository_full.{f}", f"pr.{side}_repository.{f}")
    key = lambda side: F.coalesce(S.repository_key(repo(side, "name_with_owner")), S.repo_key_from_url(repo(side, "url")))
    text = lambda *paths: S.coerce_str(S.first_present(*[_first(df, p) for p in paths]))
    number = lambda p: S.coerce_int(_first(df, p))
    return df.select(
        "cohort", "pull_request_key", text("pr.id").alias("pr_id"), text("pr.author.login", "pr.author.name", "pr.author.id", "pr.author_login").alias("author"),
        key("base").alias("base_repository_key"), repo("base", "id").alias("base_repository_id"), repo("base", "url").alias("base_repository_url"),
        key("head").alias("head_repository_key"), repo("head", "id").alias("head_repository_id"), repo("head", "url").alias("head_repository_url"),
        text("pr.created_at").alias("created_at"), text("pr.merged_at").alias("merged_at"), text("pr.closed_at").alias("closed_at"),
        text("pr.pr_primary_language_effective", "pr.primary_language_effective").alias("dominant_language"), _json(df, "pr.file_languages").alias("file_languages_json"),
        S.coerce_bool(_first(df, "pr.authored_by_agent")).alias("authored_by_agent"), text("pr.author_agent", "pr.discovered_agent").alias("author_agent"),
        F.coalesce(S.coerce_bool(_first(df, "pr.longitudinal_selected")), F.lit(False)).alias("longitudinal_selected"), text("metrics.status").alias("processing_status"),
        meta("sampling_language_bucket", "selected_language_bucket", "primary_language", "pr_primary_language_effective").alias("sampling_language_bucket"),
        meta("sampling_time_bucket", "time_bucket_sampling", "time_bucket_day").alias("sampling_time_bucket"), meta("sampling_popularity_bucket", "popularity_bucket").alias("sampling_popularity_bucket"),
        number("pr.additions").alias("additions"), number("pr.deletions").alias("deletions"), number("pr.changed_files").alias("changed_files"),
    )


def repository_metadata(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per stable repository, the first in `order`: columns cohort, repository_key, stable_repository_id, readme,
    labels, stargazer_count, popularity_label, files (array)."""
    identity = F.coalesce(F.concat(F.lit("stable-base-repository-id:"), S.stable_numeric_id("stable_repository_id")), F.concat(F.lit("repository-key:"), F.nullif(F.trim("repository_key"), F.lit(""))))
    one = R.first_rows(df.withColumn("__identity", identity), ["__identity"], order, keep_null_keys=False)
    return one.select(
        S.entity_id(F.lit("RepositoryAdditionalMetadata"), F.col("__identity")).alias("repository_metadata_id"), "repository_key", S.stable_numeric_id("stable_repository_id").alias("stable_repository_id"),
        F.substring_index("repository_key", "/", 1).alias("repository_owner"), F.regexp_extract("repository_key", "^[^/]*/(.*)$", 1).alias("repository_name"), S.popularity_label("popularity_label").alias("popularity_label"),
        S.coerce_int("stargazer_count").alias("stargazer_count"), F.to_json("labels").alias("labels"), "readme", F.sha2(F.col("readme").cast("binary"), 256).alias("readme_sha256"), F.size(F.coalesce("files", F.array().cast("array<string>"))).alias("file_count"), F.to_json("files").alias("file_list"),
    )


SNAPSHOT = "struct<commit:string,path:string,available:boolean>"
_IMPACT = "struct<touched_refactoring_zone_lines_count:bigint,touched_pr_lines_count:bigint,touching_commits_count:bigint>"
_LATER = f"struct<status:string,snapshot_commit:string,retention:struct<retention_rate:double>,future_impact:{_IMPACT},pr_changed_line_future_impact:{_IMPACT},refactor_count:bigint,refactor_added_lines:bigint,refactor_removed_lines:bigint,refactor_magnitude_lines:bigint,refactor_magnitude_files:bigint,refactor_diversity:double,refactor_type_count:map<string,bigint>>"
#: An aggregate's snapshots, and its summary of refactorings.
SNAPSHOTS = f"before {SNAPSHOT}, after {SNAPSHOT}, future map<string,{SNAPSHOT}>"
REFACTORING_SUMMARY = f"refactor_count bigint, refactor_added_lines bigint, refactor_removed_lines bigint, refactor_magnitude_lines bigint, refactor_magnitude_files bigint, refactor_diversity double, refactor_type_count map<string,bigint>, refactor_future_snapshot_metrics map<string,{_LATER}>"


def refactoring_results(df: DataFrame, key: list[str], operations: str | None = None) -> DataFrame:
    """Result rows of each aggregate (snapshots, summary, status): that of the change itself where there is an after
    snapshot, and one for each later snapshot that is available; counts by type as sorted JSON."""
    counts = ("refactor_count", "refactor_added_lines", "refactor_removed_lines", "refactor_magnitude_lines", "refactor_magnitude_files", "refactor_diversity")
    names = ("refop_count", "added_lines", "removed_lines", "magnitude_lines", "magnitude_files", "diversity")
    none = F.lit(None)
    some = lambda c: F.coalesce(blank(c["commit"]), F.lit(False)) | F.coalesce(blank(c["path"]), F.lit(False))
    blank = lambda c: c != ""
    s = F.col("summary")
    found = F.when(F.coalesce(s["refactor_count"], F.lit(0)) != 0, s["refactor_count"]).otherwise(F.size(operations).cast("long") if operations else s["refactor_count"])
    now = df.where(some(F.col("snapshots.after"))).select(
        *key, F.lit("pr").alias("snapshot_label"), F.lit("before_to_after").alias("transition_label"), F.col("snapshots.after.commit").alias("snapshot_commit"), F.col("status").alias("result_status"),
        none.cast("double").alias("retention_rate"), none.cast("long").alias("lines_touched"), none.cast("long").alias("touching_commits"), found.alias("refop_count"), *[s[c].cast("long").alias(n) for c, n in zip(counts[1:], names[1:])], S.sorted_json(S.positive_counts(s["refactor_type_count"])).alias("type_counts"),
    )
    later = df.select(*key, "snapshots", F.explode("summary.refactor_future_snapshot_metrics").alias("snapshot_label", "m")).withColumn("at", F.try_element_at("snapshots.future", F.col("snapshot_label")))
    later = later.where(F.coalesce(F.col("at.available"), F.col("at.commit") != "", F.lit(False)))
    m, nz = F.col("m"), lambda *cs: F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs[:-1]], cs[-1])
    later = later.select(
        *key, "snapshot_label", F.concat(F.lit("after_to_"), "snapshot_label").alias("transition_label"), F.coalesce("at.commit", m["snapshot_commit"]).alias("snapshot_commit"), m["status"].alias("result_status"), m["retention"]["retention_rate"].alias("retention_rate"),
        nz(m["future_impact"]["touched_refactoring_zone_lines_count"], m["future_impact"]["touched_pr_lines_count"], m["pr_changed_line_future_impact"]["touched_pr_lines_count"]).alias("lines_touched"),
        nz(m["future_impact"]["touching_commits_count"], m["pr_changed_line_future_impact"]["touching_commits_count"]).alias("touching_commits"), *[m[c].cast("long").alias(n) for c, n in zip(counts, names)], S.sorted_json(S.positive_counts(m["refactor_type_count"])).alias("type_counts"),
    )
    return now.unionByName(later)


def maintainability_results(df: DataFrame, key: list[str]) -> DataFrame:
    """A row per snapshot that is there. df: snapshots (SNAPSHOTS) and measures, a map label -> map of numbers; older names of
    a number stand in for the present one."""
    s = F.col("snapshots")
    now = F.array(*[F.struct(F.lit(x).alias("label"), s[x].alias("s")) for x in ("before", "after")])
    then = F.transform(F.map_entries(s["future"]), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("s")))
    rows = df.select(*key, "measures", F.explode(F.concat(now, F.coalesce(then, F.array().cast(f"array<struct<label:string,s:{SNAPSHOT}>>")))).alias("r"))
    there = F.when(F.col("r.label").isin("before", "after"), (F.coalesce("r.s.commit", F.lit("")) != "") | (F.coalesce("r.s.path", F.lit("")) != "")).otherwise(F.coalesce(F.col("r.s.available"), F.col("r.s.commit") != "", F.lit(False)))
    m = F.try_element_at("measures", F.col("r.label"))
    first = lambda *names: F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names])
    return rows.where(there).select(
        *key, F.col("r.label").alias("snapshot_label"), F.concat(F.col(key[-1]), F.lit("@"), F.col("r.label")).alias("snapshot_key"), F.col("r.s.commit").alias("snapshot_commit"),
        first("loc", "ncloc").alias("loc"), first("cyclomatic_complexity", "complexity").alias("cyclomatic_complexity"), first("maintainability_index").alias("maintainability_index"), first("duplicated_lines_density").alias("duplicated_lines_density"),
        first("comment_ratio", "comment_lines_density").alias("comment_ratio"), first("halstead_volume").alias("halstead_volume"), first("fan_out", "fanout_external", "fanout_internal").alias("fan_out"), first("smell_count").cast("long").alias("smell_count"),
    )


def snapshot_manifests(snapshots: DataFrame, availability: DataFrame, key: str) -> DataFrame:
    """A manifest per (key, label): what the snapshot (label, kind, commit, path, available, missing_reason) says, else what
    its availability record (label, available, missing_reason, commit) does."""
    a = availability.select(key, "label", F.col("available").alias("__a"), F.col("missing_reason").alias("__m"), F.col("commit").alias("__c"))
    j = snapshots.join(a, [key, "label"], "left")
    known = F.coalesce(F.col("__a"), F.col("available"), (F.coalesce("commit", F.lit("")) != "") | (F.coalesce("path", F.lit("")) != ""))
    reason = S.first_present("missing_reason", "__m")
    return j.select(
        key, F.col("label").alias("snapshot_label"), F.concat(key, F.lit("@"), "label").alias("snapshot_key"), known.alias("available"), S.first_present("commit", "__c").alias("snapshot_commit"), D.offset_days("label").alias("target_offset_days"),
        F.when(~known & (F.col("kind") == "future"), F.coalesce(reason, F.lit("missing_snapshot_unknown"))).otherwise(reason).alias("missing_reason"),
    )


def snapshot_files(files: DataFrame, cohort: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(file references, distinct blobs of each cohort) of snapshot files: SHA-256, size, text or base64, hash prefix."""
    both = files.withColumns({"content_sha256": F.sha2(content, 256), "content_size_bytes": F.octet_length(content).cast("long")})
    valid = F.try_validate_utf8(F.col(content).cast("string"))
    blobs = both.select(cohort, "content_sha256", "content_size_bytes", valid.alias("content_text"), F.when(valid.isNull(), F.base64(content)).alias("content_bytes_base64"), valid.isNull().alias("is_binary")).dropDuplicates([cohort, "content_sha256"])
    return both.withColumn("is_binary", valid.isNull()).drop(content), blobs.withColumn("hash_prefix", F.substring("content_sha256", 1, 2))


def longitudinal_results(snapshots: DataFrame, summaries: DataFrame, operations: DataFrame, cohorts: DataFrame | None = None) -> DataFrame:
    """The last row (by line_number) of each (cohort, input_mode, pull_request_key, snapshot_label), with its pull request's
    last summary and its operations in order of their lines; only of the cohorts given."""
    pr = ["cohort", "input_mode", "pull_request_key"]
    at = [*pr, "snapshot_label"]
    keep = (lambda d: R.keep_matching(d, cohorts, ["cohort"])) if cohorts is not None else (lambda d: d)
    s = R.latest_rows(keep(snapshots), at, ["line_number"]).drop("line_number")
    p = R.latest_rows(keep(summaries), pr, ["line_number"]).drop("line_number")
    rest = [c for c in operations.columns if c not in (*at, "line_number")]
    o = keep(operations).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("line_number", *rest))).alias("__o")).select(*at, F.transform("__o", lambda x: F.struct(*[x[c].alias(c) for c in rest])).alias("operations"))
    out = s.join(o, at, "left").join(p.select(*pr, F.struct(*[c for c in p.columns if c not in pr]).alias("pr_summary")), pr, "left")
    return out.withColumn("operation_count", F.coalesce(F.size("operations"), F.lit(0)))


def aggregates_by_url(df: DataFrame, url: str, order: list[str]) -> DataFrame:
    """The last aggregate of each url; rows without one go."""
    return R.latest_rows(df.where(F.coalesce(F.col(url), F.lit("")) != ""), [url], order)


def pull_request_aggregates(prs: DataFrame, hydration: DataFrame, refactoring: DataFrame, maintainability: DataFrame, key: str) -> DataFrame:
    """One nested row per pull request from its stages: (pr, hydration, metrics(status, refactoring, maintainability, errors)).
    Stage tables have key, status and results, an array of snapshots with status."""
    pack = lambda d, name: d.select(key, F.struct(*[c for c in d.columns if c != key]).alias(name))
    out = pack(prs, "pr").join(pack(hydration, "hydration"), key, "left").join(pack(refactoring, "r"), key, "left").join(pack(maintainability, "m"), key, "left")
    errors = lambda c, name: stage_errors(name, F.col(f"{c}.status"), F.col(f"{c}.results"))
    e1, e2 = errors("r", "refactoring"), errors("m", "maintainability")
    status = S.overall_status(F.array_compact(F.array("r.status", "m.status")))
    total = F.size(e1) + F.size(e2)
    return out.select(key, "pr", "hydration", F.struct(status.alias("status"), F.col("r").alias("refactoring"), F.col("m").alias("maintainability"), F.struct(total.alias("total_count"), e1.alias("refactoring"), e2.alias("maintainability")).alias("errors")).alias("metrics"))


# ------------------------------------------------------------------ operations and lines


def refactoring_values(df: DataFrame, key: str, operations: str) -> DataFrame:
    """Per pull request, of its operations (standardized_type, level, source and target locations): count, counts by type and
    level as sorted JSON, diversity, distinct added and removed lines, distinct files, and count per 1000 changed lines."""
    o = F.coalesce(F.col(operations), F.array())
    none = "unclassified"
    named = df.select(key, F.explode_outer(operations).alias("o")).select(key, F.coalesce(F.nullif("o.standardized_type", F.lit("")), F.lit(none)).alias("t"), F.coalesce(F.nullif("o.level", F.lit("")), F.lit(none)).alias("l"), F.col("o").isNotNull().alias("is"))

    def counts(by: str) -> DataFrame:
        n = named.where("is").groupBy(key, by).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(by))

    def lines(side: str, name: str) -> DataFrame:
        at = df.select(key, F.explode(operations).alias("o")).select(key, F.explode(f"o.{side}").alias("x")).where("x.file_path is not null and coalesce(x.start_line, x.end_line) is not null")
        a, b = F.coalesce("x.start_line", "x.end_line"), F.coalesce("x.end_line", "x.start_line")
        return R.covered_lines(at.select(key, "x.file_path", F.least(a, b).alias("start"), F.greatest(a, b).alias("end")), [key, "file_path"]).groupBy(key).agg(F.sum("lines").alias(name))

    files = F.flatten(F.transform(o, lambda x: F.concat(*[F.transform(F.coalesce(x[s], F.array()), lambda y: y["file_path"]) for s in ("source_locations", "target_locations")])))
    out = df.select(key, F.size(o).alias("refactor_count"), F.size(F.array_distinct(F.filter(files, lambda p: p != ""))).alias("magnitude_files"))
    for d in (counts("t"), counts("l"), lines("target_locations", "added_lines"), lines("source_locations", "removed_lines")):
        out = out.join(d, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = zero("added_lines") + zero("removed_lines")
    return out.select(
        key, "refactor_count", F.coalesce(F.to_json("t"), F.lit("{}")).alias("type_counts"), F.coalesce(F.to_json("l"), F.lit("{}")).alias("level_counts"), S.shannon(F.coalesce(F.map_values("t"), F.array().cast("array<bigint>"))).alias("diversity"),
        zero("added_lines").alias("added_lines"), zero("removed_lines").alias("removed_lines"), both.alias("magnitude_lines"), "magnitude_files", F.when(both > 0, F.col("refactor_count") / (both / F.lit(1000.0))).otherwise(F.lit(0.0)).alias("density"),
    )


def type_summary(df: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Operations and counts by named type as sorted JSON, from a row per operation."""
    named = F.trim(F.coalesce(F.col(kind), F.lit("")))
    n = df.groupBy(*key, named.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.collect_list(F.when(F.col("t") != "", F.struct("t", "n")))
    return n.groupBy(*key).agg(F.sum("n").alias("operations"), F.to_json(F.map_from_entries(F.array_sort(pairs))).alias("type_counts"))


def count_by_field(df: DataFrame, key: list[str], field: str, missing: str = "unclassified") -> DataFrame:
    return df.groupBy(*key, F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit(missing)).alias(field)).agg(F.count(F.lit(1)).alias("n"))


def tracked_ranges(df: DataFrame, key: list[str]) -> DataFrame:
    """Ranges after the change by file, from a row per range or anchor (path, start, end): an anchor (end before start) counts
    as the one line before which it stands."""
    return df.where("path is not null and path <> ''").select(*key, "path", F.when(F.col("end") < F.col("start"), F.col("end")).otherwise(F.col("start")).alias("start"), F.col("end"))


def path_statuses(paths: DataFrame, changes: DataFrame, key: list[str], path: str) -> DataFrame:
    """Tracked paths with what became of them, from lines of a name-status report: renamed, deleted, the code's letter, or
    null. The last line about a path counts."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^/+", "")
    part = lambda i: F.try_element_at(F.split(F.trim("line"), "\t"), F.lit(i))
    code = F.upper(F.substring(F.trim(part(1)), 1, 1))
    rows = changes.where(part(2).isNotNull()).select(*key, "number", clean(part(2)).alias(path), F.trim(part(1)).alias("raw_status"), F.when((code == "R") & part(3).isNotNull(), "renamed").when(code == "D", "deleted").when(code == "", "changed").otherwise(F.lower(code)).alias("status"), F.when(code != "D", clean(part(3))).alias("new_path"))
    known = paths.select(*key, clean(F.trim(path)).alias(path)).where(f"{path} <> ''").distinct()
    return known.join(R.latest_rows(rows, [*key, path], ["number"]).drop("number"), [*key, path], "left")


# ------------------------------------------------------------------ snapshot metric rows


def metric_rows(df: DataFrame, keep: list[str], payload: str) -> DataFrame:
    """Metric rows of a tool's JSON: the numbers of `overall`; parse_failed with nulls where that is no object. keep has
    files_considered."""
    parsed = N.json_object(payload, "overall string, files string, stats string")
    n = F.coalesce(F.size(F.json_object_keys(parsed["files"])), F.json_array_length(parsed["files"]))
    overall = N.json_object(parsed["overall"], "map<string,double>")
    out = df.select(*keep, overall.alias("__o"), parsed.alias("__p"), n.alias("__n"))
    ok = F.col("__o").isNotNull()
    return out.select(
        *keep, F.when(ok, "success").otherwise("parse_failed").alias("status"), F.when(~ok, "the report has no object at 'overall'").alias("error_message"),
        F.when(ok, F.coalesce(F.nullif(F.col("__n"), F.lit(0)), F.col("files_considered"))).otherwise(0).cast("int").alias("files_analyzed"), *[F.try_element_at("__o", F.lit(f)).alias(f) for f in METRIC_FIELDS],
        F.when(ok, F.col("__p.overall")).alias("overall_json"), F.when(ok, F.col("__p.stats")).alias("stats_json"), F.lit(False).alias("reused"), F.lit(None).cast("string").alias("reused_from"), F.lit(None).cast("string").alias("reuse_reason"),
    )


def empty_rows(df: DataFrame, keep: list[str], status: str, error: str | None = None) -> DataFrame:
    """Metric rows without numbers, for snapshots that are missing, have failed or have no source."""
    return metric_rows(df.withColumn("__none", F.lit(None).cast("string")), keep, "__none").withColumns({"status": F.lit(status), "error_message": F.lit(error).cast("string")})


def reuse_rows(rows: DataFrame, targets: DataFrame, on: list[str], row_id: str, reason: str) -> DataFrame:
    """The metrics of rows under the targets' own columns: reused, with the source's id and the reason, also in the stats."""
    own = [c for c in targets.columns if c not in on]
    source = rows.select(*on, *[F.col(c).alias(f"__s_{c}") for c in rows.columns if c not in on])
    j = targets.join(source, on)
    note = F.concat(F.lit('"_reuse":'), F.to_json(F.struct(F.lit(True).alias("reused"), F.col(f"__s_{row_id}").alias("reused_from"), F.lit(reason).alias("reuse_reason"))))
    body = F.regexp_extract(F.coalesce("__s_stats_json", F.lit("{}")), r"(?s)^\s*\{(.*)\}\s*$", 1)
    stats = F.concat(F.lit("{"), body, F.when(F.trim(body) != "", ",").otherwise(""), note, F.lit("}"))
    fixed = {"status": F.lit("success"), "error_message": F.lit(None).cast("string"), "reused": F.lit(True), "reused_from": F.col(f"__s_{row_id}").cast("string"), "reuse_reason": F.lit(reason), "stats_json": stats}
    return j.select(*[F.col(c) if c in on or c in own else fixed.get(c, F.col(f"__s_{c}")).alias(c) for c in rows.columns])


def embedded_rows(df: DataFrame, facts: list[str], metrics: list[str]) -> DataFrame:
    """Embedded metric rows with their pull request's identity (columns pr_<name> of `facts`) where they lack it; the kind
    follows from the label, and a row with a number is a success if it says nothing."""
    label = F.trim(F.coalesce("snapshot_label", F.lit("")))
    kind = F.coalesce(N.blank_to_null("snapshot_kind"), F.when(label.startswith("+"), "future").when(label != "", label))
    some = F.coalesce(*[S.coerce_float(m) for m in metrics]).isNotNull()
    out = df.withColumns({c: F.coalesce(F.col(c), F.col(f"pr_{c}")) for c in facts})
    return out.withColumns({"snapshot_kind": kind, "status": F.coalesce(N.blank_to_null("status"), F.when(some, "success"))}).drop(*[f"pr_{c}" for c in facts])


def overlay(df: DataFrame, label: str, column: str, values: dict[str, str]) -> DataFrame:
    """The column replaced, in rows of a label, by that label's other column."""
    out = F.col(column)
    for x, c in values.items():
        out = F.when(F.col(label) == x, F.col(c)).otherwise(out)
    return df.withColumn(column, out)


def consume_snapshots(rows: DataFrame, identities: DataFrame, values: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(values of the first successful row of each (pr, label), matched by (cohort, url), else by (cohort, repository, number);
    counts by status). identities: pr, cohort, pr_url, repository_key, pr_number, the last of a key counting."""
    status = F.lower(F.trim(F.coalesce(S.coerce_str("status"), F.lit("missing"))))
    counts = rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    ids = {name: R.latest_rows(identities.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, "pr"), keys, ["pr"]) for name, keys in (("url", ["cohort", "pr_url"]), ("number", ["cohort", "repository_key", "pr_number"]))}
    label = N.snapshot_label("snapshot_label", "snapshot_kind", "days_after_merge", LABELS)
    good = rows.where(status == "success").withColumn("label", label).where("label is not null")
    good = good.join(ids["url"].withColumnRenamed("pr", "__u"), ["cohort", "pr_url"], "left").join(ids["number"].withColumnRenamed("pr", "__n"), ["cohort", "repository_key", "pr_number"], "left")
    good = good.withColumn("pr", F.coalesce("__u", "__n")).where("pr is not null")
    return R.first_rows(good, ["pr", "label"], order, keep_null_keys=False).select("pr", "label", *values), counts


def inject_metrics(values: DataFrame, other: DataFrame, names: dict[str, str], metric: str = "metric") -> DataFrame:
    """Long values in which the other table's metrics stand under their new names, in place of any that had them."""
    new = other.where(F.col(metric).isin(*names) & F.col("value").isNotNull())
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return values.where(~F.col(metric).isin(*names.values())).unionByName(new.withColumn(metric, F.element_at(table, F.col(metric))).select(*values.columns))


def select_values(df: DataFrame, metric: str, label: str, cohort: str | None = None, group: str | None = None) -> DataFrame:
    """Finite values of a metric at a point in time, of a cohort or of an authorship group, which the cohort's name tells."""
    people = F.lower(F.trim("cohort")).isin("human", "humans")
    keep = (F.col("metric") == metric) & (F.col("label") == label) & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))
    if cohort is not None:
        keep = keep & (F.col("cohort") == cohort)
    if group is not None:
        keep = keep & (people if group == "human" else ~people)
    return df.where(keep)


def cohort_scopes(df: DataFrame, metric: str) -> DataFrame:
    """(cohort, value) of a metric from long values by scope."""
    return df.where((F.col("metric") == metric) & F.col("scope").startswith("cohort:") & F.col("value").isNotNull()).select(F.substring("scope", 8, 1 << 30).alias("cohort"), F.col("value").cast("double").alias("value"))


def compact_refactoring(df: DataFrame) -> DataFrame:
    """Metric rows from compact ones (cohort, authorship_group, agent_label, language, refactor_count, refactor_diversity, added,
    removed, nloc_before, type_counts, level_counts as JSON): values per operation, null where there is none."""
    types = F.map_filter(S.json_counts("type_counts"), lambda k, _: ~F.lower(F.trim(k)).isin("", "unclassified"))
    given = S.coerce_int("refactor_count")
    n = F.when(given > 0, given).otherwise(F.aggregate(F.map_values(types), F.lit(0).cast("long"), lambda a, x: a + x)).cast("double")
    per = lambda c: F.when(n > 0, F.coalesce(c, F.lit(0)) / n)
    added, removed = F.coalesce(F.col("added").cast("double"), F.lit(0.0)), F.coalesce(F.col("removed").cast("double"), F.lit(0.0))
    return df.select(
        "cohort", "authorship_group", "agent_label", "language", n.alias("RefCount"), S.per_kloc(n, "nloc_before").alias("RefDensity"), F.coalesce(F.col("refactor_diversity").cast("double"), F.lit(0.0)).alias("RefDiversity"),
        per(added).alias("RefAdded"), per(removed).alias("RefRemoved"), per(added + removed).alias("RefMagLines"), F.to_json(types).alias("type_counts"), F.to_json(S.json_counts("level_counts")).alias("level_counts"),
    )


# ------------------------------------------------------------------ results, errors, statistics


def result_rows(values: DataFrame, summaries: Callable[[DataFrame, list[str]], DataFrame], failed: Column | None = None) -> DataFrame:
    """The public result as rows (scope, label, eligible, ..., rank): overall, agents against humans, and each cohort, humans
    first. values: a row per pull request with cohort and authorship_group; summaries aggregates it by the given columns."""
    parts = [("overall", F.lit("overall")), ("authorship_group", F.col("authorship_group")), ("cohort", F.col("cohort"))]
    out = None
    for scope, label in parts:
        rows = summaries(values.withColumn("label", label), ["label"]).withColumn("scope", F.lit(scope))
        out = rows if out is None else out.unionByName(rows)
    rank = F.when(F.col("scope") == "overall", 0).when(F.col("scope") == "authorship_group", 1).otherwise(F.when(F.lower("label").isin("human", "humans"), 2).otherwise(3))
    out = out.withColumn("rank", rank)
    if failed is not None:
        n, total = values.agg(F.count_if(failed), F.count(F.lit(1))).first()
        out = out.withColumns({"failed": F.lit(n), "all_prs": F.lit(total), "failed_share": F.lit(n / total if total else 0.0)})
    return out


def stage_errors(stage: str, status: Column, results: Column) -> Column:
    """Errors of a stage as structs (stage, scope, snapshot_label, status): its own status, and each snapshot's."""
    done = ["success", "partial_success", "completed", "skipped"]
    bad = lambda s: (F.lower(F.trim(F.coalesce(s, F.lit("")))) != "") & ~F.lower(F.trim(s)).isin(*done)
    one = lambda scope, label, s: F.struct(F.lit(stage).alias("stage"), F.lit(scope).alias("scope"), label.alias("snapshot_label"), s.alias("status"))
    whole = F.when(F.coalesce(bad(status), F.lit(False)), one("stage", F.lit(None).cast("string"), status))
    each = F.transform(F.filter(F.coalesce(results, F.array()), lambda r: bad(r["status"])), lambda r: one("snapshot", r["snapshot_label"], r["status"]))
    return F.concat(F.array_compact(F.array(whole)), each)


def run_errors(df: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """A row per error of a run: of a stage, of a snapshot, and of a tool's run in it. Stage columns are structs (status,
    results: array of (snapshot_label, tool, status, tool_runs: array of (tool, status)))."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out, none = None, F.lit(None).cast("string")
    for stage in stages:
        snaps = df.select(key, F.explode(f"{stage}.results").alias("s"))
        tools = snaps.select(key, "s.snapshot_label", F.explode("s.tool_runs").alias("t"))
        parts = [
            df.where((low(F.col(f"{stage}.status")) != "") & ~low(F.col(f"{stage}.status")).isin(*RUN_DONE)).select(key, F.lit("aggregate_stage").alias("source"), F.lit(stage).alias("stage"), none.alias("snapshot_label"), none.alias("tool"), F.col(f"{stage}.status").alias("status")),
            snaps.where((low(F.col("s.status")) != "") & ~low(F.col("s.status")).isin(*RUN_DONE)).select(key, F.lit("aggregate_snapshot").alias("source"), F.lit(stage).alias("stage"), "s.snapshot_label", "s.tool", "s.status"),
            tools.where((low(F.col("t.status")) != "") & ~low(F.col("t.status")).isin(*TOOL_DONE)).select(key, F.lit("tool_run").alias("source"), F.lit(stage).alias("stage"), "snapshot_label", "t.tool", "t.status"),
        ]
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def snapshot_summary(snapshots) -> Column:
    """Whether there is a before and an after snapshot, and the later ones' number, of a struct SNAPSHOTS."""
    s = S._col(snapshots)
    n = F.coalesce(F.size(s["future"]), F.lit(0))
    return F.struct(s["before"].isNotNull().alias("before"), s["after"].isNotNull().alias("after"), F.greatest(n, F.lit(0)).alias("future"), (n > 0).alias("has_future_snapshots"))


def merge_run_statistics(a: DataFrame, b: DataFrame, keys: list[str], seconds: str = "seconds", n: str = "n") -> DataFrame:
    """Sums of two runs' counters by key, with the mean time of a unit (0 without units)."""
    sums = [c for c in a.columns if c not in keys]
    out = a.unionByName(b).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return out.withColumn("mean_seconds", S.ratio(seconds, n)) if {seconds, n} <= set(sums) else out


def selected_by_language(selected: DataFrame, meta: DataFrame, url: str, language: str) -> DataFrame:
    """Counts of the selected urls by their language; those without one are left out."""
    return selected.select(url).distinct().join(meta.select(url, language), url).where(F.coalesce(F.col(language), F.lit("")) != "").groupBy(language).agg(F.count(F.lit(1)).alias("n"))


def dataset_tables(facts: DataFrame, domains: DataFrame) -> dict[str, DataFrame]:
    """What a data-set report shows, as long tables: counts of pull requests by week, hour, language and popularity, of pull
    requests and repositories by domain, confidences by domain, and the numbers by cohort. facts: cohort, id, created_at, language,
    popularity, repository, and the numbers changed_lines, changed_files, stars; domains: repository, domain, confidence."""
    n = F.count(F.lit(1)).alias("n")
    per = facts.join(domains.select("repository", "domain").distinct(), "repository")
    return {
        "weeks": facts.groupBy("cohort", D.week_start("created_at").alias("week")).agg(n), "hours": facts.groupBy(F.hour("created_at").alias("hour")).agg(n),
        "languages": facts.groupBy("cohort", "language").agg(n), "popularity": facts.groupBy("cohort", "popularity").agg(n),
        "domains": per.groupBy("cohort", "domain").agg(n, F.count_distinct("repository").alias("repositories")), "confidences": domains.select("domain", "repository", "confidence").distinct(),
        "numbers": facts.unpivot(["cohort", "id"], [F.col(c).cast("double").alias(c) for c in ("changed_lines", "changed_files", "stars")], "metric", "value").where("value is not null"),
    }


def fan_out(aggregates: DataFrame, path: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, int]:
    """Write each public table that is made of the same aggregates below path; they are read once, from a table in path, and
    the tables' rows are counted as written."""
    spark = aggregates.sparkSession
    aggregates.write.mode("overwrite").parquet(f"{path}/_aggregates")
    held = spark.read.schema(aggregates.schema).parquet(f"{path}/_aggregates")
    for name, make in tables.items():
        make(held).write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}").count() for name in tables}
