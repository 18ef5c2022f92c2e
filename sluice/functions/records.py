"""Expressions over raw records, whose fields come nested, as JSON text or flattened."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars as S
from .scalars import _col, strip

# The cohorts that are listed first, in this order.
COHORT_ORDER = ["human", "humans", "codex", "copilot", "claude", "cursor", "jules", "devin"]

# Statuses under which a stage, a snapshot of it and a snapshot at processing time count as done.
STAGE_DONE = ["success", "partial_success", "completed", "missing_snapshot", "skipped"]
SNAPSHOT_DONE = ["success", "missing_snapshot"]
PROCESSING_DONE = ["success", "missing_snapshot", "future_tool_disabled"]

# File extensions of C and C++.
CPP_EXTENSIONS = ["c", "cc", "cp", "cpp", "cxx", "c++", "h", "hh", "hpp", "hxx", "h++"]

_NAMES = ("name_with_owner", "full_name", "repository_full_name")
_IDS = ("id", "database_id", "databaseId", "repository_id")
#: Fields of a repository payload; an owner may be a name or an object.
REPOSITORY = ", ".join(f"{x} string" for x in (*_NAMES, *_IDS, "owner", "name", "url"))
_BASE_IDS = ("base_repository_id", "base_repository_database_id", "base_repository_databaseId", "repository_id")
_PAYLOADS = ("repository_metadata", "base_repository_full", "base_repository", "head_repository_full", "head_repository")
_KEYS = ("base_repository_snapshot_key", "repository_snapshot_key")
#: Fields of a pull request's payload that name its repository. Objects stay JSON text, so an object and its text are alike.
RECORD = ", ".join(f"{x} string" for x in ("repo_full_name", "repository_owner", "repository_name", "url", "original_pr_payload", *_BASE_IDS, *_PAYLOADS, *_KEYS))


def json_object(c, ddl: str) -> Column:
    """A struct of a JSON object's fields; null for other text."""
    return F.when(strip(_col(c)).startswith("{"), F.from_json(_col(c), ddl))


def let(c: Column, use) -> Column:
    """use(c) with c computed once a row, however often use refers to it."""
    return F.transform(F.array(c), use)[0]


def blank_to_null(c) -> Column:
    return F.when(strip(_col(c)) != "", _col(c))


# ------------------------------------------------------------------ repositories of a record


def payload_key(c) -> Column:
    """owner/name of a repository payload (JSON text): a full name, else owner and name, else the URL."""
    named = lambda o: let(json_object(o, "login string, name string"), lambda x: S.first_present(x["login"], x["name"]))
    owner = lambda r: F.when(strip(r["owner"]).startswith("{"), named(r["owner"])).otherwise(r["owner"])
    parts = lambda r: S.repository_key(F.concat(blank_to_null(owner(r)), F.lit("/"), blank_to_null(r["name"])))
    return let(json_object(c, REPOSITORY), lambda r: F.coalesce(*[S.repository_key(r[x]) for x in _NAMES], parts(r), S.repo_key_from_url(r["url"])))


def payload_id(c) -> Column:
    """The decimal id of a repository payload (JSON text)."""
    return let(json_object(c, REPOSITORY), lambda r: F.coalesce(*[S.stable_numeric_id(r[x]) for x in _IDS]))


def _with_original(c, one) -> Column:
    """one of a record, else one of the payload that it keeps as original_pr_payload."""
    return let(json_object(c, RECORD), lambda r: F.coalesce(one(r), let(json_object(r["original_pr_payload"], RECORD), one)))


def record_repository_key(c) -> Column:
    """owner/name of the base repository from any of the shapes of a pull request's record."""
    return _with_original(c, lambda r: F.coalesce(S.repository_key(r["repo_full_name"]), *[payload_key(r[x]) for x in _PAYLOADS[:3]]))


def record_repository_id(c) -> Column:
    """The decimal id of the base repository from any of the shapes of a pull request's record."""
    order = ("base_repository_full", "base_repository", "repository_metadata")
    return _with_original(c, lambda r: F.coalesce(*[S.stable_numeric_id(r[x]) for x in _BASE_IDS], *[payload_id(r[x]) for x in order]))


def snapshot_key_repository_id(c) -> Column:
    """The decimal id between the last ::repository_snapshot:: and the role; null if it is no number."""
    rest = F.regexp_extract(strip(_col(c)), r"(?s)^.*::repository_snapshot::(.*)$", 1)
    identity = strip(F.regexp_extract(rest, r"(?s)^(.*)::((?!::).)*$", 1))
    return F.when(identity.rlike("^[0-9]+$"), identity)


def aggregate_repository_id(pr, payload=None) -> Column:
    """The base repository's id from an aggregate's pull request (and the aggregate itself), both JSON text."""
    own = [let(json_object(payload, RECORD), lambda r: S.stable_numeric_id(r["base_repository_id"]))] if payload is not None else []
    nested = lambda r: [payload_id(r["base_repository_full"]), payload_id(r["base_repository"]), *[snapshot_key_repository_id(r[x]) for x in _KEYS]]
    return let(json_object(pr, RECORD), lambda r: F.coalesce(*[S.stable_numeric_id(r[x]) for x in _BASE_IDS[:3]], *own, *nested(r)))


def aggregate_repository_key(pr, metadata) -> Column:
    """The base repository's key from an aggregate's pull request and its repository metadata, both JSON text."""
    parts = lambda r: S.repository_key(F.concat(blank_to_null(r["repository_owner"]), F.lit("/"), blank_to_null(r["repository_name"])))
    named = let(json_object(metadata, REPOSITORY), lambda m: F.coalesce(S.repository_key(m["name_with_owner"]), S.repository_key(m["full_name"])))
    rest = lambda r: [payload_key(r[x]) for x in _PAYLOADS[1:]]
    return let(json_object(pr, RECORD), lambda r: F.coalesce(S.repository_key(r["repo_full_name"]), named, parts(r), *rest(r), payload_key(metadata), S.repo_key_from_url(r["url"])))


def pull_number_of_key(c) -> Column:
    n = F.regexp_extract(strip(_col(c)), r"(?i)[#/]pull/([0-9]+)\b", 1)
    return F.when(n != "", S.stable_numeric_id(n))


def curation_dedup_key(repository_id, number, pull_request_key) -> Column:
    """The strongest stable key of a pull request: repository and number, else repository and key; null without a repository."""
    base = F.concat(F.lit("base-repository:"), S.stable_numeric_id(repository_id))
    n = F.coalesce(S.stable_numeric_id(number), pull_number_of_key(pull_request_key))
    return F.coalesce(F.concat(base, F.lit("::pull-number:"), n), F.concat(base, F.lit("::pull-request-key:"), S.coerce_str(pull_request_key)))


def record_identity(identity, repository_id, *keys) -> Column:
    """The identity key as given, else from the id, else from the first of the keys; empty without any."""
    key = F.coalesce(*[S.repository_key(k) for k in keys])
    return F.coalesce(blank_to_null(identity), F.concat(F.lit("repository-id:"), blank_to_null(repository_id)), F.concat(F.lit("repository-key:"), key), F.lit(""))


def repository_keys(*payloads) -> Column:
    """Distinct identities of the repositories (JSON payloads) that a pull request refers to, in their order."""
    one = [S.repository_identity(payload_id(p), payload_key(p)) for p in payloads]
    return F.array_distinct(F.array_compact(F.array(*one)))


def is_excluded_repository(excluded: list[str], *variants) -> Column:
    """Whether any of the ways to write a repository's key is excluded, case aside."""
    return F.arrays_overlap(F.array_compact(F.array(*[F.lower(strip(_col(v))) for v in variants])), F.array(*[F.lit(x.strip().lower()) for x in excluded]).cast("array<string>"))


# ------------------------------------------------------------------ keys, groups, languages


def dedup_key(url, pr_id) -> Column:
    return F.coalesce(F.nullif(_col(url), F.lit("")), _col(pr_id).cast("string"))


def record_ids(url, database_id, raw_id) -> Column:
    """Distinct stable ids of a record: its url, its database id, and its id if that is a number."""
    text = lambda c: F.nullif(_col(c).cast("string"), F.lit(""))
    raw = text(raw_id)
    return F.array_distinct(F.array_compact(F.array(text(url), text(database_id), F.when(raw.rlike("^[0-9]+$"), raw))))


def distinct_spellings(c) -> Column:
    """Trimmed texts without repeats, case aside; the first spelling stays."""
    items = F.transform(F.coalesce(_col(c), F.array().cast("array<string>")), lambda x: strip(x))
    keep = lambda acc, x: F.when((x == "") | x.isNull() | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(items, F.array().cast("array<string>"), keep)


def resolve_group(human, discovered, identified) -> Column:
    """humans, else the agent that discovery or the rules found, else unknown_agent."""
    return F.when(_col(human), "humans").otherwise(F.coalesce(blank_to_null(discovered), blank_to_null(identified), F.lit("unknown_agent")))


def group_matches(group, selector: str | None) -> Column:
    """human or humans, agentic (all others), or one group by name; no selector fits all."""
    if selector is None:
        return F.lit(True)
    name, g = selector.strip().lower(), F.lower(strip(F.coalesce(_col(group), F.lit(""))))
    people = g.isin("human", "humans")
    return people if name in ("human", "humans") else ~people if name == "agentic" else g == name


def target_language(effective, primary, languages, targets: list[str]) -> Column:
    """The first that is a target: the effective language, the primary one, then the targets in order that the array has;
    else the array's first language."""
    low = [t.strip().lower() for t in targets]
    known = lambda c: F.when(F.lower(strip(_col(c))).isin(*low), F.lower(strip(_col(c))))
    have = F.transform(F.coalesce(_col(languages), F.array().cast("array<string>")), lambda x: F.lower(strip(x)))
    return F.coalesce(known(effective), known(primary), *[F.when(F.array_contains(have, t), t) for t in low], F.try_element_at(have, F.lit(1)))


def cohort_order(c) -> Column:
    """Sort key of a cohort: the listed ones first, then agents as a whole, then the others by name."""
    t = F.lower(strip(_col(c)))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, COHORT_ORDER)), t), F.lit(0))
    n = len(COHORT_ORDER)
    return F.struct(F.when(rank > 0, rank - 1).when(t.isin("agent", "agents"), n).otherwise(n + 1).cast("int").alias("rank"), t.alias("name"), strip(_col(c)).alias("label"))


def is_full_layout(path) -> Column:
    """Whether a folder of the path is named fullpullrequests."""
    return F.array_contains(F.split(F.lower(_col(path)), r"[/\\]"), "fullpullrequests")


def popularity_value(stars) -> Column:
    return F.coalesce(_col(stars).cast("long"), F.lit(0))


# ------------------------------------------------------------------ nested values


def prune(c: Column, kind: T.DataType, names: set[str]) -> Column:
    """The value without the named fields and map keys, at any depth."""
    if isinstance(kind, T.StructType):
        fields = [prune(c[f.name], f.dataType, names).alias(f.name) for f in kind.fields if f.name not in names]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: prune(x, kind.elementType, names))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(c, lambda k, _: ~k.isin(*names)), lambda _, v: prune(v, kind.valueType, names))
    return c


def with_fields(files: Column, kind: T.ArrayType, names: list[str]) -> Column:
    """An array of structs with the named fields, null where a struct lacks them."""
    have = kind.elementType.fieldNames()
    return F.transform(files, lambda x: F.struct(*[x[n].alias(n) for n in have], *[F.lit(None).cast("string").alias(n) for n in names if n not in have]))


def json_list(c, ddl: str) -> Column:
    """An array of structs from JSON text of a list or of one object, without entries that are no objects; null for other text."""
    t = strip(c)
    items = F.from_json(F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).when(t.startswith("["), t), "array<string>")
    return F.filter(F.transform(items, lambda x: json_object(x, ddl)), lambda x: x.isNotNull())


def file_list(c, ddl: str) -> Column:
    """json_list(), null if nothing is left."""
    listed = json_list(c, ddl)
    return F.when(F.size(listed) > 0, listed)


def touched_paths(c) -> Column:
    """The paths of a JSON list of files, by depth, then without regard to case, then as they are."""
    paths = F.transform(json_list(F.when(strip(c).startswith("["), _col(c)), "path string, filename string, new_path string"), lambda x: strip(S.first_present(x["path"], x["filename"], x["new_path"])))
    return sort_paths(F.coalesce(F.filter(paths, lambda p: p != ""), F.array().cast("array<string>")))


def sort_paths(c) -> Column:
    """Paths from the root down: by depth, then without regard to case, then as they are."""
    clean = F.transform(F.filter(_col(c), lambda p: strip(p) != ""), lambda p: F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "^/+", ""))
    keyed = F.transform(clean, lambda p: F.struct(F.size(F.filter(F.split(p, "/"), lambda x: x != "")).alias("depth"), F.lower(p).alias("low"), p.alias("path")))
    return F.transform(F.array_sort(keyed), lambda x: x["path"])


def ranked_predictions(c) -> Column:
    """An array of structs with a rank, by rank and then by place; a place stands in for a rank that is missing or 0."""
    keyed = F.transform(_col(c), lambda p, i: F.struct(F.coalesce(F.nullif(p["rank"].cast("int"), F.lit(0)), i + 1).alias("rank"), i.alias("place"), p.alias("p")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["place"] - b["place"])), lambda x: x["p"])


def cpp_pairs(files, renames: bool = True) -> Column:
    """Distinct (before_path, after_path) of the C and C++ files; a rename's former path counts as before."""
    is_cpp = lambda p: F.lower(F.regexp_extract(p, r"\.([^./\\]*)$", 1)).isin(*CPP_EXTENSIONS)
    pair = lambda f: F.struct((S.first_present(f["previous_filename"], f["path"]) if renames else f["path"]).alias("before_path"), f["path"].alias("after_path"))
    known = F.filter(F.transform(_col(files), pair), lambda p: (F.coalesce(p["before_path"], F.lit("")) != "") & (F.coalesce(p["after_path"], F.lit("")) != ""))
    return F.array_distinct(F.filter(known, lambda p: is_cpp(p["before_path"]) | is_cpp(p["after_path"])))


# ------------------------------------------------------------------ statuses and gates


def _status(c) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def snapshots_status(statuses) -> Column:
    """Of an array of snapshot statuses: missing_snapshot (none), success, partial_success, partial_failure or failed."""
    s = F.transform(_col(statuses), _status)
    good = F.forall(s, lambda x: x.isin("success", "missing_snapshot", "no_source_files"))
    return F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, "missing_snapshot").when(F.forall(s, lambda x: x == "success"), "success").when(good, "partial_success").when(F.exists(s, lambda x: x == "success"), "partial_failure").otherwise("failed")


def _label(x, name: str) -> Column:
    return F.coalesce(blank_to_null(x[name]), F.lit("unknown"))


def gate_reasons(metrics_known, stage_known, stage_status, snapshots) -> Column:
    """Why a pull request is to be replaced, an array; empty if it passes. snapshots: structs (status, snapshot_label, tool)."""
    s = _status(_col(stage_status))
    stage = F.when((s != "") & ~s.isin(*STAGE_DONE), F.concat(F.lit("refactoring_stage:"), s))
    bad = F.filter(F.coalesce(_col(snapshots), F.array()), lambda x: (_status(x["status"]) != "") & ~_status(x["status"]).isin(*SNAPSHOT_DONE))
    each = F.transform(bad, lambda x: F.concat_ws(":", F.lit("refactoring_snapshot"), _label(x, "snapshot_label"), _label(x, "tool"), _status(x["status"])))
    reasons = F.concat(F.array_compact(F.array(stage)), each)
    return F.when(~_col(metrics_known), F.array(F.lit("missing_metrics"))).when(~_col(stage_known), F.array(F.lit("missing_refactoring"))).otherwise(reasons)


def processing_gate_reasons(metrics_known, stage_known, stage_status, snapshots, note: int = 220) -> Column:
    """The same at processing time: snapshots also have notes and return_code, a skipped stage passes, and the stage's own
    status counts only if no snapshot says why."""
    s = _status(_col(stage_status))
    bad = F.filter(F.coalesce(_col(snapshots), F.array()), lambda x: (_status(x["status"]) != "") & ~_status(x["status"]).isin(*PROCESSING_DONE))

    def reason(x: Column) -> Column:
        text = F.regexp_replace(strip(F.coalesce(x["notes"], F.lit(""))), "\n", " | ")
        cut = F.when(F.length(text) <= note, text).otherwise(F.concat(F.substring(text, 1, note), F.lit("...[truncated "), (F.length(text) - note).cast("string"), F.lit(" chars]")))
        said = F.when(text != "", F.concat(F.lit("(notes="), cut, F.lit(")"))).otherwise("")
        code = F.when(x["return_code"].isNotNull(), F.concat(F.lit("(return_code="), x["return_code"].cast("string"), F.lit(")"))).otherwise("")
        return F.concat(F.concat_ws(":", F.lit("refactoring_snapshot"), _label(x, "snapshot_label"), _label(x, "tool"), _status(x["status"])), said, code)

    each = F.transform(bad, reason)
    alone = (s != "") & ~s.isin(*STAGE_DONE) & (F.size(each) == 0)
    stage = F.when(alone, F.array(F.concat(F.lit("refactoring_stage:"), s, F.lit("(no_snapshot_failure_details)")))).otherwise(each)
    return F.when(~_col(metrics_known), F.array(F.lit("missing_metrics"))).when(~_col(stage_known), F.array(F.lit("missing_refactoring"))).when(s == "skipped", F.array().cast("array<string>")).otherwise(stage)


def no_file_overlap(tracked, has_overlap) -> Column:
    """Whether a diff that was computed touches no file of the pull request."""
    return F.coalesce(_col(tracked), F.lit(False)) & ~F.coalesce(_col(has_overlap), F.lit(False))


def reuse_reason(cumulative_touches, tracked, has_overlap) -> Column:
    """Why a later snapshot may reuse the result after the merge; null if it may not."""
    t = _col(cumulative_touches)
    return F.when(t == 0, "future_no_cumulative_commit_touches").when(t.isNull() & no_file_overlap(tracked, has_overlap), "future_no_pr_file_overlap")


def snapshot_label(label, kind, days, known: list[str]) -> Column:
    """before, after or a known point in time, from a snapshot's label, else its kind, else its days."""
    t, k = strip(F.coalesce(S.coerce_str(label), F.lit(""))), F.lower(strip(F.coalesce(S.coerce_str(kind), F.lit(""))))
    after = F.concat(F.lit("+"), S.coerce_int(days).cast("string"), F.lit("d"))
    return F.when(F.lower(t).isin("before", "after"), F.lower(t)).when(k.isin("before", "after"), k).when(t.isin(*known), t).when(after.isin(*known), after)


def standardize(c, kind: str) -> Column:
    """A value as string, bool, int, float, timestamp or json (compact text)."""
    col = _col(c)
    if kind == "json":
        return F.to_json(col)
    return {"string": S.coerce_str, "bool": S.coerce_bool, "int": S.coerce_int, "float": S.coerce_float, "timestamp": S.parse_timestamp}[kind](col)
