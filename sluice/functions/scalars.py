"""Scalar normalization as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CHARACTERISTIC_LANGUAGES, LOW_STARS, MEDIUM_STARS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space at both ends."""
    return F.trim(_col(c), F.lit(" \t\n\x0b\x0c\r"))


# ------------------------------------------------------------------ coercion


def coerce_str(c) -> Column:
    """Trimmed text; empty, none, null and nan are null; a trailing .0 of digits goes."""
    t = strip(_col(c).cast("string"))
    t = F.when(~F.lower(t).isin("", "none", "null", "nan"), t)
    return F.regexp_replace(t, r"^([0-9]+)\.0$", "$1")


def coerce_float(c) -> Column:
    """A double, null for text that is none and for NaN."""
    d = strip(_col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def coerce_int(c) -> Column:
    """Truncated towards zero by way of a double; null for text that is no finite number."""
    d = coerce_float(c)
    return F.when(F.abs(d) < F.lit(9.2e18), d.cast("long"))


def coerce_bool(c, default: bool | None = None) -> Column:
    t = F.lower(strip(_col(c).cast("string")))
    return F.when(t.isin("1", "true", "t", "yes", "y"), True).when(t.isin("0", "false", "f", "no", "n"), False).otherwise(F.lit(default).cast("boolean"))


def first_present(*cols) -> Column:
    """The first of the texts that is neither null nor blank."""
    return F.coalesce(*[F.when(strip(_col(c)) != "", _col(c)) for c in cols])


def first_float(*cols) -> Column:
    return F.coalesce(*[coerce_float(c) for c in cols])


def first_int(*cols) -> Column:
    return F.coalesce(*[coerce_int(c) for c in cols])


def normalize_language(c) -> Column:
    return F.lower(coerce_str(c))


def cast_or_keep(c, kind: str) -> Column:
    """The value cast to kind and back to text; the value itself where the cast fails."""
    return F.coalesce(_col(c).try_cast(kind).cast("string"), _col(c).cast("string"))


def parse_timestamp(c) -> Column:
    """ISO text as a timestamp without zone; a zone is applied, naive text is UTC (under a UTC session)."""
    return F.try_to_timestamp(F.regexp_replace(strip(_col(c)), "Z$", "+00:00")).cast("timestamp_ntz")


# ------------------------------------------------------------------ keys


def stable_numeric_id(c) -> Column:
    """Digits without leading zeros and without a trailing .0; null for anything else."""
    t = F.regexp_replace(strip(_col(c).cast("string")), r"\.0$", "")
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", ""))


def stable_pr_key(repository_id, number) -> Column:
    """id#number, null unless both are stable."""
    return F.concat(stable_numeric_id(repository_id), F.lit("#"), stable_numeric_id(number))


def repository_key(c) -> Column:
    """owner/name, trimmed and lower-cased, cut at the first slash."""
    t = strip(_col(c).cast("string"))
    owner, name = strip(F.substring_index(t, "/", 1)), strip(F.regexp_extract(t, "(?s)^[^/]*/(.*)$", 1))
    return F.when(t.contains("/") & (owner != "") & (name != ""), F.lower(F.concat(owner, F.lit("/"), name)))


def repository_key_of_safe(c) -> Column:
    """owner__name, cut at the first double underscore."""
    return repository_key(F.regexp_replace(_col(c), "^(.+?)__", "$1/"))


def repository_identity(id_col, key_col) -> Column:
    return F.coalesce(F.concat(F.lit("repository-id:"), stable_numeric_id(id_col)), F.concat(F.lit("repository-key:"), repository_key(key_col)))


def repo_key_from_url(c) -> Column:
    """owner/name from the first two path parts of a URL."""
    m = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)/([^/?#]+)"
    return F.when(_col(c).rlike(m), F.lower(F.concat(F.regexp_extract(_col(c), m, 1), F.lit("/"), F.regexp_extract(_col(c), m, 2))))


def parse_pr_url(c) -> Column:
    """owner, repo and number of .../owner/repo/pull/number."""
    m = r"^https?://[^/]+/([^/]+)/([^/]+)/pull/([0-9]+)"
    return F.when(_col(c).rlike(m), F.struct(F.regexp_extract(_col(c), m, 1).alias("owner"), F.regexp_extract(_col(c), m, 2).alias("repo"), F.regexp_extract(_col(c), m, 3).cast("long").alias("number")))


def entity_id(*parts) -> Column:
    """32 hex digits of the SHA-256 of the NUL-joined parts; a null part is empty."""
    return F.substring(stable_hash(*parts), 1, 32)


def stable_hash(*parts) -> Column:
    return F.sha2(F.concat_ws("\0", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def url_variants(c) -> Column:
    """The URL without and with a trailing slash."""
    bare = F.regexp_replace(strip(_col(c)), "/+$", "")
    return F.array(bare, F.concat(bare, F.lit("/")))


# ------------------------------------------------------------------ buckets and statuses


def popularity_bucket(stars) -> Column:
    """pop0, pop1 or pop2; null counts as no stars."""
    s = F.coalesce(_col(stars), F.lit(0))
    return F.when(s <= LOW_STARS, "pop0").when(s <= MEDIUM_STARS, "pop1").otherwise("pop2")


def popularity_group(stars) -> Column:
    """low, medium or high; null stays null."""
    s = _col(stars)
    return F.when(s <= LOW_STARS, "low").when(s <= MEDIUM_STARS, "medium").when(s.isNotNull(), "high")


def popularity_label(c) -> Column:
    t = F.regexp_replace(F.lower(_col(c)), "_popularity$", "")
    return F.when(t == "pop0", "low").when(t == "pop1", "medium").when(t == "pop2", "high").otherwise(t)


def characteristic_language(c) -> Column:
    t = F.lower(strip(_col(c)))
    t = F.when(t == "js", "javascript").when(t.isin("cpp", "cxx"), "c++").otherwise(t)
    return F.when(t.isin(*CHARACTERISTIC_LANGUAGES), t)


_FAILED = ("failed", "failure", "error", "timeout", "timed_out", "crashed")


def refactoring_status(c) -> Column:
    """missing, success, unsupported, failed or other."""
    t = F.lower(strip(F.coalesce(_col(c), F.lit(""))))
    return (
        F.when(t == "", "missing")
        .when(t == "success", "success")
        .when(t.contains("unsupported") | t.isin("not_supported", "not supported"), "unsupported")
        .when(t.isin(*_FAILED) | t.startswith("fail") | t.contains("failure") | t.contains("error"), "failed")
        .otherwise("other")
    )


def maintainability_status(c, indicator) -> Column:
    t, i = (F.lower(strip(F.coalesce(_col(x), F.lit("")))) for x in (c, indicator))
    failed = F.lit(False)
    for x in (t, i):
        failed = failed | x.isin(*_FAILED) | x.startswith("fail") | x.contains("error")
    return (
        F.when(t == "", "missing")
        .when(t.contains("unsupported") | i.contains("unsupported"), "unsupported")
        .when(failed, "failed")
        .when((t == "success") & i.isin("", "success"), "success")
        .otherwise("other")
    )


def overall_status(statuses) -> Column:
    """Of an array of stage statuses: failed if any failed, skipped if all were, else partial or success."""
    s = _col(statuses)
    return (
        F.when(F.size(s) == 0, "missing")
        .when(F.exists(s, lambda x: x == "failed") & F.exists(s, lambda x: x == "success"), "partial")
        .when(F.exists(s, lambda x: x == "failed"), "failed")
        .when(F.forall(s, lambda x: x == "skipped"), "skipped")
        .otherwise("success")
    )


def snapshot_available(available, snapshot, commit) -> Column:
    """Any of the two flags, or a commit."""
    return F.coalesce(_col(available), F.lit(False)) | F.coalesce(_col(snapshot), F.lit(False)) | F.coalesce(strip(_col(commit)) != "", F.lit(False))


def future_snapshot_available(available, snapshot, commit) -> Column:
    """The first flag that is set at all, else whether there is a commit."""
    return F.coalesce(_col(available), _col(snapshot), F.coalesce(strip(_col(commit)) != "", F.lit(False)))


# ------------------------------------------------------------------ numbers, maps, JSON


def per_kloc(value, nloc) -> Column:
    n = _col(nloc).cast("double")
    return F.when(n > 0, _col(value).cast("double") / (n / F.lit(1000.0)))


def kloc(nloc) -> Column:
    return _col(nloc).cast("double") / F.lit(1000.0)


def delta(after, before) -> Column:
    return _col(after) - _col(before)


def ratio(n, d) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(_col(n).cast("double") / F.nullif(_col(d).cast("double"), F.lit(0.0)), F.lit(0.0))


def shannon(counts) -> Column:
    """Base-2 entropy of the positive counts of an array; 0 if there are none."""
    p = F.filter(_col(counts), lambda x: x > 0)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - (x / total) * F.log2(x / total))


def positive_counts(m) -> Column:
    """The positive entries of a map, in order of their keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(_col(m), lambda _, v: v > 0))))


def json_counts(c) -> Column:
    """A JSON object of counts as positive_counts; anything else is an empty map."""
    m = F.from_json(_col(c), "map<string,bigint>")
    return positive_counts(F.coalesce(m, F.create_map().cast("map<string,bigint>")))


def sorted_json(m) -> Column:
    """Compact JSON of a map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(m)))))


def looks_like_json(c) -> Column:
    return strip(_col(c)).rlike(r"(?s)^(\{.*\}|\[.*\])$")


def decode_json(c) -> Column:
    """A variant where the text is a JSON object or array, else null."""
    return F.when(looks_like_json(c), F.try_parse_json(_col(c)))


def empty_to_null(c) -> Column:
    return F.when(F.size(_col(c)) > 0, _col(c))


def span(start, end) -> Column:
    """The lines from start to end, in whichever order they are given."""
    return F.sequence(F.least(_col(start), _col(end)), F.greatest(_col(start), _col(end)))


def multi_hot(labels: list[str], present) -> Column:
    """0/1 for each of the labels, in their order."""
    return F.array(*[F.array_contains(_col(present), x).cast("int") for x in labels])
