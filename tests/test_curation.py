"""Records, curated aggregates, rules, training tables and resumable runs on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from sluice.functions import records as N
from sluice.functions import text as T
from sluice.operators import aggregate, curation, learning, parsers, relational, rules, taxonomy, training
from sluice.streaming import curation as runs


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def lit_array(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


RECORD_CASES = [
    (lambda: N.record_repository_key(F.lit('{"repository_metadata": "{\\"name_with_owner\\": \\"A/B\\"}"}')), "a/b"),
    (lambda: N.record_repository_key(F.lit('{"base_repository_full": {"owner": {"name": "A"}, "name": "B"}}')), "a/b"),
    (lambda: N.record_repository_key(F.lit('{"base_repository": {"url": "https://h.example/A/B/"}}')), "a/b"),
    (lambda: N.record_repository_key(F.lit('{"original_pr_payload": {"base_repository_full": {"full_name": "A/B"}}}')), "a/b"),
    (lambda: N.record_repository_key(F.lit(None).cast("string")), None),
    (lambda: N.record_repository_id(F.lit('{"base_repository": {"databaseId": 7}}')), "7"),
    (lambda: N.record_repository_id(F.lit('{"repository_id": "007.0"}')), "7"),
    (lambda: N.snapshot_key_repository_id(F.lit("pr::repository_snapshot::12::BASE")), "12"),
    (lambda: N.snapshot_key_repository_id(F.lit("pr::repository_snapshot::a/b::BASE")), None),
    (lambda: N.snapshot_key_repository_id(F.lit("12::BASE")), None),
    (lambda: N.aggregate_repository_id(F.lit('{"repository_snapshot_key": "p::repository_snapshot::5::HEAD"}'), F.lit("{}")), "5"),
    (lambda: N.aggregate_repository_key(F.lit('{"repository_owner": "O", "repository_name": "R"}'), F.lit("{}")), "o/r"),
    (lambda: N.aggregate_repository_key(F.lit('{"url": "https://h.example/O/R/pull/3"}'), F.lit(None).cast("string")), "o/r"),
    (lambda: N.curation_dedup_key(F.lit("9"), F.lit(None).cast("string"), F.lit("o/r/pull/12")), "base-repository:9::pull-number:12"),
    (lambda: N.curation_dedup_key(F.lit("9"), F.lit(None).cast("string"), F.lit("key")), "base-repository:9::pull-request-key:key"),
    (lambda: N.curation_dedup_key(F.lit("x"), F.lit("1"), F.lit("key")), None),
    (lambda: N.record_identity(F.lit(" "), F.lit(None).cast("string"), F.lit("A/B")), "repository-key:a/b"),
    (lambda: N.record_identity(F.lit(None).cast("string"), F.lit("3"), F.lit("A/B")), "repository-id:3"),
    (lambda: N.record_identity(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("x")), ""),
    (lambda: F.array_join(N.repository_keys(F.lit('{"id": 1}'), F.lit('{"id": 1, "name": "x"}'), F.lit('{"full_name": "a/b"}')), ","), "repository-id:1,repository-key:a/b"),
    (lambda: N.dedup_key(F.lit(""), F.lit(4)), "4"),
    (lambda: F.array_join(N.record_ids(F.lit("u"), F.lit(5), F.lit("x1")), ","), "u,5"),
    (lambda: F.array_join(N.distinct_spellings(lit_array(" Go", "go", "", "C", None)), ","), "Go,C"),
    (lambda: N.resolve_group(F.lit(False), F.lit(""), F.lit("devin")), "devin"),
    (lambda: N.resolve_group(F.lit(True), F.lit("x"), F.lit("devin")), "humans"),
    (lambda: N.group_matches(F.lit("Humans"), "human"), True),
    (lambda: N.group_matches(F.lit("codex"), "agentic"), True),
    (lambda: N.group_matches(F.lit("codex"), "cursor"), False),
    (lambda: N.target_language(F.lit("Go"), F.lit(" Java"), lit_array("python"), ["Python", "Java"]), "java"),
    (lambda: N.target_language(F.lit(None).cast("string"), F.lit(""), lit_array("Rust", "JAVA"), ["Python", "Java"]), "java"),
    (lambda: N.target_language(F.lit(None).cast("string"), F.lit(""), lit_array("Rust"), ["Python"]), "rust"),
    (lambda: N.is_full_layout(F.lit("/d/FullPullRequests/x.parquet")), True),
    (lambda: N.is_full_layout(F.lit("/d/fullpullrequests2/x")), False),
    (lambda: N.is_excluded_repository(["A/B "], F.lit(None).cast("string"), F.lit("a/b")), True),
    (lambda: F.array_join(N.sort_paths(lit_array("b/c.py", "/Z.md", "a\\x.py", " ", "a.md")), " "), "a.md Z.md a/x.py b/c.py"),
    (lambda: F.array_join(N.touched_paths(F.lit('[{"path": "b/x"}, 3, {"filename": "a"}, {"new_path": ""}]')), " "), "a b/x"),
    (lambda: F.size(N.touched_paths(F.lit("{}"))), 0),
    (lambda: N.snapshots_status(lit_array()), "missing_snapshot"),
    (lambda: N.snapshots_status(lit_array("success", "no_source_files")), "partial_success"),
    (lambda: N.snapshots_status(lit_array("Success", "failed")), "partial_failure"),
    (lambda: N.snapshots_status(lit_array("failed")), "failed"),
    (lambda: N.reuse_reason(F.lit(0), F.lit(True), F.lit(True)), "future_no_cumulative_commit_touches"),
    (lambda: N.reuse_reason(F.lit(None).cast("int"), F.lit(True), F.lit(False)), "future_no_pr_file_overlap"),
    (lambda: N.reuse_reason(F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")), None),
    (lambda: N.snapshot_label(F.lit(" "), F.lit("x"), F.lit("7.0"), ["+7d"]), "+7d"),
    (lambda: N.snapshot_label(F.lit("AFTER"), F.lit("before"), F.lit(None).cast("string"), ["+7d"]), "after"),
    (lambda: N.standardize(F.lit(" none "), "string"), None),
    (lambda: F.length(T.text_window(F.lit("x" * 9000), 10)), 4096),
    (lambda: F.array_join(T.plural_variants(F.lit("library")), " "), "libraries librarys"),
    (lambda: F.array_join(T.plural_variants(F.lit("tools")), " "), "tool"),
    (lambda: T.topic_name(F.lit(" C++ ")), "c++"),
    (lambda: rules.catalog_slug(F.lit(' "C++ & F#" ')), "cplusplus-fsharp"),
    (lambda: rules.unquoted(F.lit("'a'")), "a"),
]


@pytest.mark.parametrize("part", range(4))
def test_records(spark, part):
    cases = RECORD_CASES[part::4]
    row = spark.range(1).select(*[c().alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [row[f"c{i}"] for i in range(len(cases))] == [w for _, w in cases]


def test_nested_values(spark):
    df = spark.createDataFrame([((1, [(2, "x"), (3, "y")], {"k": "v", "z": "w"}),)], "s struct<a:int,l:array<struct<b:int,k:string>>,m:map<string,string>>")
    p = df.select(N.prune(F.col("s"), df.schema["s"].dataType, {"a", "k"}).alias("p")).first().p
    assert p.asDict(True) == {"l": [{"b": 2}, {"b": 3}], "m": {"z": "w"}}
    kind = spark.createDataFrame([], "f array<struct<path:string>>").schema["f"].dataType
    got = spark.createDataFrame([([("a",)],)], "f array<struct<path:string>>").select(N.with_fields(F.col("f"), kind, ["path", "patch"]).alias("f")).first().f
    assert got[0].asDict() == {"path": "a", "patch": None}
    assert value(spark, N.file_list(F.lit('{"path": "a", "n": 1}'), "path string, n int"))[0].path == "a"
    assert value(spark, N.file_list(F.lit("[]"), "path string")) is None
    pairs = spark.createDataFrame([([("a.cpp", None), ("b.h", "old.h"), ("c.py", None), ("b.h", "old.h")],)], "f array<struct<path:string,previous_filename:string>>")
    assert [(x.before_path, x.after_path) for x in pairs.select(N.cpp_pairs("f").alias("p")).first().p] == [("a.cpp", "a.cpp"), ("old.h", "b.h")]
    assert [x.before_path for x in pairs.select(N.cpp_pairs("f", False).alias("p")).first().p] == ["a.cpp", "b.h"]
    preds = spark.createDataFrame([([(3, "c"), (None, "a"), (1, "b"), (0, "d")],)], "p array<struct<rank:int,topic:string>>")
    assert [x.topic for x in preds.select(N.ranked_predictions("p").alias("p")).first().p] == ["b", "a", "c", "d"]


def test_gates(spark):
    snap = "array<struct<status:string,snapshot_label:string,tool:string,notes:string,return_code:int>>"
    rows = [(1, None, "success", None), (2, 1, "Crashed", [("failed", "after", None, None, None), ("missing_snapshot", "x", "t", None, None)]), (3, 1, "skipped", [("failed", "a", "t", None, None)]), (4, 1, "failed", []), (5, 1, "failed", [("Error", "a", "t", "n" * 230 + "\n", 2)])]
    df = spark.createDataFrame(rows, f"id int, m int, status string, s {snap}").withColumn("stage", F.when(F.col("id") != 1, F.struct("status", F.col("s").alias("results"))))
    got = {r.id: r.g for r in df.select("id", N.gate_reasons(F.col("m").isNotNull(), F.col("stage").isNotNull(), "status", "s").alias("g")).collect()}
    assert got[1] == ["missing_metrics"] and got[2] == ["refactoring_stage:crashed", "refactoring_snapshot:after:unknown:failed"] and got[4] == ["refactoring_stage:failed"]
    got = {r.id: r.reasons for r in runs.gate(df, "m", "stage").collect()}
    assert got[3] == [] and got[4] == ["refactoring_stage:failed(no_snapshot_failure_details)"] and got[1] == ["missing_metrics"]
    assert got[5][0].startswith("refactoring_snapshot:a:t:error(notes=nnn") and got[5][0].endswith("...[truncated 10 chars])(return_code=2)")


def test_typed_records(spark):
    df = spark.createDataFrame([("7.0", "yes", '[{"name": "x"}, {"name": "y"}]', '{"login": "l"}', '[{"path": "p"}, 4]'), ("many", None, "none", "broken", "[]")], "number string, merged string, labels string, author string, files string")
    got = curation.cast_scalars(df, {"number": "int", "merged": "bool", "absent": "int"}).collect()
    assert (got[0].number, got[0].merged, got[0].uncast) == (7, True, {}) and got[1].uncast == {"number": "many"}
    got = curation.decode_columns(df, {"author": "struct<login:string>"}).collect()
    assert (got[0].label_count, got[0].author.login, got[1].label_count, got[1].author) == (2, "l", 0, None)
    schema = spark.createDataFrame([], "number bigint, title string, author struct<login:string>, files array<struct<path:string>>").schema
    got = curation.typed_pull_requests(df, schema, {"number": "int"})
    assert got.schema.simpleString() == schema.simpleString()
    assert [(r.number, r.files and r.files[0].path) for r in got.collect()] == [(7, "p"), (None, None)]
    kept = curation.without_unstable(spark.createDataFrame([(1, [2], "x")], "id int, reviews array<int>, mergeable string").withColumn("l", F.array("id")))
    assert kept.columns == ["id", "l"] and kept.first().l == "[1]"
    raw = spark.createDataFrame([({"title": None, "n": "3"}, "typed", 1), (None, "typed", 1)], "raw map<string,string>, title string, n int")
    assert [(r.title, r.n) for r in curation.prefer_raw(raw, "raw", ["title", "n"]).collect()] == [(None, "3"), ("typed", "1")]
    both = spark.createDataFrame([((None, "peek"), ("full", None))], "raw struct<f:string,p:string>, dto struct<f:string,p:string>")
    assert both.select(curation.repository_payload(both, "raw", "dto", "f", "p").alias("v")).first().v == "full"
    prs = spark.createDataFrame([("humans", "file", "1", "u", " T ", "2024-01-02T00:00:00Z", (5,), [("a",)])], "cohort string, source_file string, id string, url string, title string, created_at string, base_repository struct<id:long>, files array<struct<path:string>>")
    r = curation.public_pull_requests(prs, {"title": "string", "created_at": "timestamp", "absent": "int"}, ["files"]).first()
    assert (r.title, r.absent, r.files, r.pull_request_key, r.base_repository_snapshot_key, r.authored_by_agent, r.dedup_key) == ("T", None, '[{"path":"a"}]', "1", "1::repository_snapshot::5::BASE", False, "u")
    found = spark.createDataFrame([("p", (7, "r", True, None, ("Organization", "o"), ["t"]))], "k string, q struct<id:long,name:string,private:boolean,watchers_count:long,owner:struct<type:string,login:string>,topics:array<string>>")
    r = curation.repositories_from_search(found, "q", "BASE", "k").first()
    assert (r.id, r.is_private, r.visibility, r.is_in_organization, r.watchers, r.topics_count, r.stargazer_count, r.description) == ("7", True, "private", True, 0, 1, 0, None)


def test_curated_rows(spark):
    pr = "struct<id:string,author:struct<login:string,name:string>,base_repository_full:struct<id:string,url:string,name_with_owner:string>,additions:string,discovered_agent:string,file_languages:array<string>,time_bucket_day:string,popularity_bucket:string>"
    df = spark.createDataFrame([("c", "k", ("1", (None, "nm"), ("9", "u", "A/B"), "12", "codex", ["Go"], "2024-01-01", "pop1"), ("done",))], f"cohort string, pull_request_key string, pr {pr}, metrics struct<status:string>")
    r = curation.curated_pull_requests(df).first()
    assert (r.author, r.base_repository_key, r.base_repository_id, r.head_repository_key, r.additions, r.author_agent, r.file_languages_json, r.sampling_time_bucket, r.sampling_popularity_bucket, r.processing_status, r.longitudinal_selected) == ("nm", "a/b", "9", None, 12, "codex", '["Go"]', "2024-01-01", "pop1", "done", False)
    meta = spark.createDataFrame([(1, "o/r", "07", "text", ["l"], "3", "pop2", ["a", "b"]), (2, "o/x", "7", "late", None, None, None, None), (3, "o/y", None, None, None, None, None, None)], "at int, repository_key string, stable_repository_id string, readme string, labels array<string>, stargazer_count string, popularity_label string, files array<string>")
    rows = {r.repository_key: r for r in curation.repository_metadata(meta, ["at"]).collect()}
    assert set(rows) == {"o/r", "o/y"} and (rows["o/r"].readme, rows["o/r"].popularity_label, rows["o/r"].file_count, rows["o/r"].repository_owner, rows["o/y"].file_count) == ("text", "high", 2, "o", 0)


def aggregate_row(spark):
    later = {"status": "ok", "retention": {"retention_rate": 0.5}, "future_impact": {"touched_refactoring_zone_lines_count": 0, "touching_commits_count": 4}, "pr_changed_line_future_impact": {"touched_pr_lines_count": 6}, "refactor_count": 1, "refactor_type_count": {"b": 2, "a": 1, "z": 0}}
    s = {"snapshots": {"before": {"commit": "b"}, "after": {"path": "p"}, "future": {"+3d": {"commit": "f"}, "+7d": {"available": False, "commit": "g"}}}, "summary": {"refactor_count": 0, "refactor_added_lines": 3, "refactor_type_count": {"q": 1}, "refactor_future_snapshot_metrics": {"+3d": later, "+7d": later, "+9d": later}}}
    ddl = f"struct<snapshots:struct<{', '.join(x.replace(' ', ':', 1) for x in curation.SNAPSHOTS.split(', '))}>,summary:struct<{', '.join(x.replace(' ', ':', 1) for x in curation.REFACTORING_SUMMARY.split(', '))}>>"
    return spark.createDataFrame([("pr1", "success", json.dumps(s))], "k string, status string, j string").select("k", "status", F.from_json("j", ddl).alias("x")).select("k", "status", "x.*")


def test_result_tables(spark):
    df = aggregate_row(spark).withColumn("ops", F.array(F.lit(1), F.lit(2)))
    rows = {r.snapshot_label: r for r in curation.refactoring_results(df, ["k"], "ops").collect()}
    assert set(rows) == {"pr", "+3d"} and (rows["pr"].refop_count, rows["pr"].added_lines, rows["pr"].type_counts, rows["pr"].retention_rate) == (2, 3, '{"q":1}', None)
    f = rows["+3d"]
    assert (f.transition_label, f.snapshot_commit, f.retention_rate, f.lines_touched, f.touching_commits, f.refop_count, f.type_counts) == ("after_to_+3d", "f", 0.5, 6, 4, 1, '{"a":1,"b":2}')
    m = df.withColumn("measures", F.expr("map('before', map('ncloc', 5D, 'loc', 4D), '+3d', map('complexity', 2D, 'fanout_internal', 1D, 'smell_count', 3D))"))
    rows = {r.snapshot_label: r for r in curation.maintainability_results(m, ["k"]).collect()}
    assert set(rows) == {"before", "after", "+3d"} and rows["before"].loc == 4 and (rows["+3d"].cyclomatic_complexity, rows["+3d"].fan_out, rows["+3d"].smell_count, rows["+3d"].snapshot_key) == (2, 1, 3, "pr1@+3d") and rows["after"].loc is None
    assert df.select(curation.snapshot_summary("snapshots").alias("s")).first().s.asDict() == {"before": True, "after": True, "future": 2, "has_future_snapshots": True}
    snaps = spark.createDataFrame([("p", "before", "before", "c", None, None, None), ("p", "+3d", "future", None, None, None, None), ("p", "+7d", "future", None, None, True, None)], "k string, label string, kind string, commit string, path string, available boolean, missing_reason string")
    known = spark.createDataFrame([("p", "+7d", False, "deleted", "x")], "k string, label string, available boolean, missing_reason string, commit string")
    rows = {r.snapshot_label: r for r in curation.snapshot_manifests(snaps, known, "k").collect()}
    assert (rows["before"].available, rows["+3d"].missing_reason, rows["+7d"].available, rows["+7d"].missing_reason, rows["+7d"].snapshot_commit, rows["+7d"].target_offset_days) == (True, "missing_snapshot_unknown", False, "deleted", "x", 7)
    refs, blobs = curation.snapshot_files(spark.createDataFrame([("c", "a", bytearray(b"x")), ("c", "b", bytearray(b"x")), ("c", "z", bytearray(b"\xff"))], "cohort string, path string, content binary"), "cohort", "content")
    assert refs.count() == 3 and "content" not in refs.columns and sorted((r.content_text or "", r.is_binary) for r in blobs.collect()) == [("", True), ("x", False)]


def test_refactoring_values(spark):
    loc = "array<struct<file_path:string,start_line:int,end_line:int>>"
    ops = [("A", "low", [("f", 5, 3)], [("g", 1, None)]), ("A", None, [("f", 4, 6)], [(None, 1, 9)]), (None, "high", [], [("f", None, None)])]
    df = spark.createDataFrame([(1, ops), (2, [])], f"k int, ops array<struct<standardized_type:string,level:string,source_locations:{loc},target_locations:{loc}>>")
    r, e = curation.refactoring_values(df, "k", "ops").orderBy("k").collect()
    assert (r.refactor_count, r.type_counts, r.level_counts, r.removed_lines, r.added_lines, r.magnitude_files) == (3, '{"A":2,"unclassified":1}', '{"high":1,"low":1,"unclassified":1}', 4, 1, 2)
    assert r.density == pytest.approx(600) and r.diversity == pytest.approx(0.9182958) and (e.refactor_count, e.diversity, e.density, e.type_counts) == (0, 0.0, 0.0, "{}")
    one = curation.type_summary(spark.createDataFrame([(1, "b"), (1, " "), (1, "a"), (1, "b"), (2, None)], "k int, t string"), ["k"], "t").orderBy("k").collect()
    assert [(x.operations, x.type_counts) for x in one] == [(4, '{"a":1,"b":2}'), (1, "{}")]
    n = curation.count_by_field(spark.createDataFrame([("x",), ("",), (None,)], "t string"), [], "t").collect()
    assert sorted((x.t, x.n) for x in n) == [("unclassified", 2), ("x", 1)]
    ranges = curation.tracked_ranges(spark.createDataFrame([("p", 2, 4), ("p", 8, 7), (None, 1, 1)], "path string, start int, end int"), [])
    assert sorted((x.start, x.end) for x in ranges.collect()) == [(2, 4), (7, 7)]
    lines = spark.createDataFrame([(1, 0, "M\ta.py"), (1, 1, "R095\tb\\x.py\tc.py"), (1, 2, "D\t/d.py"), (1, 3, "noise")], "k int, number int, line string")
    paths = spark.createDataFrame([(1, "a.py"), (1, "b/x.py"), (1, "d.py"), (1, "e.py"), (1, " ")], "k int, path string")
    got = {x.path: (x.status, x.new_path) for x in curation.path_statuses(paths, lines, ["k"], "path").collect()}
    assert got == {"a.py": ("m", None), "b/x.py": ("renamed", "c.py"), "d.py": ("deleted", None), "e.py": (None, None)}


def test_metric_rows(spark):
    df = spark.createDataFrame([("s1", 3, '{"overall": {"loc": 10, "odd": 1}, "files": {"a": {}, "b": {}}, "stats": {"x": 1}}'), ("s2", 4, '{"overall": 3}'), ("s3", 5, None)], "id string, files_considered int, r string")
    rows = curation.metric_rows(df, ["id", "files_considered"], "r")
    got = {r.id: r for r in rows.collect()}
    assert (got["s1"].status, got["s1"].loc, got["s1"].files_analyzed, got["s1"].fanout_internal) == ("success", 10.0, 2, None) and (got["s2"].status, got["s2"].files_analyzed) == ("parse_failed", 0) and got["s3"].error_message
    e = curation.empty_rows(df.drop("r"), ["id", "files_considered"], "no_source_files").first()
    assert e.status == "no_source_files" and e.loc is None and e.error_message is None
    keyed = rows.withColumn("pr", F.lit("p"))
    target = spark.createDataFrame([("p", "s9", 0)], "pr string, id string, files_considered int")
    r = curation.reuse_rows(keyed.where("id = 's1'"), target, ["pr"], "id", "same").first()
    assert (r.id, r.loc, r.reused, r.reused_from, r.files_considered) == ("s9", 10.0, True, "s1", 0) and json.loads(r.stats_json) == {"x": 1, "_reuse": {"reused": True, "reused_from": "s1", "reuse_reason": "same"}}
    emb = spark.createDataFrame([(None, "c", "+3d", None, None, "4"), ("own", "c", "after", "x", "failed", None)], "cohort string, pr_cohort string, snapshot_label string, snapshot_kind string, status string, loc string")
    got = curation.embedded_rows(emb, ["cohort"], ["loc"]).collect()
    assert [(r.cohort, r.snapshot_kind, r.status) for r in got] == [("c", "future", "success"), ("own", "x", "failed")]
    o = curation.overlay(spark.createDataFrame([("after", 1.0, 2.0, 3.0), ("+3d", 1.0, 2.0, 3.0)], "label string, v double, post double, pre double"), "label", "v", {"after": "post", "before": "pre"})
    assert [r.v for r in o.collect()] == [2.0, 1.0]


def test_values_and_results(spark):
    v = spark.createDataFrame([("humans", "0d", "m", 1.0), ("codex", "0d", "m", float("nan")), ("codex", "0d", "m", 2.0), ("codex", "+3d", "m", 3.0), ("codex", "0d", "old", 9.0)], "cohort string, label string, metric string, value double")
    assert [r.value for r in curation.select_values(v, "m", "0d", group="agent").collect()] == [2.0] and curation.select_values(v, "m", "0d", cohort="humans").count() == 1
    other = spark.createDataFrame([("codex", "0d", "src", 5.0), ("codex", "0d", "src", None), ("codex", "0d", "x", 1.0)], v.schema)
    assert sorted((r.metric, r.value) for r in curation.inject_metrics(v, other, {"src": "old"}).where("metric = 'old'").collect()) == [("old", 5.0)]
    s = spark.createDataFrame([("cohort:a", "m", 1.0), ("overall", "m", 2.0), ("cohort:a", "n", 3.0)], "scope string, metric string, value double")
    assert [tuple(r) for r in curation.cohort_scopes(s, "m").collect()] == [("a", 1.0)]
    c = spark.createDataFrame([("c", "agent", "x", "java", "0", "0.5", 6, 2, 2000, '{"A": 2, "unclassified": 9}', '{"low": 2}')], "cohort string, authorship_group string, agent_label string, language string, refactor_count string, refactor_diversity string, added int, removed int, nloc_before int, type_counts string, level_counts string")
    r = curation.compact_refactoring(c).first()
    assert (r.RefCount, r.RefDensity, r.RefAdded, r.RefMagLines, r.type_counts) == (2.0, 1.0, 3.0, 4.0, '{"A":2}')
    prs = spark.createDataFrame([("Humans", "human", 1), ("codex", "agent", 0), ("aider", "agent", 1)], "cohort string, authorship_group string, n int")
    out = curation.result_rows(prs, lambda d, by: d.groupBy(*by).agg(F.count(F.lit(1)).alias("eligible")), F.col("n") == 0).orderBy("rank", "label").collect()
    assert [(r.scope, r.label, r.eligible) for r in out] == [("overall", "overall", 3), ("authorship_group", "agent", 2), ("authorship_group", "human", 1), ("cohort", "Humans", 1), ("cohort", "aider", 1), ("cohort", "codex", 1)]
    assert out[0].failed_share == pytest.approx(1 / 3)


def test_errors_and_statistics(spark):
    res = "array<struct<snapshot_label:string,tool:string,status:string,tool_runs:array<struct<tool:string,status:string>>>>"
    stage = spark.createDataFrame([("p", "Failed", [("after", "t", "error", [("x", "completed"), ("y", "crashed")]), ("before", "t", "success", [])])], f"k string, status string, results {res}")
    ok = spark.createDataFrame([("p", "success", [])], f"k string, status string, results {res}")
    prs, hyd = spark.createDataFrame([("p", "u"), ("q", "v")], "k string, url string"), spark.createDataFrame([("p", "m")], "k string, merge_commit string")
    rows = {r.k: r for r in curation.pull_request_aggregates(prs, hyd, stage, ok, "k").collect()}
    assert rows["p"].metrics.errors.total_count == 2 and rows["p"].hydration.merge_commit == "m" and [e.scope for e in rows["p"].metrics.errors.refactoring] == ["stage", "snapshot"] and rows["q"].metrics.errors.total_count == 0
    errors = curation.run_errors(stage.select("k", F.struct("status", "results").alias("refactoring")), "k", ["refactoring"]).collect()
    assert sorted((e.source, e.tool) for e in errors if e.tool) == [("aggregate_snapshot", "t"), ("tool_run", "y")] and len(errors) == 3
    a = spark.createDataFrame([("java", 2, 10.0)], "language string, n int, seconds double")
    b = spark.createDataFrame([("java", 3, 5.0), ("go", 0, 0.0)], a.schema)
    assert {r.language: (r.n, r.mean_seconds) for r in curation.merge_run_statistics(a, b, ["language"]).collect()} == {"java": (5, 3.0), "go": (0, 0.0)}
    sel, meta = spark.createDataFrame([("u",), ("u",), ("w",)], "url string"), spark.createDataFrame([("u", "go"), ("w", ""), ("x", "c")], "url string, language string")
    assert [tuple(r) for r in curation.selected_by_language(sel, meta, "url", "language").collect()] == [("go", 1)]
    agg = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("", 3, "c")], "url string, at int, v string")
    assert [r.v for r in curation.aggregates_by_url(agg, "url", ["at"]).collect()] == ["b"]


CATALOG = [("machine-learning", ["ml", "machinelearning"], "a"), ("ml", ["c++"], "b"), ("library", ["lib-2"], "c")]


def test_rule_tables(spark):
    entries = spark.createDataFrame(CATALOG, "topic string, aliases array<string>, source string")
    terms = rules.catalog_terms(entries)
    assert {r.term for r in terms.collect()} == {"machine-learning", "machinelearning", "ml", "cplusplus", "library", "lib-2", "lib2"}
    choices = rules.alias_choices(terms)
    got = {r.term: (r.canonical, r.conflict) for r in choices.collect()}
    assert got["ml"] == ("ml", True) and got["machinelearning"] == ("machine-learning", False) and got["lib2"] == ("library", False)
    made = rules.rule_rows(entries, choices)
    by = {}
    for r in made.collect():
        by.setdefault(r.rule_file, set()).add(tuple(r.body))
    assert set(by) == set(rules.TABLES) - {"integer_topics"}
    assert by["replace"] == {("ml", "cplusplus"), ("machine-learning", "machinelearning"), ("library", "lib-2"), ("library", "lib2")}
    assert by["delete"] == {("ml", "-1")} and ("machine-learning", "-2") in by["split_dash_topics"] and ("machine-learning", "machine", "learning") in by["abbr"]
    assert ("libraries", "library") in by["remove_plural_topics"] and ("lib-2", "library") in by["topics_contains_version"] and ("lib2", "library") in by["contractions"]
    assert rules.indexed(made).where("rule_file = 'replace'").orderBy("index").first().body == ["library", "lib-2"]
    old = [("replace", ["1", "Library", "books"]), ("replace", ["2", "nothing", "x"]), ("replace", ["3", "ml", "lib2"]), ("delete", ["4", "junk", "-1"]), ("delete", ["5", "junk"]), ("replace", ["6", "library", "lib2"]), ("contains_top_topics", ["7", "mach", "ML", "c++"])]
    former = rules.normalize_rules(spark.createDataFrame(old, "rule_file string, row array<string>"), choices, entries.select("topic"))
    got = {r.row[0]: (r.action, r.body) for r in former.collect()}
    assert got["1"] == ("candidate", ["library", "books"]) and got["2"][0] == "dropped_non_catalog_output" and got["5"][0] == "dropped_malformed" and got["7"] == ("candidate", ["mach", "ml", "ml"])
    active, audit = rules.merge_rules(made, former)
    assert {tuple(r.body) for r in active.where("rule_file = 'replace'").collect()} == by["replace"] | {("library", "books")}
    said = {(r.rule_file, tuple(r.body)): r.action for r in audit.collect()}
    assert said["replace", ("ml", "lib2")] == "conflict_lost" and said["replace", ("library", "lib2")] == "deduped" and said["delete", ("junk", "-1")] == "included"
    n = {r.rule_file: r for r in rules.merge_counts(made, former, active).collect()}["replace"]
    assert (n.former, n.generated, n.active, n.deduped, n.conflicts, n.dropped) == (4, 4, 5, 1, 1, 1)


def test_training_tables(spark):
    rows = [(i, f"o/r{i}", ["a", "b"] if i % 2 else ["a", "rare" if i == 2 else "b"], ["common", "word", f"odd{i}"] if i != 4 else ["only"]) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, repository_key string, topics array<string>, tokens array<string>")
    out = training.create_training_data(df, "topics", "tokens", 2, 2, 3, excluded=["O/R1"])
    got = {r.id: r for r in out["records"].collect()}
    assert set(got) == {0, 2, 3, 5, 6, 7} and got[2].final_topics == ["a"] and got[2].labels == [1, 0] and got[0].prepared_text == "common word"
    assert {r.id: r.reason for r in out["rejects"].collect()} == {1: "skipped_repository", 4: "empty_prepared_text"}
    recs = [(f"r{i}", "t" if i else " ", [1, 0] if i != 1 else [0, 0]) for i in range(30)] + [(None, "t", [1, 0])]
    df = spark.createDataFrame(recs, "identity_key string, prepared_text string, labels array<int>")
    meta = spark.createDataFrame([(f"r{i}", str(i), "2024-05-01T00:00:00Z" if i != 2 else "never") for i in range(29)], "identity_key string, stars string, created_at string")
    n = {(r.kind, r.label): r.n for r in training.eligibility_counts(training.eligible_records(df, meta)).collect()}
    assert n["excluded", "missing_identity"] == n["excluded", "empty_prepared_text"] == n["excluded", "empty_label_vector_after_topic_filter"] == n["excluded", "missing_metadata"] == n["excluded", "invalid_repository_created_at"] == 1
    assert n["stratum", "1-18|2024-Q2"] == 16 and n["stratum", "19+|2024-Q2"] == 10
    s = training.sample_training_data(df, meta, 13, 0.8)
    got = s.collect()
    assert len(got) == 13 and {r.stratum for r in got} == {"1-18|2024-Q2", "19+|2024-Q2"} and sum(r.split == "train" for r in got) == 10
    with pytest.raises(ValueError):
        training.sample_training_data(df, meta, 100, 0.8)


def test_training_outputs_and_samples(spark, tmp_path):
    s = spark.createDataFrame([("r1", 'a "b", c', [1, 0], "train"), ("r2", "d", [0, 1], "test")], "identity_key string, prepared_text string, labels array<int>, split string")
    training.write_training_data(s, str(tmp_path / "t"), ["x", "y"])
    r = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/t/train").first()
    assert (r.x, r.y, r.labels_vector, r.text) == ("1", "0", "[1 0]", 'a "b", c') and spark.read.json(f"{tmp_path}/t/metadata").count() == 2
    found = spark.createDataFrame([("a", "2024", "q", 1, "m1"), ("a", "2024", "q", 1, "m1"), ("a", "2023", "q", 2, "m0"), ("b", "2022", "q", 1, "m"), ("c", "2025", "q", 1, "m")], "repo string, bucket string, query string, page int, metadata string")
    got = training.collect_repositories(found, "repo", 2)
    assert {r.repo: (len(r.searches), r.metadata) for r in got.collect()} == {"a": (2, "m0"), "b": (1, "m")}
    assert {r.repo for r in training.collect_repositories(found, "repo", 2, got.where("repo = 'a'")).collect()} == {"a", "b"}
    prs = spark.createDataFrame([(f"u{i}", "Java" if i % 3 else "Python", None, None, f"2024-01-0{1 + i % 2}T00:00:00Z", i % 4 * 10) for i in range(60)], "url string, language string, primary_language string, languages array<string>, created_at string, stars int")
    sample, balance = training.sample_pull_requests(prs, 20, ["Java", "Python"])
    assert sample.count() == 20 and {r.dimension for r in balance.collect()} == {"language_bucket", "time_bucket", "popularity_bucket"}


def test_runs_resume(spark, tmp_path):
    c = spark.createDataFrame([(i, f"r{i % 2}") for i in range(6)], "id int, repo string")
    out = str(tmp_path / "runs")

    def work(pdf):
        return pdf.assign(status=["failed" if i == 3 else "success" for i in pdf["id"]])[["id", "status"]]

    process = lambda d: runs.process_by_repository(d, "repo", work, "id int, status string", salt=2)
    go = lambda run, n, **kw: {r.status: r.n for r in runs.run_curation(c, out, run, "id", lambda d: d.where(f"id < {n}"), process, **kw).collect()}
    assert go("r1", 4) == {"success": 3, "failed": 1}
    assert go("r2", 6, retry_failed=False) == {"success": 5, "failed": 1}
    assert go("r3", 6) == {"success": 5, "failed": 1} and spark.read.parquet(f"{out}/run=r3").count() == 1
    assert go("r2", 6, retry_failed=False) == {"success": 5, "failed": 1} and spark.read.parquet(f"{out}/run=r2").count() == 2


def test_reports_of_blocks_and_designs(spark):
    text = "noise\nDetected refactorings\nThe following refactorings were detected:\n====\n1)\nRename Method  a to b\nin file x\n12\n2)\nMove\tc\n\n3)\nInline\nLines changed in total: 3\nDetected functionality changes\n4)\nNo  more\n"
    assert parsers.block_operations_of(text) == [(0, "Rename Method", "a to b in file x"), (1, "Move", "c"), (2, "Inline", "Inline")]
    assert parsers.block_operations_of("1)\nx") == parsers.block_operations_of(None) == []
    report = json.dumps({"results": [{"smells": [{"name": "God", "file": "a", "startLine": "3", "priority": 2}, {"line": 1}]}, [{"rule": "Long", "details": "d", "beginColumn": 4.0}]]})
    df = spark.createDataFrame([(1, report), (2, "broken"), (3, None)], "id int, r string")
    rows = parsers.design_findings(df, ["id"], "r").collect()
    assert [(r.id, r.smell, r.path, r.line, r.column, r.severity, r.message) for r in rows] == [(1, "God", "a", 3, None, "2", "God"), (1, "Long", None, None, 4, None, "d")]
    got = parsers.block_operations(spark.createDataFrame([(7, text)], "id int, r string"), ["id"], "r").collect()
    assert [(r.id, r["index"], r.raw_type) for r in got] == [(7, 0, "Rename Method"), (7, 1, "Move"), (7, 2, "Inline")]


def test_file_tokens_and_lemmas(spark):
    ok = frozenset({"user", "api", "client", "test"})
    words = ["client", "test", "user", "api"]
    assert T.split_known("userapiclient", words, ok) == ["user", "api", "client"] and T.split_known("userfoo", words, ok) == ["userfoo"]
    assert T.split_known("fooapitest", words, None) == ["foo", "api", "test"] and T.split_known(" API ", words, ok) == ["api"] and T.split_known(None, words, ok) == []
    df = spark.createDataFrame([("userapi",), ("userapi",), (None,)], "t string")
    assert [r.x for r in df.select(T.split_known_tokens("t", words, list(ok)).alias("x")).collect()] == [["user", "api"], ["user", "api"], []]
    toks = spark.createDataFrame([("boxes",), ("women",), ("went",), ("bus",), (None,)], "w string")
    vocab, odd = spark.createDataFrame([("box",), ("boxe",), ("woman",), ("bus",)], "lemma string"), spark.createDataFrame([("went", "go")], "token string, lemma string")
    assert {r.token: r.lemma for r in taxonomy.lemmas(toks, "w", vocab, odd).collect()} == {"boxes": "box", "women": "woman", "went": "go", "bus": "bus"}


def test_limits_order_and_neighbours(spark):
    v = spark.createDataFrame([(float(x),) for x in range(101)] + [(None,), (float("nan"),)], "v double")
    r = aggregate.capped_limits(v, "v").first()
    assert (r.lower, r.below_count, r.above_count, r.total_count, r.is_clipped) == (0.0, 0, 0, 101, False) and r.upper == pytest.approx(99 * 1.06)
    assert aggregate.capped_limits(v.where("v is null"), "v").count() == 0
    r = aggregate.capped_limits(spark.createDataFrame([(-2.0,)], "v double"), "v").first()
    assert (r.lower, r.upper) == pytest.approx((-2.12, 0.12))
    shares = spark.createDataFrame([("g", "a", 10.0), ("g", "b", 30.0), ("h", "a", 30.0)], "g string, l string, s double")
    assert [(x.l, x.mean_share) for x in aggregate.labels_by_share(shares, "g", "l", "s", ["c", "a", "b"]).orderBy("position").collect()] == [("a", 20.0), ("b", 15.0), ("c", 0.0)]
    import random

    rng = random.Random(5)
    t = [(i, rng.randrange(3), rng.randrange(6), rng.randrange(9)) for i in range(40)]
    p = [(100 + i, rng.randrange(3), rng.choice([0, 2, 5]), rng.randrange(9)) for i in range(30)]
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} int, g int, b int, v int")
    got = {r.t: r.p for r in relational.nearest_in_buckets(df(t, "t"), df(p, "p"), ["g"], "b", "v", "t", "p").collect()}
    want = {i: min((abs(b - c), abs(v - w), w, k) for k, h, c, w in p if h == g)[3] for i, g, b, v in t}
    assert got == want
    e = [(g, rng.randrange(20), i) for i, g in enumerate([0, 1] * 30)]
    out = relational.asof_next(spark.createDataFrame(e, "g int, at int, i int"), spark.createDataFrame([(g, a, 100 + i) for g, a, i in e], "g int, t int, n int"), ["g"], "at", "t", "n").collect()
    for r in out:
        later = min(((a, 100 + i) for g, a, i in e if g == r.g and a > r["at"]), default=(None, None))
        assert (r.next_at, r.next_value) == later


def test_threshold_metrics_by_hand(spark):
    scored = spark.createDataFrame([(k, t, s) for k, row in enumerate([(0.9, 0.6, 0.1), (0.1, 0.8, 0.9), (0.2, 0.1, 0.3)]) for t, s in zip("abc", row)], "id int, topic string, score double")
    truth = spark.createDataFrame([(0, "a"), (0, "c"), (1, "b"), (2, "a")], "id int, topic string")
    m = learning.threshold_metrics(scored, truth, "id", 0.5).first()
    want = dict(precision=2 / 4, recall=2 / 4, f1=0.5, success_rate=2 / 3, coverage=1.0, hamming_loss=4 / 9, subset_accuracy=0.0, mean_labels=4 / 3, precision_macro=(1 + 0.5 + 0) / 3, recall_macro=(0.5 + 1 + 0) / 3, precision_samples=(0.5 + 0.5 + 0) / 3, recall_samples=(0.5 + 1 + 0) / 3)
    want |= dict(ranking_loss=(1 / 2 + 1 / 2 + 1) / 3 + (1 / 2 + 0) / 3, coverage_error=(3 + 2 + 3) / 3, auc_macro=((1 + 0.5) / 2 + (1 + 1 - 0.5) / 2 + (1 + 0 - 0.5) / 2) / 3, average_precision_macro=((0.5 + 0.5 * 2 / 3) + 0.5 + 1 / 3) / 3)
    want.pop("ranking_loss")  # pairs (true, false) that the decision does not part: 1 of 2 and 1 of 2 for the first key, ...
    assert {k: m[k] for k in want} == pytest.approx(want)
    assert m.ranking_loss == pytest.approx((2 / 2 + 1 / 2 + 2 / 2) / 3)


def test_features_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "MyOrg", "webApp", "A the tool", "word " * 500, None, ["src/userApi/userApi.py", "README.md"], ["b", "a", "b"]), (2, None, None, None, None, None, None, None)], "id int, owner string, name string, description string, readme string, wiki string, files array<string>, topics array<string>")
    a, b = training.repository_features(df, ["id"], ["the"]).orderBy("id").collect()
    assert a.token_counts.asDict() == {"name": 4, "description": 2, "readme": 400, "wiki": 0, "files": 6} and a.inference_text.startswith("my org web app a tool word") and a.inference_text.endswith("readme md src user api py")
    assert (a.has_readme, a.has_wiki, a.file_count, a.observed_topics) == (True, False, 2, ["a", "b"]) and (b.inference_text, b.file_count, b.observed_topics) == ("", 0, [])
    facts = spark.createDataFrame([("c", "1", "2024-01-03 05:00:00", "go", "pop0", "r", 3, None, 1), ("c", "2", "2024-01-04 05:00:00", "go", "pop1", "r", 4, 2, 1)], "cohort string, id string, created_at string, language string, popularity string, repository string, changed_lines int, changed_files int, stars int").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    dom = spark.createDataFrame([("r", "Web", 0.8), ("r", "Web", 0.8), ("r", "AI", 0.9)], "repository string, domain string, confidence double")
    t = curation.dataset_tables(facts, dom)
    assert [(str(r.week), r.n) for r in t["weeks"].collect()] == [("2024-01-01", 2)] and t["hours"].first().hour == 5 and t["confidences"].count() == 2 and t["numbers"].count() == 5
    assert sorted((r.domain, r.n, r.repositories) for r in t["domains"].collect()) == [("AI", 2, 1), ("Web", 2, 1)]
    assert curation.fan_out(facts, str(tmp_path / "f"), {"a": lambda d: d.select("id"), "b": lambda d: d.where("id = '1'")}) == {"a": 2, "b": 1}
