"""Operators against plain Python on small rows."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import aggregate, facts, learning, metrics, parsers, relational, sampling, stats, taxonomy
from sluice.sources import readers, writers
from sluice.streaming import events


def test_merge_and_overlap(spark):
    df = spark.createDataFrame([("f", 1, 3), ("f", 4, 6), ("f", 9, 9), ("g", 1, 5)], "path string, start int, end int")
    assert sorted(map(tuple, relational.merge_ranges(df, ["path"]).collect())) == [("f", 1, 6), ("f", 9, 9), ("g", 1, 5)]
    other = spark.createDataFrame([("g", 4, 8)], "path string, start int, end int")
    assert relational.interval_overlap(df, other, ["path"], 3).select("overlap").collect() == [(2,)]


def test_fallback_and_lookup(spark):
    left = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3")], "id int, key string")
    right = spark.createDataFrame([(1, "zz", "by id"), (9, "k2", "by key")], "id int, key string, v string")
    got = {r.id: r.v for r in relational.fallback_join(left, right, ["id"], ["key"], ["v"]).collect()}
    assert got == {1: "by id", 2: "by key", 3: None}
    asked = spark.createDataFrame([("k3", 0), ("k1", 1), ("no", 2)], "key string, pos int")
    assert [r.key for r in relational.lookup_in_order(asked, left, "key", "pos").collect()] == ["k3", "k1"]


def test_cliffs_delta_equals_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 40).tolist(), rng.integers(0, 9, 30).tolist()
    df = spark.createDataFrame([("f", "a", x) for x in a] + [("f", "b", x) for x in b] + [("f", "b", None)], "f string, g string, v int")
    r = stats.mann_whitney(df, ["f"], "v", "g", "a", "b").first()
    assert r.delta == pytest.approx(sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b))) and (r.n1, r.n2) == (40, 30)
    back = stats.mann_whitney(df, ["f"], "v", "g", "b", "a").first()
    assert back.delta == pytest.approx(-r.delta)
    ci = stats.delta_interval(df, ["f"], "v", "g", "a", "b").first()
    assert ci.ci_low <= r.delta <= ci.ci_high
    m = stats.median_interval(df, ["g"], "v").where("g = 'a'").first()
    assert m.ci_low <= m.median <= m.ci_high and m.median == np.median(a)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", 0, 0.01), ("f", 1, 0.04), ("f", 2, 0.03), ("f", 3, None)], "f string, i int, p_value double")
    got = {r.i: r.p_adjusted for r in stats.benjamini_hochberg(df, ["f"]).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([0.03, 0.04, 0.04]) and got[3] is None


def test_p_values(spark):
    p = stats.chi_square_p(spark.createDataFrame([(3.841458820694124, 1), (0.0, 2), (30.0, 10)], "chi2 double, dof long")).select("p_value").collect()
    assert [x[0] for x in p] == pytest.approx([0.05, 1.0, 0.0008566412], rel=1e-5)
    assert stats.normal_p(spark.createDataFrame([(1.959963984540054,), (None,)], "z double")).collect()[0].p_value == pytest.approx(0.05)


def test_summary(spark):
    r = aggregate.distribution_summary(spark.createDataFrame([("a", float(x)) for x in (0, 0, 2, 4)], "g string, v double"), ["g"], "v").first()
    assert (r.mean, r.median, r.median_nonzero, r.zero_percentage) == (1.5, 1.0, 3.0, 50.0)


def test_sampling(spark):
    df = spark.createDataFrame([(s,) for s, n in ((0, 5), (1, 1), (9, 3)) for _ in range(n)], "stars int")
    assert sorted(r.cut for r in sampling.cut_points(df, "stars", 3).collect()) == [0, 1]
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    assert {r.k: r.quota for r in sampling.proportional_quotas(sizes, "k", "n", 5).collect()} == {"a": 3, "b": 1, "c": 1}
    for target in (0, 1, 7, 9, 10, 50):
        got = sampling.allocate({"a": 5, "b": 3, "c": 2, "d": 0}, target)
        assert sum(got.values()) == min(target, 10) and all(got[k] <= v for k, v in {"a": 5, "b": 3, "c": 2, "d": 0}.items())
    assert sampling.even_quotas(["a", "b", "c"], 8) == {"a": 3, "b": 3, "c": 2}


def test_facts_order_of_steps(spark):
    cols = "cohort string, source_file string, row_index long, id string, url string, number string, created_at string, additions string, deletions string, changed_files string, authored_by_agent string, author_agent string, language string, repository_id string, repository_name string, stars string"
    row = lambda i, c="x", repo="7.0", num="1", by="false", agent=None: (c, "f", i, str(i), None, num, "2025-01-02T03:04:05Z", "3", None, "1", by, agent, "Python", repo, "A/B", "20")
    rows = [row(0, by="true", agent="Bad"), row(1), row(2), row(3, repo=None), row(4, repo=None), row(5, c="y")]
    got = facts.pr_facts(spark.createDataFrame(rows, cols), excluded=["bad"])
    assert sorted(int(r.id) for r in got.collect()) == [1, 3, 4, 5]
    one = got.where("id = '1'").first()
    assert (one.changed_lines, one.dedup_key, one.popularity, one.language, str(one.created_at)) == (3, "x:7#1", "pop2", "python", "2025-01-02 03:04:05")


def test_topic_assignments(spark):
    rows = [("7.0", "a/b", [("graphics", None, None, 0.7), ("Graphics", None, None, 0.9), ("Other", None, None, 1.0), ("Web and Mobile", None, 0.6, None)])]
    schema = "repository_id string, repository_key string, predicted_topic_domains array<struct<topic_domain:string,score_sum:double,top_topic_score:double,score_max:double>>"
    assert [(r.domain, r.confidence) for r in facts.topic_assignments(spark.createDataFrame(rows, schema)).collect()] == [("Graphics", 0.7)]


def test_retention_and_levels(spark):
    df = spark.createDataFrame([("p", s) for s in ("retained", "retained", "weakly_retained", "not_retained")], "k string, s string")
    assert metrics.retention_summary(df, ["k"], "s").first().retention_rate == 0.75
    dim = taxonomy.level_dim(spark, ["Move Class"])
    counts = spark.createDataFrame([(1, {"extract_method": 2, "Move-Class": 1, "unclassified": 5}), (2, {})], "id int, m map<string,int>")
    got = {r.id: (r.low, r.medium, r.high) for r in taxonomy.level_counts(counts, ["id"], "m", dim, ["low", "medium", "high"]).collect()}
    assert got == {1: (0, 2, 1), 2: (0, 0, 0)}


def test_longitudinal_series(spark):
    snap = "struct<refactoring_tool_collected:boolean,refactor_count:int,trackable:int,retention_rate:double,touched_lines:double,touching_commits:int>"
    df = spark.createDataFrame([("p", 2, {"+3d": (True, 3, 2, 0.5, 8.0, -1), "+4d": (True, 9, 9, 1.0, 1.0, 1), "+7d": (False, 9, 0, 1.0, 0.0, 4)})], f"k string, n int, s map<string,{snap}>")
    got = {(r.label, r.metric): r.value for r in metrics.refactoring_series(df, ["k"], "n", "s").collect()}
    assert got[("0d", "RefRetentionRate")] == 1.0 and got[("+3d", "RefZoneFutureTouchedLines")] == 4.0 and got[("+3d", "RefRetentionRate")] == 0.5
    assert ("+3d", "FutureTouchingCommits") not in got and ("+7d", "RefCount") not in got and ("+7d", "RefRetentionRate") not in got and all(k[0] != "+4d" for k in got)


def test_touched_lines_and_availability(spark):
    zones = spark.createDataFrame([("f", 1, 5), ("f", 3, 8)], "path string, start int, end int")
    later = spark.createDataFrame([("f", 4, 4, "+3d"), ("f", 4, 9, "+3d"), ("f", 20, 30, "+7d")], "path string, start int, end int, label string")
    assert [(r.label, r.touched_lines) for r in metrics.touched_lines(zones, later, ["path"], ["label"]).collect()] == [("+3d", 5)]
    want = spark.createDataFrame([("p", "a"), ("p", "b")], "k string, path string")
    seen = spark.createDataFrame([("p", "a", "present")], "k string, path string, status string")
    assert metrics.file_availability(want, seen, ["k"], "path", "status").first().availability == "partial"


def test_compiler_report(spark):
    report = "src/a.cpp:12:3: warning: unused [readability]\nnoise\nb.c:7: error: bad"
    rows = parsers.compiler_findings(spark.createDataFrame([(1, report)], "id int, r string"), ["id"], "r").collect()
    assert [(r.path, r.line, r.column, r.severity, r.rule) for r in rows] == [("src/a.cpp", 12, 3, "warning", "readability"), ("b.c", 7, None, "error", "")]
    found = parsers.json_findings(spark.createDataFrame([(1, '{"files": [{"p": "x", "n": 2}]}')], "id int, r string"), ["id"], "r", "files array<struct<p:string,n:int>>", "files").first()
    assert (found.p, found.n) == ("x", 2)


def test_ranking_metrics(spark):
    scored = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.1), (2, "a", 0.2), (2, "b", 0.8), (2, "c", 0.25)], "id int, topic string, score double")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id int, topic string")
    one = learning.at_k(scored, truth, "id", [1, 2]).orderBy("k").collect()
    assert (one[0].precision, one[0].recall, one[0].success) == (1.0, 1.0, 1.0) and one[1].precision == 0.5
    assert learning.lrap(scored, truth, "id").first().lrap == pytest.approx((1 + (1 + 2 / 3) / 2) / 2)
    assert learning.predict(scored, "id", threshold=0.25).where("id = 2").count() == 1
    m = learning.threshold_metrics(scored, truth, "id", 0.25).first()
    assert (m.precision, m.recall) == pytest.approx((2 / 3, 2 / 3))


def test_topic_model(spark):
    rows = [(i, "graphics render shader pixel" if i % 2 else "http server database query", ["g"] if i % 2 else ["b"]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, text string, topics array<string>")
    feats = learning.tfidf_pipeline("text", 100).fit(df).transform(df)
    models = learning.fit_one_vs_rest(feats, "features", "topics", ["g", "b", "none"], 10)
    best = learning.predict(learning.scores(feats, models, "features", "id"), "id", k=1)
    assert set(models) == {"g", "b"} and best.where("(id % 2 = 1) != (topic = 'g')").count() == 0


def test_readers_and_writers(spark, tmp_path):
    spark.createDataFrame([(1, {"a": 1})], "n int, m map<string,int>").write.parquet(f"{tmp_path}/root/c1/x/batch-1.parquet")
    spark.createDataFrame([(2, "t")], "n int, extra string").write.parquet(f"{tmp_path}/root/c2/x/batch-2.parquet")
    df = readers.read_cohorts(spark, f"{tmp_path}/root", "part-*", ["n", "absent"])
    assert sorted((r.cohort, r.n) for r in df.collect()) == [("c1", 1), ("c2", 2)] and "absent" not in df.columns
    assert readers.read_cohorts(spark, f"{tmp_path}/root", "part-*", ["n"], exclude=["C1"]).count() == 1
    assert readers.leaf_paths(spark.createDataFrame([], "a struct<b:int,c:array<struct<d:int>>>, e int").schema) == ["a.b", "a.c.d", "e"]
    with pytest.raises(ValueError):
        readers.preflight(df, ["n", "no.such"])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert readers.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int").where("a is not null").count() == 2
    assert readers.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int", "keep").cache().where("_corrupt_record is not null").count() == 1
    (tmp_path / "ids.txt").write_text("# c\nhttp://a/\tid1\n")
    assert {r.identifier for r in readers.read_identifiers(spark, f"{tmp_path}/ids.txt").collect()} == {"http://a/", "http://a", "id1"}
    schema = spark.createDataFrame([], "n long, z string").schema
    assert writers.conform(df, schema).schema.simpleString() == schema.simpleString()
    refs, blobs = writers.content_blobs(spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x"))], "path string, content binary"))
    assert refs.count() == 2 and blobs.count() == 1
    assert json.loads(writers.manifest({"t": df}, {"t": "n"}))["t"]["primary_key"] == "n"


def test_stream_resumes_and_appends_once(spark, tmp_path):
    src, out, ckpt = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt"
    schema = "id long, url string"
    spark.createDataFrame([(1, "u1"), (2, "u2"), (2, "u2")], schema).write.parquet(src)
    go = lambda: events.run_now(events.stream_table(spark, src, schema), ckpt, each=events.append_new(out, ["id", "url"]))
    go()
    spark.createDataFrame([(1, "u9"), (3, "u2"), (4, "u4")], schema).write.mode("append").parquet(src)
    go()
    go()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 4]
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == 2


def test_line_duplication_is_exact(spark):
    r = aggregate.line_duplication(spark.createDataFrame([(1, "a\n a \nb\n\na")], "id int, t string"), "id", "t").first()
    assert (r.lines, r.duplicated, r.density) == (4, 2, 50.0)


def test_pull_request_measures(spark):
    f = "array<struct<path:string,language:string,additions:long,deletions:long>>"
    df = spark.createDataFrame([(1, None, None, [("a", "java", 6, 4), ("b", "python", 10, 0), ("c", "java", None, None)])], f"id int, additions long, deletions long, files {f}")
    r = metrics.pull_request_measures(df, "id", "files").first()
    assert (r.changed_lines, r.files, r.languages) == (20, 3, ["java", "python"])
    assert metrics.dominant_file_language(df, "id", "files").first().language == "java"
    assert df.select(F.size("files")).first()[0] == 3


def test_tool_reports(spark):
    loc = [{"filePath": "a.java", "startLine": 1, "endLine": 2, "codeElement": "m"}]
    reports = [
        (1, json.dumps({"commits": [{"sha1": "s", "refactorings": [{"type": "Rename Method", "leftSideLocations": loc}]}]})),
        (2, json.dumps({"relationships": [{"type": "Same"}, {"relationshipType": "Move", "afterLocations": loc}]})),
        (3, json.dumps([{"type": "Inline", "description": "d"}])),
        (4, "broken"),
        (5, None),
    ]
    got = parsers.tool_operations(spark.createDataFrame(reports, "id int, r string"), ["id"], "r").orderBy("id").collect()
    assert [(r.id, r.raw_type, r.commit_id) for r in got] == [(1, "Rename Method", "s"), (2, "Move", None), (3, "Inline", None)]
    assert got[0].source_locations[0].codeElement == "m" and got[1].target_locations[0].endLine == 2
    text = spark.createDataFrame([(1, "Refactorings found in x\n\n Move and Rename A\nOdd")], "id int, r string")
    assert [(r["index"], r.raw_type) for r in parsers.text_operations(text, ["id"], "r").collect()] == [(0, "Move and Rename"), (1, None)]


def test_lifted_shares(spark):
    df = spark.createDataFrame([("a", "x", 97), ("a", "y", 2), ("a", "z", 1), ("a", "w", 0)], "g string, l string, n int")
    got = {r.l: r.height for r in aggregate.lifted_shares(df, ["g"], "l", "n").collect()}
    assert got == pytest.approx({"x": 88.0, "y": 6.0, "z": 6.0, "w": 0.0})
    assert aggregate.lift_segments([1.0] * 20, 6.0) == [5.0] * 20
