"""Literal cases of the scalar, text, time and parser contracts."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import scalars as S
from sluice.functions import text as T
from sluice.functions import times as D
from sluice.operators.parsers import comment_lines, diff_ranges


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


CASES = [
    (lambda: S.coerce_str(F.lit(" 12.0 ")), "12"),
    (lambda: S.coerce_str(F.lit("NaN")), None),
    (lambda: S.coerce_str(F.lit("")), None),
    (lambda: S.coerce_int(F.lit("3.9")), 3),
    (lambda: S.coerce_int(F.lit(-3.9)), -3),
    (lambda: S.coerce_int(F.lit("x")), None),
    (lambda: S.coerce_int(F.lit("inf")), None),
    (lambda: S.coerce_float(F.lit("nan")), None),
    (lambda: S.coerce_bool(F.lit("Yes")), True),
    (lambda: S.coerce_bool(F.lit(0)), False),
    (lambda: S.coerce_bool(F.lit("maybe"), False), False),
    (lambda: S.stable_pr_key(F.lit("007.0"), F.lit(12)), "7#12"),
    (lambda: S.stable_pr_key(F.lit("R_x"), F.lit(1)), None),
    (lambda: S.repository_key(F.lit(" Foo / Bar ")), "foo/bar"),
    (lambda: S.repository_key(F.lit("foo")), None),
    (lambda: S.repository_key_of_safe(F.lit("Own__na__me")), "own/na__me"),
    (lambda: S.popularity_bucket(F.lit(None).cast("int")), "pop0"),
    (lambda: S.popularity_bucket(F.lit(18)), "pop1"),
    (lambda: S.popularity_bucket(F.lit(19)), "pop2"),
    (lambda: S.popularity_group(F.lit(None).cast("int")), None),
    (lambda: S.popularity_group(F.lit(0)), "low"),
    (lambda: S.popularity_label(F.lit("pop1_popularity")), "medium"),
    (lambda: S.refactoring_status(F.lit("")), "missing"),
    (lambda: S.refactoring_status(F.lit("Success")), "success"),
    (lambda: S.refactoring_status(F.lit("tool_error")), "failed"),
    (lambda: S.refactoring_status(F.lit("unsupported_language")), "unsupported"),
    (lambda: S.refactoring_status(F.lit("skipped")), "other"),
    (lambda: S.maintainability_status(F.lit("success"), F.lit("failed")), "failed"),
    (lambda: S.shannon(F.array(F.lit(1), F.lit(1), F.lit(2))), 1.5),
    (lambda: S.shannon(F.array().cast("array<int>")), 0.0),
    (lambda: S.per_kloc(F.lit(3), F.lit(0)), None),
    (lambda: S.ratio(F.lit(3), F.lit(0)), 0.0),
    (lambda: S.future_snapshot_available(F.lit(None).cast("boolean"), F.lit(False), F.lit("abc")), False),
    (lambda: S.snapshot_available(F.lit(None).cast("boolean"), F.lit(False), F.lit("abc")), True),
    (lambda: S.parse_pr_url(F.lit("https://host/o/r/pull/12/files")).number, 12),
    (lambda: S.sorted_json(S.json_counts(F.lit('{"b": 2, "a": 1, "z": 0}'))), '{"a":1,"b":2}'),
    (lambda: F.size(S.json_counts(F.lit("not json"))), 0),
    (lambda: F.array_join(S.span(F.lit(5), F.lit(3)), ","), "3,4,5"),
    (lambda: T.infer_language(F.lit("src/a.H")), "C"),
    (lambda: T.infer_language(F.lit("b.cjs")), None),
    (lambda: T.infer_language(F.lit("Makefile")), None),
    (lambda: T.infer_language(F.lit("a.d/x.ipynb")), "Jupyter Notebook"),
    (lambda: F.array_join(T.split_identifier(F.lit("parseHTTPResponse2xx")), " "), "parse HTTP Response 2 xx"),
    (lambda: F.array_join(T.split_topics(F.lit("b, a;nan\nA")), ","), "a,b"),
    (lambda: T.topic_slug(F.lit(" C++ & more ")), "c-more"),
    (lambda: T.diff_path(F.lit("/dev/null")), None),
    (lambda: T.front_matter(F.lit("---\na: 1\nb: x:y\n---\nbody"))["b"], "x:y"),
    (lambda: T.text_or_base64(F.lit(bytearray(b"\xff"))).base64, "/w=="),
    (lambda: D.offset_days(F.lit("+31d")), 31),
    (lambda: D.timepoint_days(F.lit("+4d")), None),
    (lambda: D.quarter(F.lit("2025-05-01T00:00:00").cast("timestamp_ntz")), "2025-Q2"),
    (lambda: F.size(D.month_buckets(F.lit("2025-01-31"), F.lit("2025-03-01"))), 3),
    (lambda: D.time_bucket(F.lit(None).cast("timestamp_ntz")), "unknown"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(spark, i):
    got, want = value(spark, CASES[i][0]()), CASES[i][1]
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_diff_ranges():
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,4 +1,5 @@\n a\n-b\n+B\n+C\n c\n--- d\n+++ e\n@@ -9,0 +11,2 @@\n+p\n+q\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    got = diff_ranges(diff)
    assert ("x", "old", 2, 2) in got and ("x", "new", 2, 3) in got and ("x", "old", 4, 4) in got and ("x", "new", 5, 5) in got
    assert ("x", "old", 10, 9) in got and ("x", "new", 11, 12) in got and ("y", "old", 1, 1) in got
    assert diff_ranges(None) == []


def test_comment_lines():
    assert comment_lines("x = 1\n# c\n\n'''doc\nmore\n'''\ny", "python") == (2, 4, 1)
    assert comment_lines("int a;\n/* b\n c */\n// d\n", "java") == (1, 3, 1)
