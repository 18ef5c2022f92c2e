"""Keyed state that outlives a run, and windows that drop late rows."""

from collections import Counter

from pyspark.sql import functions as F

from sluice.streaming import events, state

SCHEMA = "id long, k string, g string, x double"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{folder}/feed")
    return events.stream_table(spark, f"{folder}/feed", spark.read.schema(SCHEMA).parquet(f"{folder}/feed").schema)


def test_first_row_of_a_key_wins_over_runs(spark, tmp_path):
    root = f"file://{tmp_path}"
    runs = [
        [(5, "a", "g1", 1.0), (3, "a", "g2", 2.0), (4, "b", "g1", None), (9, None, "g1", 7.0), (8, None, "g2", 8.0)],
        [(1, "a", "g1", 100.0), (6, "c", "g2", 4.0), (7, "c", "g1", 5.0)],
        [(2, "b", "g2", 50.0), (10, "d", "g1", 0.5)],
    ]
    won, want = set(), Counter()
    for rows in runs:
        stream = feed(spark, root, rows)
        got = state.run_first_rows(spark, stream, ["k"], "id", ["g"], {"x": "x"}, root)
        for i, k, g, x in sorted(rows):
            if k not in won:
                won.add(k)
                want[g, "n"] += 1
                want[g, "x"] += x or 0
        assert {(r.g, r.n, r.x or 0) for r in got.collect()} == {(g, want[g, "n"], want[g, "x"]) for g in ("g1", "g2")}
    # nothing is new, and the batch that is replayed overwrites what it had added
    again = state.run_first_rows(spark, stream, ["k"], "id", ["g"], {"x": "x"}, root)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    write = state.accumulate(f"{root}/added", ["g"], {"x": "x"})
    write(spark.createDataFrame([(6, "c", "g2", 4.0)], SCHEMA), 1)
    assert sum(r.n for r in state.totals(spark, f"{root}/added", ["g"], ["x"]).collect()) == sum(n for (_, what), n in want.items() if what == "n")


def test_state_has_a_life_time(spark, tmp_path):
    root = f"file://{tmp_path}"
    for rows in ([(1, "a", "g", 1.0)], [(2, "a", "g", 1.0)]):
        out = state.run_first_rows(spark, feed(spark, root, rows), ["k"], "id", ["g"], {"x": "x"}, root, ttl_ms=1)
    assert out.first().n == 2


def test_late_rows_are_dropped(spark, tmp_path):
    minute = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60)
    deliveries = [[(1, 0), (2, 10), (2, 10), (3, 200)], [(4, 5), (5, 199), (3, 200), (6, 205), (7, 1000)]]
    out = {}
    for name, plan in (
        ("sessions", lambda s: events.session_counts(s, "at", ["g"], ["id"], "30 minutes", "1 hour")),
        ("sliding", lambda s: events.windowed_counts(s, "at", [], "1 hour", "1 hour", "30 minutes")),
    ):
        root = f"file://{tmp_path}/{name}"
        for rows in deliveries:
            df = spark.createDataFrame(rows, "id long, m long").select("id", minute("m").alias("at"), F.lit(1).alias("g"))
            df.write.mode("append").parquet(f"{root}/feed")
            events.run_now(plan(events.stream_table(spark, f"{root}/feed", df.schema)), f"{root}/checkpoint", f"{root}/out")
        out[name] = spark.read.parquet(f"{root}/out").collect()
    # row 4 is late and repeated rows count once; the session of row 7 is still open
    assert sorted(r.n for r in out["sessions"]) == [2, 3]
    # without keys repeated rows count; row 4's windows had closed at minute 140
    assert sum(r.n for r in out["sliding"]) == 2 * (3 + 1) + 2 * 3


def test_first_rows_of_many_keys_without_python(spark, tmp_path):
    root = f"file://{tmp_path}"
    # 3000 keys of two rows each; of rows of equal order the least by the other columns, rows without an order last
    first = [(None, f"k{i}", "g0", 1.0) for i in range(3000)] + [(None if i % 3 == 0 else 7, f"k{i}", "g1", float(i)) for i in range(3000)]
    first += [(7, f"k{i}", "g2", -1.0) for i in range(3000)]
    second = [(1, f"k{i}", "g1", 100.0) for i in range(2500, 3500)]
    for rows in (first, second):
        stream = feed(spark, root, rows)
        got = state.run_first_rows(spark, stream, ["k"], "id", ["g"], {"x": "x"}, root)
    want = {("g1", 2000 + 500, float(sum(i for i in range(3000) if i % 3)) + 500 * 100.0), ("g2", 1000, -1000.0)}
    assert set(map(tuple, got.select("g", "n", "x").collect())) == want
    plan = state.first_of_key(stream, ["k"], "id")._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "TransformWithState" in state.first_of_key(stream, ["k"], "id", 1)._jdf.queryExecution().analyzed().toString()
