"""The index of seen keys: replays, any of several keys, and what a batch reads."""

from sluice.streaming import seen

SCHEMA = "url string, id long, x string"


def test_batches_and_replays(spark, tmp_path):
    target, index = f"{tmp_path}/rows", f"{tmp_path}/keys"
    write = seen.append_unseen(target, index, ["url", "id"], buckets=8)
    one = lambda rows: spark.createDataFrame(rows, SCHEMA)
    batches = [
        [("a", 1, "x"), ("a", 1, "x"), ("b", 2, "y"), (None, 3, "z"), (None, None, "none")],
        [("a", 9, "seen url"), ("c", 2, "seen id"), ("d", 4, "new"), (None, 3, "seen id"), (None, None, "none")],
        [("d", 5, "seen"), ("e", None, "new"), ("c", 6, "its first row was not kept")],
    ]
    for i, rows in enumerate(batches):
        write(one(rows), i)
    want = {(0, "a"), (0, "b"), (0, None), (1, "d"), (1, None), (2, "e"), (2, "c")}
    read = lambda: spark.read.parquet(target)
    assert {(r.batch, r.url) for r in read().collect()} == want and read().count() == 8
    for i in (1, 2, 2):  # a replay gives the same rows
        write(one(batches[i]), i)
        assert {(r.batch, r.url) for r in read().collect()} == want and read().count() == 8
    plan = seen.unseen(one(batches[2]), index, ["url", "id"], 2, 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and target not in plan and "bucket" in plan
    assert seen.seen_keys(spark, index, "url", 9, []) is None
