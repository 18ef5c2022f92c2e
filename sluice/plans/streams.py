"""Stream jobs whose result equals a batch query, run over a table's file and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table, shared_folder
from ..streaming import events as E
from ..streaming import state


def _source(spark, d):
    """The table's file, found by the name filter of a stream over its folder."""
    schema = read_table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def stream_dedup(spark, d):
    """The distinct (user, type) keys of the events."""
    root = shared_folder(spark, "stream")
    keys = E.dedup_stream(_source(spark, d).select("user_id", "event_type"), ["user_id", "event_type"])
    E.run_now(keys, f"{root}/checkpoint", f"{root}/out")
    return spark.read.schema("user_id long, event_type string").parquet(f"{root}/out")


def stream_windows(spark, d):
    """Counts by day and type, complete after the bounded run."""
    root = shared_folder(spark, "stream")
    counts = _source(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")
    E.run_now(counts, f"{root}/checkpoint", each=lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out"), mode="complete")
    return spark.read.schema("day date, event_type string, n long").parquet(f"{root}/out")


def _deliver(rows, feed: str, late) -> None:
    """Write the rows to the feed's folder, those that are late with the second delivery; yields after each."""
    for k in range(2):
        rows.where(F.coalesce(late, F.lit(False)) == F.lit(bool(k))).write.mode("append").parquet(feed)
        yield k


def stream_first_rows(spark, d):
    """Per source the clients and their balance at the first change of each (client, source), over a stream that stops after
    half of the changes and goes on from its state."""
    root, changes = shared_folder(spark, "stream"), read_table(spark, d, "client_changes").select("change_id", "client_id", "source", "balance")
    half = changes.agg(F.floor(F.max("change_id") / 2)).first()[0]
    cents = {"cents": "coalesce(floor(100 * balance + 0.5), 0)"}
    for _ in _deliver(changes, f"{root}/feed", F.col("change_id") > F.lit(half)):
        stream = E.stream_table(spark, f"{root}/feed", changes.schema, 100_000)
        out = state.run_first_rows(spark, stream, ["client_id", "source"], "change_id", ["source"], cents, root)
    return out.withColumnRenamed("n", "clients")


def _clicks(spark, d):
    """Clicks with an instant as their time; (rows, what comes with the second delivery)."""
    c = read_table(spark, d, "clicks").select("click_id", F.col("ts").cast("timestamp").alias("at"), "arrived_at", "client_id", "kind")
    second = (F.col("arrived_at") >= F.lit("2024-03-01").cast("timestamp_ntz")) | (F.col("arrived_at") - F.col("at").cast("timestamp_ntz") > F.expr("INTERVAL 1 HOUR"))
    return c.withColumn("second", F.coalesce(second, F.lit(False))).drop("arrived_at"), F.col("second")


def _windows(spark, d, plan, schema):
    """The closed windows of both deliveries; the late rows of the second meet windows that the first has closed."""
    root = shared_folder(spark, "stream")
    rows, second = _clicks(spark, d)
    for _ in _deliver(rows, f"{root}/feed", second):
        E.run_now(plan(E.stream_table(spark, f"{root}/feed", rows.schema, 100_000)), f"{root}/checkpoint", f"{root}/out")
    return spark.read.schema(schema).parquet(f"{root}/out")


def stream_sliding(spark, d):
    """Clicks by kind in windows of a day that start every six hours."""
    out = _windows(spark, d, lambda s: E.windowed_counts(s, "at", ["kind"], "1 day", "2 hours", "6 hours"), "start timestamp, kind string, n long")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(spark, d):
    """Sessions of clients: clicks that are less than half an hour apart, each click once."""
    out = _windows(spark, d, lambda s: E.session_counts(s, "at", ["client_id"], ["click_id"], "30 minutes", "2 hours"), "start timestamp, end timestamp, client_id long, n long")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


#: The watermarks after each delivery: two hours before the latest click.
_FEEDS = """c AS (SELECT click_id, ts, client_id, kind, coalesce(arrived_at >= TIMESTAMP '2024-03-01' OR arrived_at - ts > INTERVAL 1 HOUR, false) AS second FROM clicks),
  w AS (SELECT max(ts) FILTER (NOT second) - INTERVAL 2 HOUR AS w1, max(ts) - INTERVAL 2 HOUR AS w2 FROM c)"""

QUERIES = {
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_first_rows": (stream_first_rows, """WITH f AS (SELECT client_id, source, arg_min(coalesce(floor(100 * balance + 0.5), 0), change_id) AS cents FROM client_changes GROUP BY ALL)
      SELECT source, count(*) AS clients, CAST(sum(cents) AS BIGINT) AS cents FROM f GROUP BY source"""),
    "stream_sliding": (stream_sliding, f"""WITH {_FEEDS}, x AS (SELECT kind, second, unnest([time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR FOR i IN range(4)]) AS start FROM c WHERE ts IS NOT NULL)
      SELECT start, kind, count(*) AS n FROM x, w WHERE (NOT second OR start + INTERVAL 24 HOUR > w1) AND start + INTERVAL 24 HOUR <= w2 GROUP BY ALL"""),
    "stream_sessions": (stream_sessions, f"""WITH {_FEEDS}, x AS (SELECT DISTINCT click_id, client_id, ts FROM c, w WHERE ts IS NOT NULL AND (NOT second OR ts > w1)),
      g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER k + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM x WINDOW k AS (PARTITION BY client_id ORDER BY ts, click_id)),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY ts, click_id) AS no FROM g)
      SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", client_id, count(*) AS n FROM s, w GROUP BY client_id, no, w2 HAVING max(ts) + INTERVAL 30 MINUTE <= w2"""),
    "stream_windows": (stream_windows, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
}
