"""Structured Streaming jobs: bounded runs (availableNow) that resume from their checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_now(df: DataFrame, checkpoint: str, out: str | None = None, each: Callable | None = None, mode: str = "append") -> None:
    """Process what is there and stop. Files already processed under the checkpoint are not read again."""
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", out)
    w.start().awaitTermination()


def dedup_stream(df: DataFrame, key: list[str], ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time the state is dropped after the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key) if ts else df.dropDuplicates(key)


def windowed_counts(df: DataFrame, ts: str, by: list[str], window: str = "1 hour", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows by window (overlapping ones with a slide) and keys. A row whose window the watermark has passed is dropped, and a
    window is complete, and leaves the state, once the watermark has passed it."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return df.withWatermark(ts, delay).groupBy(span, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def session_counts(df: DataFrame, ts: str, by: list[str], key: list[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by keys: rows that follow each other within the gap. Rows that repeat a key within the delay count once, rows
    that are later than the delay are dropped."""
    fresh = df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)
    out = fresh.groupBy(F.session_window(ts, gap).alias("session"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *by, "n")


def append_new(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: append rows none of whose keys is in the target; a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = batch.dropDuplicates(keys)
        if fs.exists(path):
            held = spark.read.option("basePath", target).parquet(target).where(F.col("batch") < batch_id)
            for k in keys:
                rows = rows.join(held.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id:09d}")

    return write
