"""An index of the keys that a stream has written, one table an identifier: narrow, appended to, dealt into buckets by hash, so
that a micro-batch reads the keys of its own buckets and never the target's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def seen_keys(spark: SparkSession, index: str, key: str, before: int, touched: list[int]) -> DataFrame | None:
    """The keys of the batches before one, of the buckets that are asked for: other buckets' files are not opened."""
    folder = f"{index}/{key}"
    if not touched or not _exists(spark, folder):
        return None
    held = spark.read.option("basePath", folder).parquet(folder)
    return held.where(F.col("bucket").isin(touched) & (F.col("batch") < before)).select(key)


def unseen(batch: DataFrame, index: str, keys: list[str], batch_id: int, buckets: int = BUCKETS) -> DataFrame:
    """The rows none of whose keys was written by an earlier batch, one a key within the batch. Null is no key."""
    spark, rows = batch.sparkSession, batch
    for k in keys:
        rows = rows.where(F.col(k).isNotNull()).dropDuplicates([k]).unionByName(rows.where(F.col(k).isNull()))
        touched = [r[0] for r in batch.where(F.col(k).isNotNull()).select(_bucket(F.col(k), buckets).alias("b")).distinct().collect()]  # BUCKETS at most
        held = seen_keys(spark, index, k, batch_id, touched)
        if held is not None:
            rows = rows.join(held, k, "left_anti")
    return rows.select(*batch.columns)


def append_unseen(target: str, index: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch: append the unseen rows and then their keys. A batch that is replayed overwrites its own folders, and looks
    at the batches before it alone, so that it gives the same rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, out = batch.sparkSession, f"{target}/batch={batch_id:09d}"
        rows = unseen(batch, index, keys, batch_id, buckets)
        rows.write.mode("overwrite").parquet(out)
        # the keys come from what was written, not from rows that are computed again
        written = spark.read.schema(batch.schema).parquet(out)
        for k in keys:
            own = written.where(F.col(k).isNotNull()).select(k, _bucket(F.col(k), buckets).alias("bucket"))
            dealt = own.repartition("bucket").sortWithinPartitions("bucket", k)
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/{k}/batch={batch_id:09d}")

    return write
