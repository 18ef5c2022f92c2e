"""Keyed state over a stream: the first row of each key wins, for as long as its state lives, and totals grow by what each
micro-batch adds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from .events import run_now

#: The state store that state with a life time needs; it also keeps large state out of the heap.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstWins(StatefulProcessor):
    """Passes on the least row, by `order`, of the first micro-batch that holds the key, and remembers the key for `ttl_ms`
    (0: for ever). Only the least row of a chunk is held."""

    def __init__(self, order: str, columns: list[str], ttl_ms: int):
        self.order, self.columns, self.ttl_ms = order, columns, ttl_ms

    def init(self, handle) -> None:
        kind = StructType([StructField("order", self.kind)])
        self.seen = handle.getValueState("seen", kind, self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            return
        best = None
        for chunk in rows:
            least = chunk.nsmallest(1, self.order, keep="first") if len(chunk) else chunk
            if best is None or len(least) and least[self.order].iloc[0] < best[self.order].iloc[0]:
                best = least
        if best is not None and len(best):
            self.seen.update((best[self.order].iloc[0].item(),))
            yield pd.DataFrame({c: best[c] for c in self.columns})

    def close(self) -> None:
        pass


def first_of_key(df: DataFrame, key: list[str], order: str, ttl_ms: int = 0) -> DataFrame:
    """A stream with the first row of each key: of the first micro-batch that has the key the least by `order`, nulls last.

    Without a life time it is a streaming aggregation in update mode: the state keeps the least row by (time of the micro-batch,
    order, the other columns), and a key's row is passed on when its first micro-batch is its last so far. With a life time, by
    which state has to expire, a Python processor takes the keys one by one, in append mode; `order` is a number then."""
    if ttl_ms:
        processor = FirstWins(order, df.columns, ttl_ms)
        processor.kind = df.schema[order].dataType
        return df.groupBy(*key).transformWithStateInPandas(processor, outputStructType=df.schema, outputMode="Append", timeMode="ProcessingTime")
    rest = [c for c in df.columns if c not in key and c != order]
    row = F.struct("__at", F.col(order).isNull().alias("__none"), F.col(order).alias("__order"), *rest)
    least = df.withColumn("__at", F.current_timestamp()).groupBy(*key).agg(F.min(row).alias("__first"), F.max("__at").alias("__last"))
    own = {order: F.col("__first.__order")} | {c: F.col(f"__first.{c}") for c in rest} | {c: F.col(c) for c in key}
    return least.where("__first.__at = __last").select(*[own[c].alias(c) for c in df.columns])


def accumulate(target: str, by: list[str], sums: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: what a micro-batch adds to the totals by group (n and the sums), in a folder of its own, which a replay of
    the batch overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(e)).alias(name) for name, e in sums.items()])
        added.write.mode("overwrite").parquet(f"{target}/batch={batch_id:09d}")

    return write


def totals(spark: SparkSession, target: str, by: list[str], sums: list[str]) -> DataFrame:
    """The groups' totals over all micro-batches."""
    held = spark.read.option("basePath", target).parquet(target)
    return held.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])


def run_first_rows(spark: SparkSession, stream: DataFrame, key: list[str], order: str, by: list[str], sums: dict[str, str], root: str, ttl_ms: int = 0) -> DataFrame:
    """Take in what the stream has, from where the last run under `root` stopped, and return the totals so far."""
    # state with a life time asks for batches without data for ever, and the run would not end
    needed = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in needed}
    for k, v in needed.items():
        spark.conf.set(k, v)
    try:
        mode = "append" if ttl_ms else "update"
        run_now(first_of_key(stream, key, order, ttl_ms), f"{root}/checkpoint", each=accumulate(f"{root}/added", by, sums), mode=mode)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return totals(spark, f"{root}/added", by, list(sums))
