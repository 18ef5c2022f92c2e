"""Token counts kept as rollups that deltas maintain.

A rollup is a folder of committed batches; a batch holds, for each (source, lang, tokenizer), the signed sums of what it
changes: documents, tokens and bytes. Inserts count once, deletes minus once, a revision is a delete of the old counts
and an insert of the new. Totals are the sums over batches, so their order does not matter. A batch is written to a
folder of its own and then renamed to its name in one step; a name that exists is left as it is, so replaying a batch
changes nothing.

Batches are aggregated before the shuffle, so a source with a third of all rows is one row a task.

Defined results: a null text has 0 tokens and 0 bytes and counts as a document. Null source and lang are groups of their
own. Rows that repeat count each time. Groups whose documents are all gone are left out of the totals. An empty batch
commits nothing but its name. An added column whose name is taken has an underscore put after it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added_fields, drop_path, map_arrow, scratch_path
from .tokens import TOKENIZERS, BpeEncoder, text_slices

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "bytes"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", tokenizers: dict[str, str] | None = None) -> DataFrame:
    """The columns of `keep` with n_bytes and counts, an array of (tokenizer, tokens)."""
    paths = tokenizers or TOKENIZERS
    held = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = added_fields("n_bytes long, counts array<struct<tokenizer:string,tokens:long>>", held.drop("__text").schema)
    kind = pa.list_(pa.struct([("tokenizer", pa.string()), ("tokens", pa.int64())]))

    def run(batches):
        encoders = {k: BpeEncoder(p) for k, p in paths.items()}
        for whole in batches:
            for b in text_slices(whole, whole.num_columns - 1):
                texts = b.column(b.num_columns - 1).to_pylist()
                per = {k: e.counts(texts).tolist() for k, e in encoders.items()}
                counts = [[{"tokenizer": k, "tokens": v[i]} for k, v in per.items()] for i in range(len(texts))]
                size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, pa.array(counts, kind)], names=schema.names)

    return map_arrow(held, run, schema)


def changes(counted: DataFrame, sign: int = 1) -> DataFrame:
    """Signed rows of the counted documents: sign 1 inserts them, -1 deletes them."""
    rows = counted.select("source", "lang", "n_bytes", F.explode("counts").alias("c"))
    return rows.select("source", "lang", F.col("c.tokenizer").alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.col("c.tokens") * sign).alias("tokens"), (F.col("n_bytes") * sign).alias("bytes"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return changes(old, -1).union(changes(new, 1))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "rollup")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Add a batch; False if a batch of this name was committed before."""
        fs, at = self._fs()
        final = f"{self.path}/batch={batch_id}"
        if fs.exists(at(final)):
            return False
        staged = f"{self.path}/_staged-{batch_id}"
        rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]).write.mode("overwrite").parquet(staged)
        if not fs.exists(at(final)) and fs.rename(at(staged), at(final)):
            return True
        drop_path(self.spark, staged)
        return False

    def totals(self) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").parquet(f"{self.path}/batch=*")
        return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]).where("docs != 0")
