"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest (pre-aggregated, so
that a text with millions of copies is one row a task), anti-joined with the index by a sort-merge join, and the digests
that are new are appended. Decisions join back by digest. The digests of more rows than 1 in HOT_SHARE (HOT_ROWS at least) are
HOT_SHARE at most at any size of the corpus; their decisions are broadcast, and their rows stay where they are. All other
rows meet their decisions in a sort-merge join, where no digest has more rows than that.

Defined results: a null text equals the empty text. A null doc_id sorts after every other. Rows that repeat a doc_id are
the same document: all of them carry the same decision, and `dedup` leaves one. An empty table gives an empty result.
Columns other than doc_id and text are carried and may have any name.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, materialize_by, scratch_path, shuffle_partitions

#: The file in an index's folder that names its buckets and columns; Spark's readers pass over it.
NOTE = "_digest_index.json"

#: Runs of white space that differ from one space; the others need no replacement.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: A digest of more rows than HOT_ROWS and than the HOT_SHARE-th part of all rows is hot: HOT_SHARE of 100 bytes at most.
HOT_ROWS = 1_000
HOT_SHARE = 10_000


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ").cast("binary"), 256)


class DigestIndex:
    """A table (digest, keep_id) bucketed and sorted by digest, to which batches are appended.

    It lives in the folder `path`: the bucketed files and a note of the buckets and columns. Another application that opens
    the folder registers a table over the files that are there; nothing is ever written over them. An append that fails leaves
    the index as it was, and a batch that is taken in again appends nothing and gets the decisions of its first time.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or scratch_path(spark, "digests")).rstrip("/")
        self.name = name or f"sluice_digests_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        self.buckets = buckets or shuffle_partitions(spark)
        if self.exists():
            self.buckets = self._register()

    def _folder(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _note(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{NOTE}")

    def exists(self) -> bool:
        return self._folder()[0].exists(self._note())

    def _register(self) -> int:
        """Make the folder a table of the session's catalog, if it isn't one; its number of buckets."""
        fs, path = self._folder()
        stream = fs.open(self._note())
        try:
            note = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if not self.spark.catalog.tableExists(self.name):
            self.spark.sql(
                f"CREATE TABLE `{self.name}` ({note['columns']}) USING parquet OPTIONS (path '{self.path}') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {note['buckets']} BUCKETS"
            )
        held = self.spark.sql(f"DESCRIBE FORMATTED `{self.name}`").where("col_name = 'Location'").first()["data_type"]
        if self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held).toUri().getPath() != path.toUri().getPath():
            raise ValueError(f"the table {self.name} lies in {held}, not in {self.path}")
        return note["buckets"]

    def _create(self, columns: str) -> None:
        """Note buckets and columns in a folder that has no other files."""
        fs, path = self._folder()
        if fs.exists(path) and len(fs.listStatus(path)):
            raise ValueError(f"{self.path} holds files, but no index")
        fs.mkdirs(path)
        draft = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "columns": columns}).encode()))
        out.close()
        fs.rename(draft, self._note())
        self._register()

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, digests: DataFrame) -> None:
        """Append the digests of a batch (doc_id, digest) that the index lacks."""
        fresh = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        if not self.exists():
            self._create(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema))
        fresh = fresh.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        (
            fresh.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .saveAsTable(self.name)
        )


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(text_digest(F.col(text_col))).alias("digest"), F.xxhash64(text_col).alias("raw"))


def decide(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, raw (a hash of the row's own text).

    The rows are taken in in `batches` ranges of doc_id, lowest first, so that the smallest doc_id of equal texts is the
    one the index holds. With an index that already has a digest, its keep_id stays.
    """
    index = index or DigestIndex(docs.sparkSession)
    rows = materialize(_digests(docs, id_col, text_col), "digest-rows")
    lo, hi, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    if lo is None or batches < 2 or not isinstance(lo, int):
        index.ingest(rows)
    else:
        cuts = [lo + (hi - lo + 1) * i // batches for i in range(1, batches)]
        for a, b in zip([None, *cuts], [*cuts, None]):
            part = F.lit(True)
            if a is not None:
                part = part & (F.col("doc_id") >= a)
            if b is not None:
                part = part & (F.col("doc_id") < b)
            index.ingest(rows.where(F.coalesce(part, F.lit(b is None))))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialize_by(index.table().join(sizes.hint("merge"), "digest"), "digest-groups", "digest", dealt=True)
    hot = F.broadcast(groups.where(F.col("group_size") > max(hot_rows, n // HOT_SHARE)))
    rest = rows.join(hot, "digest", "left_anti").join(groups.hint("merge"), "digest")
    return rows.join(hot, "digest").unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "raw"
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns: of equal texts the one with the smallest doc_id."""
    keep = decide(docs, index, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"), F.col("text_sha256").alias("__sha")).distinct()
    # the ids alone are the join's keys, so that the rows of an id lie together for dropDuplicates
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col).bitwiseXOR(F.col("__raw")) == 0)
    return docs.join(keep, same).dropDuplicates([id_col, "__sha"]).select(*[docs[c] for c in docs.columns])
