"""Sinks: keyed tables, JSON lines, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: cast where they exist, null where they don't."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty arrays and maps as null."""
    kinds = (T.ArrayType, T.MapType)
    return df.select(*[F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])


def write_entity(df: DataFrame, path: str, schema: T.StructType | None = None, by: list[str] | None = None, rows_per_file: int = 1_000_000) -> None:
    out = empty_to_null(conform(df, schema) if schema else df).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def split_rejects(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(accepted without the reason, rejected with it)."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def manifest(tables: dict[str, DataFrame], keys: dict[str, str], references: dict[str, dict[str, str]] | None = None) -> str:
    """Sorted JSON of each table's fields, primary key and foreign keys."""
    return json.dumps({name: {"fields": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "primary_key": keys[name], "foreign_keys": (references or {}).get(name, {})} for name, df in tables.items()}, sort_keys=True, indent=1)


def check_references(child: DataFrame, parent: DataFrame, on: str) -> int:
    """Child rows without a parent."""
    return child.join(parent.select(on).distinct(), on, "left_anti").count()


def content_blobs(files: DataFrame, path_col: str = "path", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(references with content_sha256, distinct blobs with a hash prefix to partition by)."""
    refs = files.withColumn("content_sha256", F.sha2(content_col, 256))
    blobs = refs.select("content_sha256", F.col(content_col).alias("content"), F.octet_length(content_col).alias("size")).dropDuplicates(["content_sha256"])
    return refs.drop(content_col), blobs.withColumn("hash_prefix", F.substring("content_sha256", 1, 2))
