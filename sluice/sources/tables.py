"""Named Parquet tables of a directory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; a temporary one only in local mode without it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table of a new shared folder: what reads it does not compute it again, nor does a retry."""
    path = shared_folder(df.sparkSession, f"sluice-{name}")
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
