"""Curation as resumable jobs: keyed work is done once, whatever run it began in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as N
from ..operators import relational as R


def process_by_repository(df: DataFrame, repository: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, salt: int = 1) -> DataFrame:
    """work over the rows of one repository at a time. salt deals a repository's rows into so many groups by their place, where
    work needs none but its own row's repository, so that a hot repository is no single task."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(salt))
    return df.withColumn("__part", part).groupBy(repository, "__part").applyInPandas(lambda pdf: work(pdf.drop(columns="__part")), schema)


def run_curation(candidates: DataFrame, out: str, run: str, key: str, select: Callable[[DataFrame], DataFrame], process: Callable[[DataFrame], DataFrame], status: str = "status", retry_failed: bool = True) -> DataFrame:
    """One curation run: select() of the candidates that no earlier run finished, process() them, and write the run's rows
    under out/run=<run>; a run that is repeated under its name writes its rows anew and reads none of them. Failed rows are
    done again unless retry_failed is off. Returns counts by status of all runs."""
    spark = candidates.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo = candidates
    if fs.exists(at):
        held = spark.read.option("basePath", out).parquet(out).where(F.col("run").cast("string") != run)
        done = held.where(F.lower(status) != "failed") if retry_failed else held
        todo = R.keep_matching(candidates, done, [key], matching=False)
    process(select(todo)).write.mode("overwrite").parquet(f"{out}/run={run}")
    rows = spark.read.option("basePath", out).parquet(out)
    last = R.latest_rows(rows.select(key, status, F.col("run").cast("string").alias("run")), [key], ["run"])
    return last.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def gate(df: DataFrame, metrics: str, stage: str) -> DataFrame:
    """Adds reasons why a processed row is left out (an empty array if it stays). stage: struct (status, results)."""
    return df.withColumn("reasons", N.processing_gate_reasons(F.col(metrics).isNotNull(), F.col(stage).isNotNull(), f"{stage}.status", F.col(f"{stage}.results")))
