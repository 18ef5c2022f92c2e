"""Schema-tolerant readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaf_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of the scalar leaves; arrays are entered, maps are leaves."""
    if isinstance(schema, T.ArrayType):
        return leaf_paths(schema.elementType, prefix)
    if not isinstance(schema, T.StructType):
        return [prefix]
    return [p for f in schema.fields for p in leaf_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]


def has_path(schema: T.StructType, path: str) -> bool:
    node: T.DataType = schema
    for part in path.split("."):
        while isinstance(node, T.ArrayType):
            node = node.elementType
        if not isinstance(node, T.StructType) or part not in node.fieldNames():
            return False
        node = node[part].dataType
    return True


def present(df: DataFrame, paths: list[str]) -> list[str]:
    """Those of the paths that the schema has."""
    return [p for p in paths if has_path(df.schema, p)]


def path_or_null(df: DataFrame, path: str, kind: str = "string") -> Column:
    return F.col(path) if has_path(df.schema, path) else F.lit(None).cast(kind)


def read_cohorts(spark: SparkSession, root: str, pattern: str = "*.parquet", columns: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """All Parquet files below root with cohort (the path part after the last `data`, else the first below root),
    source_file and row_index; unreadable files are passed over, excluded cohorts are not opened."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).parquet(root)
    file = F.col("_metadata.file_path")
    after_data = F.regexp_extract(file, r"^.*/data/([^/]+)/", 1)
    below = F.regexp_extract(file, r"/" + root.rstrip("/").rsplit("/", 1)[-1] + r"/([^/]+)/", 1)
    df = df.select(F.coalesce(F.nullif(after_data, F.lit("")), below).alias("cohort"), file.alias("source_file"), F.col("_metadata.row_index").alias("row_index"), *(present(df, columns) if columns else df.columns))
    return df.where(~F.lower("cohort").isin(*[x.lower() for x in exclude])) if exclude else df


def fingerprints(df: DataFrame) -> DataFrame:
    """Path, size and time of every file that is read."""
    m = F.col("_metadata")
    return df.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified")).distinct()


def preflight(df: DataFrame, required: list[str], strict: bool = True) -> dict:
    """Missing and extra columns against a contract; strict raises on a missing one."""
    report = {"missing": sorted(p for p in required if not has_path(df.schema, p)), "extra": sorted(set(df.columns) - {r.split(".")[0] for r in required})}
    if strict and report["missing"]:
        raise ValueError(f"columns are missing: {report['missing']}")
    return report


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, malformed: str = "drop") -> DataFrame:
    """drop leaves malformed lines out; keep has them in _corrupt_record."""
    if malformed == "drop":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*full.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct tokens of tab-separated text, without # comments, a URL with and without its trailing slash."""
    t = spark.read.text(path).where(~F.trim("value").startswith("#"))
    t = t.select(F.explode(F.split("value", r"\s+")).alias("v")).where("v != ''")
    return t.select(F.explode(F.array("v", F.regexp_replace("v", "/+$", ""))).alias("identifier")).distinct()


def newest_per_cohort(df: DataFrame, rank: list[str]) -> DataFrame:
    from ..operators.relational import latest_rows

    return latest_rows(df, ["cohort"], rank)
