"""Shared helpers of the training-data operators: scratch tables and numpy kernels over Arrow text columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Text bytes that one numpy pass works on; bounds the temporaries of a Python worker.
SLICE_BYTES = 1 << 20


_SHIPPED: set[str] = set()


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow, once the executors have this package."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="sluice-package-")  # the driver serves the file as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder, f"{root.name}-package.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return df.mapInArrow(fn, schema)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share. It is the session's spark.checkpoint.dir; a temporary one only where that is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sluice-")
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/sluice-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends in replicated files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
    """As materialize(), dealt into buckets by `key` and sorted by it: joins by `key` read it without a shuffle.

    dealt: the partitions of df are by `key` already.
    """
    spark = df.sparkSession
    n, path = shuffle_partitions(spark), scratch_path(spark, name)
    table = "sluice_" + path.rpartition("/sluice-")[2].replace("-", "_")
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table_files(df: DataFrame) -> None:
    """Delete the files behind a materialize()d table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/sluice-" in folder:
            drop_path(df.sparkSession, folder)


def open_folder(path: str):
    """(file system, path in it) of a folder, in a task."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(added: list[str], taken: list[str]) -> list[str]:
    """The names of added columns; one that is taken (case aside) has underscores put after it until it is free."""
    held, out = {x.lower() for x in taken}, []
    for name in added:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def added_fields(ddl: str, taken: StructType) -> StructType:
    """taken with the fields of ddl, under free names."""
    new = StructType.fromDDL(ddl)
    names = free_names(new.names, taken.names)
    return StructType([*taken.fields, *[StructField(n, f.dataType) for n, f in zip(names, new.fields)]])


# ------------------------------------------------------------------ Arrow text columns


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string or binary array, without a copy. A null has length 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not (pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)):
        arr = arr.cast(pa.large_binary())
    offs = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = ~np.asarray(arr.is_valid()) if arr.null_count else np.zeros(len(arr), bool)
    return data, offs, null


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


# ------------------------------------------------------------------ hashing

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = _SEED.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = _SEED.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 0x09 to 0x0D."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z folded to a-z: a random linear form over its bytes, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    first = np.cumsum(size) - size
    at = np.arange(total) - np.repeat(first, size)
    terms = _BYTE_LOWER[buf[at + np.repeat(starts, size)]]
    top = int(size.max())
    power = _POW if top <= len(_POW) else np.concatenate([_POW, mix64(np.arange(len(_POW), top, dtype=np.uint64) * MULT[7]) | np.uint64(1)])
    terms *= power[at]
    h = np.add.reduceat(terms, first)
    return mix64(h ^ (size.astype(np.uint64) * MULT[6]))


def words_of(buf: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row and the end) of rows lo to hi; words never cross rows."""
    base, n = int(offs[lo]), hi - lo
    part = buf[base : int(offs[hi])]
    cut = offs[lo : hi + 1] - base
    starts, ends = word_spans(part)
    inner = cut[1:-1]
    if n > 1 and len(starts):
        # a row end inside a run splits the run into a word of each row
        k = np.searchsorted(starts, inner, "right") - 1
        hit = np.unique(inner[(k >= 0) & (starts[np.maximum(k, 0)] < inner) & (ends[np.maximum(k, 0)] > inner)])
        if len(hit):
            starts, ends = np.sort(np.concatenate([starts, hit])), np.sort(np.concatenate([ends, hit]))
    return word_hashes(part, starts, ends), np.searchsorted(starts, cut, "left")
