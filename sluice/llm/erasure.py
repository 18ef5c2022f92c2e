"""Cascading erasure: rank intervals of the victims, and a rewrite of the files that hold them.

Layout: a table is range-partitioned and sorted by a key and then by all its columns, left to right, nulls first. The sorted
rows are written once with their place (partition, row); sums of the partitions' rows, one number a partition, turn places
into ranks. A rank divided by the rows of a file is the file's number, and each file is written by the task of that number.

Erasure: victims cascade from the rows that a predicate marks to the rows that refer to them. Their ranks collapse into
gaps-and-islands intervals (within blocks of BLOCK ranks, so that no window holds more), the intervals are split at file
borders by integer division, and each file that has some is read in batches: the slices between the intervals, which share
the batches' buffers, are put together into row groups and written to a staging folder. Footers hold the statistics of the
survivors alone. A manifest names the staged file of the attempt that succeeded; publish() then replaces the old files. It
can be repeated after an interruption: what is published already is left as it is.

Defined results: a null key sorts as the empty text. Null never refers to anything, so a row whose reference is null is no
victim. Rows that repeat another are rows of their own, with neighbouring ranks. A table without rows has no file. A file
that loses all its rows is removed. Columns may have any name. A value that is null, infinite or no number counts 0 cents.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, map_arrow, materialize, open_folder, scratch_path, shuffle_partitions

#: A table has at most this many files (their size follows the table's).
FILES = 150
#: Ranks of a window in which islands are found.
BLOCK = 1 << 16
#: Victim ids that are broadcast: some MB. Beyond it the engine joins by shuffle.
BROADCAST_IDS = 100_000
#: Rows of a batch that is read, and of a row group that is written.
BATCH_ROWS = 1 << 16
#: Bytes of the files that one task reads, if there are more tasks than the session's shuffle partitions.
TASK_BYTES = 64 << 20
#: The low bits of a place number the rows of a partition.
_ROW_BITS = 33


@dataclass
class Source:
    """A table: its rows as (key, row), where key is what they are sorted by and row a struct of all columns; the numeric
    column that reports sum up; references to other tables as (own column, table, its column). `marked` gives the rows that
    are victims by themselves, from rows as (rank, row)."""

    name: str
    keyed: DataFrame
    value: str
    refers: tuple[tuple[str, str, str], ...] = ()
    marked: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Layout:
    """A table that is written: its ranked rows (rank, row), their number, the rows of a file, (path, bytes) of the files by
    number."""

    source: Source
    ranked: DataFrame
    n: int
    size: int
    files: dict[int, tuple[str, int]]


def crc_key(value: Column) -> Column:
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def with_key(rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(key.alias("key"), F.struct(*[rows[c] for c in rows.columns]).alias("row"))


# ------------------------------------------------------------------ layout


def rank_rows(keyed: DataFrame) -> tuple[DataFrame, int]:
    """(rank from 0, row) of every row in the order of key and of all columns, and the number of rows."""
    spark = keyed.sparkSession
    # structs are compared field by field, ascending, nulls first
    order = keyed.repartitionByRange(shuffle_partitions(spark), "key", "row").sortWithinPartitions("key", "row")
    placed = materialize(order.select("row", F.monotonically_increasing_id().alias("place")), "placed")
    part = F.shiftright("place", _ROW_BITS)
    sums = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select("part", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "offsets")
    n = offsets.agg(F.sum("rows")).first()[0] or 0
    # one row a range partition, whose number the session sets
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets.drop("rows")), "part")
    return ranked.select((F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("rank"), "row"), n


def list_files(spark: SparkSession, folder: str) -> dict[int, tuple[str, int]]:
    """(path, bytes) of the data files of a folder, by the number of the task that wrote them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(path)] if fs.exists(path) else []
    return {int(m[1]): f for f in found if (m := re.search(r"/part-(\d+)[^/]*$", f[0]))}


def _deal(rows: DataFrame, files: list, size: int, number: str) -> DataFrame:
    """Rows by the number of their file, to a task a file or, of small files, a task for several."""
    tasks = max(1, min(len(files), max(shuffle_partitions(rows.sparkSession), size // TASK_BYTES)))
    return rows.repartitionById(tasks, F.expr(f"int({number} * {tasks}L div {max(1, len(files))})"))


def lay_out(source: Source, root: str) -> Layout:
    """Write the rows in order, in files of 1 + floor(n / FILES) rows."""
    spark = source.keyed.sparkSession
    ranked, n = rank_rows(source.keyed)
    size, folder = 1 + n // FILES, f"{root}/{source.name}"
    count = -(-n // size)
    if n:
        dealt = ranked.repartitionById(count, F.expr(f"int(rank div {size})")).sortWithinPartitions("rank")
        dealt.select("row.*").write.option("maxRecordsPerFile", 0).parquet(folder)
    found = list_files(spark, folder)
    if sorted(found) != list(range(count)):
        raise RuntimeError(f"{folder} has the files {sorted(found)[:9]}, not {count} from 0 on")
    return Layout(source, ranked, n, size, found)


# ------------------------------------------------------------------ victims


def _referring(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is one of ids (id)."""
    own = ids.select(F.col("id").alias("__victim"))
    if ids.count() <= BROADCAST_IDS:
        own = F.broadcast(own)
    return rows.join(own, F.col(f"row.`{column}`") == F.col("__victim"), "left_semi")


def victims(layouts: dict[str, Layout]) -> dict[str, DataFrame]:
    """Per table the (rank, row) of its victims. A table comes after those it refers to."""
    found: dict[str, DataFrame] = {}
    ids: dict[tuple[str, str], DataFrame] = {}
    for name, layout in layouts.items():
        parts = [layout.source.marked(layout.ranked)] if layout.source.marked else []
        for column, other, field in layout.source.refers:
            if (other, field) not in ids:
                held = found[other].select(F.col(f"row.`{field}`").alias("id")).where("id IS NOT NULL").distinct()
                ids[other, field] = materialize(held, "victim-ids")
            parts.append(_referring(layout.ranked, column, ids[other, field]))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        found[name] = rows.dropDuplicates(["rank"]) if len(parts) > 1 else rows
    return found


def intervals(ranks: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """(file_no, lo, hi): the ranks, each once, as half-open intervals of places in files of `size` rows."""
    held = ranks.select("rank", F.expr(f"rank div {block}").alias("block"))
    island = F.col("rank") - F.row_number().over(Window.partitionBy("block").orderBy("rank"))
    spans = held.withColumn("island", island).groupBy("block", "island").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    split = spans.select("first", "last", F.explode(F.expr(f"sequence(first div {size}, last div {size})")).alias("file_no"))
    start = F.col("file_no") * F.lit(size)
    lo, hi = F.greatest("first", start) - start, F.least(F.col("last"), start + F.lit(size - 1)) - start + 1
    return split.select("file_no", lo.alias("lo"), hi.alias("hi"))


# ------------------------------------------------------------------ rewrite


def surviving_slices(batches, gaps):
    """The slices of batches outside the intervals (lo, hi) of rows, which are ordered and may touch. No copies are made."""
    at, gap = 0, next(gaps, None)
    for batch in batches:
        here, end = at, at + batch.num_rows
        while gap is not None and gap[0] < end:
            if gap[0] > here:
                yield batch.slice(here - at, gap[0] - here)
            here = max(here, min(gap[1], end))
            if gap[1] > end:
                break
            gap = next(gaps, None)
        if here < end:
            yield batch.slice(here - at, end - here)
        at = end


def rewrite_file(path: str, target: str, gaps) -> tuple[int, int]:
    """Write what survives of a Parquet file to target, if anything does; the number of surviving and of all rows."""
    (fs, own), (to_fs, to) = open_folder(path), open_folder(target)
    sink = writer = None
    held, rows, kept = [], 0, 0
    with fs.open_input_file(own) as f:
        source = pq.ParquetFile(f)
        codec = source.metadata.row_group(0).column(0).compression.lower() if source.metadata.num_row_groups else "snappy"

        def flush() -> None:
            nonlocal sink, writer, held, rows
            if held:
                if writer is None:
                    sink = to_fs.open_output_stream(to)
                    writer = pq.ParquetWriter(sink, source.schema_arrow, compression="none" if codec == "uncompressed" else codec)
                writer.write_table(pa.Table.from_batches(held), row_group_size=BATCH_ROWS)
            held, rows = [], 0

        try:
            for part in surviving_slices(source.iter_batches(batch_size=BATCH_ROWS), gaps):
                held.append(part)
                rows, kept = rows + part.num_rows, kept + part.num_rows
                if rows >= BATCH_ROWS:
                    flush()
            flush()
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        return kept, source.metadata.num_rows


def _runs(batches):
    """(file, its intervals) from batches of (file, lo, hi) sorted by file and lo; intervals are read as they are used."""
    rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3))))
    ahead = next(rows, None)
    while ahead is not None:
        number = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0] == number:
                yield ahead[1:]
                ahead = next(rows, None)

        gaps = own()
        yield number, gaps
        for _ in gaps:  # past the end of the file
            pass


def stage(layouts: dict[str, Layout], erased: dict[str, DataFrame], root: str) -> DataFrame:
    """Write the surviving rows of all files that hold victims into a staging folder; the manifest (table_name, file_no,
    n_erased, n_rows, path, staged), where staged is null for a file that loses all its rows."""
    files, parts = [], None
    for name, layout in layouts.items():
        own = intervals(erased[name], layout.size).withColumn("file", F.col("file_no") + F.lit(len(files)))
        parts = own if parts is None else parts.unionByName(own)
        files += [(name, no, layout.files[no][0]) for no in sorted(layout.files)]
    total = sum(b for layout in layouts.values() for _, b in layout.files.values())
    dealt = _deal(parts, files, total, "file").sortWithinPartitions("file", "lo")
    folder = f"{root}/_staging"

    def run(batches):
        out = []
        for number, gaps in _runs(batches):
            total = 0

            def counted(gaps=gaps):
                nonlocal total
                for lo, hi in gaps:
                    total += hi - lo
                    yield lo, hi

            name, no, path = files[number]
            target = f"{folder}/{number}-{uuid.uuid4().hex}.parquet"
            kept, whole = rewrite_file(path, target, counted())
            if kept + total != whole:
                raise RuntimeError(f"{path}: {kept} rows kept and {total} erased of {whole}")
            out.append((name, no, total, kept, path, target if kept else None))
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=MANIFEST.replace(",", "").split()[::2])

    spark = parts.sparkSession
    make_folder(spark, folder)
    return materialize(map_arrow(dealt.select("file", "lo", "hi"), run, MANIFEST), "erasure-manifest")


MANIFEST = "table_name string, file_no long, n_erased long, n_rows long, path string, staged string"


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def publish(manifest: DataFrame, root: str) -> None:
    """Replace the old files by the staged ones (FILES a table at most) and drop the staging folder."""
    spark = manifest.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in manifest.collect():
        old = jvm.org.apache.hadoop.fs.Path(row["path"])
        fs = old.getFileSystem(conf)
        staged = row["staged"] and jvm.org.apache.hadoop.fs.Path(row["staged"])
        if staged is None or fs.exists(staged):
            fs.delete(old, False)
            if staged is not None and not fs.rename(staged, old):
                raise OSError(f"{row['staged']} was not moved to {row['path']}; call publish() again")
    drop_path(spark, f"{root}/_staging")


# ------------------------------------------------------------------ report

REPORT = "file_no long, n_rows long, n_erased long, cents long, rewritten boolean, table_name string, ids_sha256 string, columns string, path string"


def file_digest(path: str, value: str) -> tuple[int, int, str, str]:
    """(rows, cents, SHA-256 of the first column, names of the columns) of a Parquet file, read in batches."""
    fs, own = open_folder(path)
    digest, rows, cents = hashlib.sha256(), 0, 0
    with fs.open_input_file(own) as f:
        source = pq.ParquetFile(f)
        names = source.schema_arrow.names
        for batch in source.iter_batches(batch_size=BATCH_ROWS, columns=list(dict.fromkeys([names[0], value]))):
            if batch.num_rows:
                ids = batch.column(names[0]).cast(pa.string()).fill_null("").to_pylist()
                digest.update(("," * (rows > 0) + ",".join(ids)).encode())
                amount = np.floor(100 * np.asarray(batch.column(value).cast(pa.float64()).fill_null(0.0)) + 0.5)
                cents += int(np.where(np.isfinite(amount), amount, 0).astype(np.int64).sum())
                rows += batch.num_rows
    return rows, cents, digest.hexdigest(), ",".join(names)


def report(layouts: dict[str, Layout], manifest: DataFrame, root: str) -> DataFrame:
    """One row a file that is there now, read back from it."""
    spark = manifest.sparkSession
    done = {(r["table_name"], r["file_no"]): r["n_erased"] for r in manifest.collect()}
    found, total = [], 0
    for name, layout in layouts.items():
        there = list_files(spark, f"{root}/{name}")
        found += [(len(found) + k, name, no, there[no][0], layout.source.value) for k, no in enumerate(sorted(there))]
        total += sum(b for _, b in there.values())
    dealt = _deal(spark.createDataFrame(found, "number int, name string, no long, path string, value string"), found, total, "number")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            for _, name, no, path, value in zip(*(c.to_pylist() for c in b.columns)):
                rows, cents, digest, names = file_digest(path, value)
                row = (no, rows, done.get((name, no), 0), cents, (name, no) in done, name, digest, names, re.sub(r"^file:/+", "/", path))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=REPORT.replace(",", "").split()[::2])

    return materialize(map_arrow(dealt, run, REPORT), "erasure-report")


def erase(sources: list[Source], root: str | None = None) -> DataFrame:
    """Lay out the tables under root, erase the victims from their files, and report on the files that are left. A table
    comes after those it refers to."""
    root = root or scratch_path(sources[0].keyed.sparkSession, "erasure")
    layouts = {s.name: lay_out(s, root) for s in sources}
    manifest = stage(layouts, victims(layouts), root)
    publish(manifest, root)
    return report(layouts, manifest, root)


# ------------------------------------------------------------------ the shop's tables


def top_master(clients: DataFrame, clicks: DataFrame) -> int | None:
    """The master whose clients together have most clicks; of equal ones the smallest."""
    per_client = materialize(clicks.groupBy("client_id").agg(F.count(F.lit(1)).alias("clicks")), "clicks-per-client")
    owners = clients.where("master_id IS NOT NULL").select("client_id", "master_id").distinct()
    totals = owners.join(per_client, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"))
    first = totals.orderBy(F.col("clicks").desc(), "master_id").first()
    return first and first["master_id"]


def shop_sources(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, every: int = 100) -> list[Source]:
    """The four tables, with the masters whose CRC-32 is divisible by `every`, and the top one, as victims."""
    master = top_master(clients, clicks)
    chosen = F.crc32(F.col("row.master_id").cast("string").cast("binary")) % every == 0
    if master is not None:
        chosen = chosen | (F.col("row.master_id") == F.lit(master))
    # of a sale that is repeated the smallest client counts; written, so that a hot sale's lines can be split by the engine
    owners = sales.where("sale_id IS NOT NULL").groupBy(F.col("sale_id").alias("__sale")).agg(F.min("client_id").alias("__client"))
    owners = materialize(owners, "sale-clients")
    lines = sale_lines.join(owners, sale_lines["sale_id"] == owners["__sale"], "left")
    row = F.struct(*[sale_lines[c] for c in sale_lines.columns])
    client = (("client_id", "clients", "client_id"),)
    return [
        Source("clients", with_key(clients, crc_key(clients["client_id"])), "balance", marked=lambda rows: rows.where(chosen)),
        Source("clicks", with_key(clicks, crc_key(clicks["client_id"])), "value", client),
        Source("sales", with_key(sales, crc_key(sales["client_id"])), "total", client),
        Source("sale_lines", lines.select(crc_key(F.col("__client")).alias("key"), row.alias("row")), "amount", (("sale_id", "sales", "sale_id"),)),
    ]
