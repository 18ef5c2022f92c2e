"""Training-order materialisation of token ids.

Documents are encoded, an end-of-text id is put after each, and the stream of each input partition is cut into sequences
of LENGTH ids (the last one is filled up with end-of-text). A text has no more tokens than bytes, so the bytes of each
partition, summed before, bound its sequences: partition p numbers its own from base(p) on, and all numbers are below
N. A keyed Feistel permutation over the smallest even number of bits that holds N, walked along its cycle until it is
below N, maps each number to a place; it is a bijection, so no two sequences meet. Range partitions of the places are
sorted and written as one shard each, of records of the same size. A sequence's global slot is its rank: the records of
the shards before its own, and its position; record r of a shard is at byte r * stride. Reading can begin at any slot
and goes on in order.

Texts are encoded once, and nothing but the shuffle and the shards is on disk. Both passes must see the same partitions;
this holds for file scans, and anything else is first written to the shared folder. Each partition's rows and bytes must be
those of the first pass exactly, and the shards must hold the end of every document; else the run fails. A shard is written under a name of its task's own and then renamed, so a task that runs again
replaces it by the same bytes.

Defined results: a null or empty text is one end-of-text id. Rows that repeat, repeat. A null doc_id is carried. An
empty table gives no shard and no row.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, mix64, open_folder, scratch_path, shuffle_partitions, text_buffer
from .tokens import END_OF_TEXT, TOKENIZERS, BpeEncoder, text_slices

LENGTH = 2048
ROUNDS = 4


# ------------------------------------------------------------------ permutation


class Feistel:
    """A keyed bijection of 0 to n - 1."""

    def __init__(self, n: int, key: int = 1234, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _once(self, x: np.ndarray) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for k in self.keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return left << h | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix64(left + k) & mask), left
        return left << h | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(x.astype(np.uint64))
        while len(far := np.flatnonzero(out >= self.n)):
            out[far] = step(out[far])
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._once)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._back)


# ------------------------------------------------------------------ shards


def shard_of(place, n: int, shards: int):
    return place * shards // n


class ShardReader:
    """Sequential reads from any slot on. sizes: the number of records of each shard."""

    def __init__(self, path: str, sizes: list[int], length: int = LENGTH):
        self.path, self.length = path, length
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def read(self, slot: int, count: int):
        fs, root = open_folder(self.path)
        end, stride = min(slot + count, int(self.starts[-1])), 2 * self.length
        while slot < end:
            k = int(np.searchsorted(self.starts, slot, "right")) - 1
            last = min(end, int(self.starts[k + 1]))
            with fs.open_input_file(f"{root}/shard-{k:06d}.bin") as f:
                f.seek((slot - int(self.starts[k])) * stride)
                raw = f.read((last - slot) * stride)
            yield from np.frombuffer(raw, "<u2").reshape(-1, self.length)
            slot = last


# ------------------------------------------------------------------ passes


def _stable(docs: DataFrame) -> bool:
    """Whether the plan is a file scan with projections and filters, whose partitions are the same on each run."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return "FileScan" in plan and not any(x in plan for x in ("Exchange", "Union", "Sample ", "Coalesce ", "InMemoryTableScan", "Scan ExistingRDD"))


SEQUENCE = "place long, shard int, first_doc long, n_docs int, n_ids int, payload binary, n_ends int"


def _sequences(path: str, base: dict[int, tuple[int, int, int]], n: int, shards: int, length: int, key: int):
    """base: of each partition the number of its first sequence, its rows and its bytes with one more a row."""
    schema = pa.schema([("place", pa.int64()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("n_ends", pa.int32())])
    perm = Feistel(n, key)

    def run(batches):
        enc = BpeEncoder(path)
        part = TaskContext.get().partitionId()
        number, *want = base.get(part, (0, 0, 0))
        bound, got = number - (-want[1] // length), np.zeros(2, np.int64)

        def cut(ids, owner, rank, count, real):
            """Whole sequences of the ids; owner and rank: the doc_id and the running number of each id's document."""
            m = len(ids) // length
            rows = ids[: m * length].reshape(m, length)
            place = perm.forward(np.arange(count, count + m))
            r = rank[: m * length].reshape(m, length)
            return pa.RecordBatch.from_arrays([
                pa.array(place), pa.array(shard_of(place, n, shards).astype(np.int32)), pa.array([owner[k] for k in r[:, 0].tolist()], pa.int64()),
                pa.array((r[:, -1] - r[:, 0] + 1).astype(np.int32)), pa.array(real, pa.int32()), pa.array([x.tobytes() for x in rows.astype("<u2")], pa.binary()),
                pa.array([int((x[:k] == END_OF_TEXT).sum()) for x, k in zip(rows, real)], pa.int32())], schema=schema)

        ids, rank, docs, seen = np.zeros(0, np.uint16), np.zeros(0, np.int64), {}, 0
        for whole in batches:
            offs = text_buffer(whole.column(1))[1]
            got += whole.num_rows, int(offs[-1] - offs[0]) + whole.num_rows
            for b in text_slices(whole, 1):
                new = enc.encode(b.column(1).to_pylist())
                size = np.array([len(x) + 1 for x in new])
                end = np.array([END_OF_TEXT], np.uint16)
                ids = np.concatenate([ids, *[y for x in new for y in (x, end)]])
                rank = np.concatenate([rank, np.repeat(np.arange(seen, seen + len(new)), size)])
                docs.update(zip(range(seen, seen + len(new)), b.column(0).to_pylist()))
                seen += len(new)
                if number + len(ids) // length > bound:
                    raise RuntimeError("the input's partitions changed between the passes")
                m = len(ids) // length
                if m:
                    yield cut(ids, docs, rank, number, [length] * m)
                    number += m
                    ids, rank = ids[m * length :], rank[m * length :]
                    low = int(rank[0]) if len(rank) else seen
                    docs = {k: v for k, v in docs.items() if k >= low}
        if got.tolist() != want:
            raise RuntimeError("the input's partitions changed between the passes")
        if len(ids):
            real = len(ids)
            fill = length - real
            ids = np.concatenate([ids, np.full(fill, END_OF_TEXT, np.uint16)])
            rank = np.concatenate([rank, np.full(fill, rank[-1])])
            yield cut(ids, docs, rank, number, [real])

    return run


WRITTEN = "shard int, position long, place long, first_doc long, n_docs int, n_ids int, crc32 long, n_ends int"


def _writer(path: str):
    schema = pa.schema([("shard", pa.int32()), ("position", pa.int64()), ("place", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int32()), ("crc32", pa.int64()), ("n_ends", pa.int32())])

    def run(batches):
        """A partition holds whole shards, sorted by place; a file is written as the rows come."""
        fs, root = open_folder(path)
        out = own = shard = None
        at = 0

        def close():
            if out is not None:
                out.close()
                fs.move(own, f"{root}/shard-{shard:06d}.bin")

        for b in batches:
            position, payloads = [], b.column(5).to_pylist()
            for k, raw in zip(b.column(1).to_pylist(), payloads):
                if k != shard:
                    close()
                    fs.create_dir(root, recursive=True)
                    shard, own, at = k, f"{root}/_{k:06d}-{uuid.uuid4().hex}", 0
                    out = fs.open_output_stream(own)
                out.write(raw)
                position.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(position, pa.int64()), b.column(0), b.column(2), b.column(3), b.column(4), pa.array([zlib.crc32(x) for x in payloads], pa.int64()), b.column(6)], schema=schema)
        close()

    return run


def write_training_order(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZERS["byte_bpe_50k"], length: int = LENGTH, shards: int | None = None, key: int = 1234, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, list[int]]:
    """Write the shards. Returns (a row per sequence: slot, shard, byte_offset, place, first_doc, n_docs, n_ids, crc32;
    the folder; the records of each shard)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not _stable(rows):
        rows = materialize(rows, "ordered-input")
    size = rows.select(F.spark_partition_id().alias("part"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n"))
    base, n, docs_in = {}, 0, 0
    for part, count, total in sorted(size.groupBy("part").agg(F.count(F.lit(1)), F.sum("n")).collect()):  # one row a partition
        base[part] = (n, count, total)
        n += -(-total // length)
        docs_in += count
    shards = min(shards or shuffle_partitions(spark), max(n, 1))
    seqs = map_arrow(rows, _sequences(tokenizer, base, n, shards, length, key), SEQUENCE) if n else spark.createDataFrame([], SEQUENCE)
    laid = seqs.repartitionById(shards, F.col("shard")).sortWithinPartitions("place")
    written = materialize(map_arrow(laid, _writer(path), WRITTEN), "shard-manifest")
    per_shard = written.groupBy("shard").agg(F.count(F.lit(1)), F.sum("n_ends")).collect()  # one row a shard
    if sum(x[2] for x in per_shard) != docs_in:
        raise RuntimeError("the input's partitions changed between the passes")
    count = {x[0]: x[1] for x in per_shard}
    sizes = [count.get(k, 0) for k in range(shards)]
    first = spark.createDataFrame([(k, int(s)) for k, s in enumerate(np.cumsum([0, *sizes])[:-1])], "shard int, start long")
    out = written.join(F.broadcast(first), "shard")  # shards are as many as shuffle partitions
    return out.select((F.col("start") + F.col("position")).alias("slot"), "shard", (F.col("position") * (2 * length)).alias("byte_offset"), "place", "first_doc", "n_docs", "n_ids", "crc32"), path, sizes
