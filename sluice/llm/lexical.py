"""Ranked lexical search: Fagin's threshold algorithm over impact-sorted lists, with a forward index for random access.

Documents are read once into a forward index (a Parquet table: a document's length, and its occurrences of the items'
terms). A second pass turns each stretch of the index, of SHARD_ROWS documents or SHARD_POSTINGS postings at most, into one
impact-sorted list a term and searches it for every item: the lists are read round-robin, a block of entries from each; a
document met for the first time gets its whole score from the forward index; the search ends when the threshold, the sum
of the impacts last read, falls strictly below the k-th best score known (that of earlier stretches of the task counts).
The best k of each task meet in a salted, then in a global rank. A stretch is bounded, so a frequent term's list is too.

The items are the query set. They are taken in blocks of BLOCK_TERMS terms on average, so that what every task holds of
them is bounded; each block reads the documents once.

Defined results: terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lowered. A
null text has no term. Rows that repeat a doc_id are documents of their own; a null doc_id sorts after every other. Rows
that repeat an item_id are one item, with the terms of all of them. An item without a term or a hit gives no row, an empty
table an empty result. Equal scores are ranked by doc_id. Other columns are not read and may have any name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_arrow, materialize, shuffle_partitions, text_buffer

#: Documents and postings of one stretch of the forward index: about 100 MB of arrays.
SHARD_ROWS = 1 << 15
SHARD_POSTINGS = 1 << 22
#: Terms of a block of items: some 30 MB in each task.
BLOCK_TERMS = 200_000
#: Entries that the first round reads from each list; a later round reads twice as many as the one before.
FIRST_DEPTH = 64
#: Bytes of one text that are split at once.
PIECE = 4 << 20

_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: As a regular expression over characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_in(raw: bytes):
    """The terms of a text (UTF-8), in lists of those of a piece."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row an item that has terms: item_id, terms (distinct)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.translate(F.col(text_col), upper, upper.lower()), F.lit(TERM), F.lit(0))
    rows = items.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(found)).alias("term"))
    return rows.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def forward_index(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document that has terms: doc_id, n (its terms), terms (numbers of those that `numbers` holds), tfs."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([held.schema["doc_id"], *StructType.fromDDL("n long, terms array<int>, tfs array<int>").fields])
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        number = shared.value.get
        for whole in batches:
            buf, offs, _ = text_buffer(whole.column(1))
            rows, sizes, terms, tfs = [], [], [], []
            for row, (i, j) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                n, found = 0, Counter()
                for words in terms_in(buf[i:j].tobytes()):
                    n += len(words)
                    found.update(map(number, words))
                if n:
                    found.pop(None, None)
                    rows.append((row, n))
                    sizes.append(len(found))
                    terms += found.keys()
                    tfs += found.values()
            if rows:
                at, n = zip(*rows)
                cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(at)), pa.array(n, pa.int64()), *lists], names=schema.names)

    return map_arrow(held, run, schema)


class Shard:
    """A stretch of the forward index, as arrays, with its impact-sorted lists."""

    def __init__(self, batch: pa.Table, weights: np.ndarray, docs: int, total: int):
        batch = batch.take(pc.sort_indices(batch.column(0)))  # nulls last; equal scores then go by place
        self.ids = batch.column(0).combine_chunks()
        terms, tfs = (batch.column(k).combine_chunks() for k in (2, 3))
        n = np.asarray(batch.column(1).combine_chunks(), np.int64)
        size = np.asarray(pc.list_value_length(terms), np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.term = np.asarray(terms.flatten(), np.int64)
        tf = np.asarray(tfs.flatten(), np.int64)
        m = np.repeat(50 + 50 * n * docs // total, size)
        self.impact = weights[self.term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        doc = np.repeat(np.arange(len(n)), size)
        order = np.lexsort((doc, -self.impact, self.term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_start = np.searchsorted(self.term[order], np.arange(len(weights) + 1))

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of documents, over the terms that `wanted` marks."""
        size = self.first[docs + 1] - self.first[docs]
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.first[docs] - start, size)
        return np.add.reduceat(self.impact[at] * wanted[self.term[at]], start)  # a document met in a list has a posting

    def search(self, terms: np.ndarray, k: int, floor: int = 0, depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, entries read) of the k best documents with a score above 0, but for such below `floor`."""
        at, end = self.list_start[terms], self.list_start[terms + 1]
        at, end = at[at < end], end[at < end]
        wanted = np.zeros(len(self.list_start) - 1, bool)
        wanted[terms] = True
        seen = np.zeros(len(self.ids), bool)
        best, score, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while (at < end).any():
            take = np.minimum(depth, end - at)
            entry = np.arange(take.sum()) + np.repeat(at - (np.cumsum(take) - take), take)
            met = np.unique(self.list_doc[entry])
            met = met[~seen[met]]
            seen[met] = True
            at, read, depth = at + take, read + len(entry), depth * 2
            if len(met):
                best, score = np.concatenate([best, met]), np.concatenate([score, self.scores(met, wanted)])
                order = np.lexsort((best, -score))[:k]
                best, score = best[order], score[order]
            threshold = int(self.list_impact[at - 1][at < end].sum())
            if threshold < max(floor, int(score[-1]) if len(score) == k else 0):
                break
        keep = score > 0
        return best[keep], score[keep], read


def _stretches(batches):
    held, rows, postings = [], 0, 0
    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            b = whole.slice(lo, 4096)
            held.append(b)
            rows, postings = rows + b.num_rows, postings + (pc.sum(pc.list_value_length(b.column(2))).as_py() or 0)
            if rows >= SHARD_ROWS or postings >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """Ranks from 1, k an item at most: within salts first, so that no task ranks what all tasks found."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_partitions(rows.sparkSession)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", salt).orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    wanted = materialize(item_terms(items, item_col, item_text), "item-terms")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_terms)
    parts = []
    for block in range(max(blocks, 1)):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if total else []
        parts.append(_search_block(docs, wanted.schema["item_id"], own, k, id_col, text_col))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search_block(docs: DataFrame, item_field: StructField, own: list, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    terms = [np.array(sorted(numbers.setdefault(t.encode(), len(numbers)) for t in row["terms"]), np.int64) for row in own]
    index = materialize(forward_index(docs, numbers, id_col, text_col), "forward-index")
    n, length = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = {r["term"]: r["count"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) if t in df else 0 for t in range(len(numbers))], np.int64)
    schema = StructType([StructField("item_id", item_field.dataType), index.schema["doc_id"], StructField("score", LongType())])
    shared = spark.sparkContext.broadcast(([row["item_id"] for row in own], terms, weights))
    item_type = pa.array([row["item_id"] for row in own]).type if own else pa.int64()

    def run(batches):
        names, wanted, weight = shared.value
        floors: list[list[int]] = [[] for _ in names]
        for stretch in _stretches(batches):
            shard = Shard(stretch, weight, n, length)
            for i, name in enumerate(names):
                held = floors[i]
                place, score, _ = shard.search(wanted[i], k, held[-1] if len(held) == k else 0)
                if len(place):
                    floors[i] = sorted([*held, *score.tolist()], reverse=True)[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(place), item_type), shard.ids.take(pa.array(place)), pa.array(score)], names=schema.names)

    return _best(map_arrow(index, run, schema), k)
