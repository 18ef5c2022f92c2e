"""The topic model at scale: a vocabulary, exact sublinear TF-IDF rows without a shuffle, and logistic regressions of all
labels, group by group: a group's labels share each pass, whose gradients are summed as one matrix, until all have converged."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import written

_LETTERS = bytes(b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Features whose gradients are summed in one row: 1024 times the labels of a group.
BLOCK = 1024
#: Coefficients of a group of labels that are fitted together, and its labels; every label is in a group, of one label at least.
MODEL = 1 << 20
LABELS = 1024
#: Steps that a label's fit remembers.
MEMORY = 12
#: Weights and documents in one row of a packed table, and bytes of its row groups.
PACK = 1 << 15
PACK_ROWS = 4096
ROW_GROUP = 4 << 20
#: Scores that are computed at once.
VALUES = 1 << 20
#: Bytes of text that are Python objects at once.
TEXT_BYTES = 1 << 20
#: Terms that a task counts before it passes them on.
TERMS = 1 << 17


def words(text: str | None) -> list[bytes]:
    """The runs of two ASCII letters or more, lowered."""
    return [w for w in (text or "").encode().translate(_LETTERS).split() if len(w) > 1]


def pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `limit` bytes (of lists: elements) of a column, of one row at least: what is made of a slice
    does not grow with the batch, which has as many rows as the input gives."""
    c = batch.column(column)
    size = pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)
    ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def vocabulary(df: DataFrame, text: str, features: int = 20_000, min_df: int = 2) -> DataFrame:
    """(term, df, number): the terms of most documents, ties by term; `features` rows at most. A task counts its documents by
    term before the shuffle, TERMS terms or a slice's more at once."""

    def run(batches):
        found = Counter()
        for b in batches:
            for piece in pieces(b, 0, TEXT_BYTES):
                for t in piece.column(0).to_pylist():
                    found.update(set(words(t)))
                if len(found) > TERMS:
                    yield counted(found)
                    found.clear()
        yield counted(found)

    def counted(found):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    counts = df.select(text).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_df)
    top = counts.orderBy(F.desc("df"), "term").limit(features)
    return written(top.withColumn("number", F.row_number().over(W.orderBy(F.desc("df"), "term")) - 1), "vocabulary")


def tfidf_rows(df: DataFrame, keep: list[str], text: str, vocab: DataFrame, n: int) -> DataFrame:
    """The columns of keep with each text's terms (their numbers, ascending) and weights: (1 + ln tf)(ln((1 + n)/(1 + df)) + 1)
    over the vocabulary, of length 1. The vocabulary goes to every task: it has a bounded number of terms."""
    held = df.select(*keep, F.col(text).alias("__text"))
    schema = StructType([*held.schema.fields[:-1], *StructType.fromDDL("terms array<int>, weights array<double>").fields])
    found = vocab.collect()
    idf = np.zeros(1 + max((r["number"] for r in found), default=0))
    for r in found:
        idf[r["number"]] = math.log((1 + n) / (1 + r["df"])) + 1
    shared = df.sparkSession.sparkContext.broadcast(({r["term"].encode(): r["number"] for r in found}, idf))

    def run(batches):
        known, idf = shared.value
        for whole in batches:
            for b in pieces(whole, whole.num_columns - 1, TEXT_BYTES):
                own = [[x for x in map(known.get, words(t)) if x is not None] for t in b.column(b.num_columns - 1).to_pylist()]
                key = np.concatenate([np.array(x, np.int64) + i * len(idf) for i, x in enumerate(own)])
                key, count = np.unique(key, return_counts=True)
                doc, number = np.divmod(key, len(idf))
                raw = (1 + np.log(count)) * idf[number]
                weight = raw / np.sqrt(np.bincount(doc, raw * raw, b.num_rows))[doc]
                ends = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (number.astype(np.int32), weight)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], names=schema.names)

    return held.mapInArrow(run, schema)


def top_terms(rows: DataFrame, keep: list[str], vocab: DataFrame, k: int) -> DataFrame:
    """(keep, term, weight): the k terms of each row with the largest weights, rounded to nine digits; ties by term."""
    held = rows.select(*keep, "terms", "weights")
    schema = StructType([*held.schema.fields[:-2], *StructType.fromDDL("number int, weight double").fields])

    def run(batches):
        """The k largest weights of each row, and those that tie with the last of them."""
        for b in batches:
            row, number, weight = [], [], []
            for i, (terms, weights) in enumerate(zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1))):
                w = np.round(np.asarray(weights.values, float), 9)
                if len(w):
                    some = np.flatnonzero(w >= np.partition(w, -k)[-k] if len(w) > k else w == w)
                    row += [i] * len(some)
                    number += np.asarray(terms.values)[some].tolist()
                    weight += w[some].tolist()
            own = [c.take(pa.array(row, pa.int64())) for c in b.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(number, pa.int32()), pa.array(weight, pa.float64())], names=schema.names)

    flat = held.mapInArrow(run, schema)
    named = flat.join(F.broadcast(vocab.select("number", "term")), "number")
    turn = F.row_number().over(W.partitionBy(*keep).orderBy(F.desc("weight"), "term"))
    return named.withColumn("turn", turn).where(F.col("turn") <= k).select(*keep, "term", "weight")


def _packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows' terms and weights as a written table of arrays in bytes: lengths, terms, weights, and by pairs the row in the pack
    and the label's position in names. The passes read it again and again."""
    place = {x: i for i, x in enumerate(names)}

    def run(batches):
        for whole in batches:
            some = (whole.slice(lo, PACK_ROWS) for lo in range(0, whole.num_rows, PACK_ROWS))
            for b in (p for few in some for p in pieces(few, 0, PACK)):
                hits = [(i, place[x]) for i, own in enumerate(b.column(2).to_pylist()) for x in dict.fromkeys(own or ()) if x in place]
                row, label = (np.array([h[k] for h in hits], np.int32) for k in (0, 1))
                lengths = pc.list_value_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int32)
                terms, weights = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
                parts = [lengths, terms.astype(np.int32), weights.astype(float), row, label]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["lengths", "terms", "weights", "row", "label"])

    packs = rows.select("terms", "weights", "labels").mapInArrow(run, "lengths binary, terms binary, weights binary, row binary, label binary")
    return written(packs, "packs", **{"parquet.block.size": ROW_GROUP})


def _pass(packs: DataFrame, columns: np.ndarray, points: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """For each label (columns: its position in the packs' names) the gradient of the weighted mean log-loss at its point (features
    and intercept), and that loss behind it, in one pass. Parts are added in the order of the tasks."""
    shared = packs.sparkSession.sparkContext.broadcast((columns, points, weights))

    def run(batches):
        columns, points, (hit_weight, miss_weight) = shared.value
        size = points.shape[1] - 1
        total = np.zeros((len(points), size + 2))
        turn = np.argsort(columns)
        for batch in batches:
            for pack in zip(*batch.columns):
                lengths, at, value, row, label = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(pack, (np.int32, np.int32, float, np.int32, np.int32)))
                where = turn[np.minimum(np.searchsorted(columns, label, sorter=turn), len(turn) - 1)]
                ours = columns[where] == label
                hits = np.zeros((len(points), len(lengths)), bool)
                hits[where[ours], row[ours]] = True
                doc = np.repeat(np.arange(len(lengths)), lengths)
                for k, (w, hit) in enumerate(zip(points, hits)):
                    score = np.bincount(doc, w[at] * value, len(lengths)) + w[-1]
                    against = np.where(hit, -score, score)
                    loss = np.logaddexp(0, against)
                    weight = np.where(hit, hit_weight[k], miss_weight[k])
                    error = np.where(hit, -weight, weight) * np.exp(against - loss)
                    total[k, :size] += np.bincount(at, error[doc] * value, size)
                    total[k, size] += error.sum()
                    total[k, size + 1] += (weight * loss).sum()
        task = TaskContext.get().partitionId()
        for k in range(0, size + 2, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([total[:, k : k + BLOCK].tobytes()], pa.binary())], names=["block", "task", "part"])

    def added(key, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("task")
        return pd.DataFrame({"block": [key[0]], "task": [ordered["task"].iloc[0]], "part": [sum(np.frombuffer(x) for x in ordered["part"]).tobytes()]})

    kinds = "block int, task int, part binary"
    parts = packs.mapInArrow(run, kinds)
    # a tree of two levels: no task adds the parts of all others
    some = parts.withColumn("salt", F.col("task") % 16).groupBy("block", "salt").applyInPandas(lambda key, frame: added(key, frame), kinds)
    whole = some.groupBy("block").applyInPandas(lambda key, frame: added(key, frame), kinds)
    out = np.zeros((len(points), points.shape[1] + 1))
    for r in whole.collect():
        block = np.frombuffer(r["part"]).reshape(len(points), -1)
        out[:, r["block"] : r["block"] + block.shape[1]] = block
    shared.unpersist()
    return out / max(n, 1)


def _descent(size: int, step: float, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS of one convex function: yields points, is sent each one's value and gradient, and returns the point at
    which the gradient is no longer than the tolerance, or from which no step leads to a lower value that doubles can tell."""
    at = np.zeros(size)
    value, gradient = yield at
    pairs: deque = deque(maxlen=MEMORY)
    while math.sqrt(gradient @ gradient) > tolerance:
        way, used = gradient.copy(), []
        for moved, turned, r in reversed(pairs):
            used.append(r * (moved @ way))
            way -= used[-1] * turned
        way *= 1 / (pairs[-1][2] * (pairs[-1][1] @ pairs[-1][1])) if pairs else step
        for (moved, turned, r), x in zip(pairs, reversed(used)):
            way += (x - r * (turned @ way)) * moved
        slope, length = gradient @ way, 1.0
        while True:
            new = at - length * way
            new_value, new_gradient = yield new
            if new_value <= value - 1e-4 * length * slope:
                break
            length /= 2
            if length * slope <= np.finfo(float).eps * abs(value):
                return at
        moved, turned = new - at, new_gradient - gradient
        if moved @ turned > 0:
            pairs.append((moved, turned, 1 / (moved @ turned)))
        at, value, gradient = new, new_value, new_gradient
    return at


def fit_groups(rows: DataFrame, names: list[str], size: int, regularization: float = 1e-3, iterations: int | None = None, tolerance: float = 1e-7) -> Iterator[tuple[list[str], np.ndarray]]:
    """Balanced logistic regressions of all labels (rows: terms, weights, labels: an array of names), in groups of labels that are
    fitted one after another: (names, an array of size + 1 by them, the last row the intercepts). A step of a group is one pass
    over the rows, in which each of its labels is at a point of its own, until the gradient of each is within the tolerance, or
    for as many passes as `iterations` says. The driver holds one group's coefficients. Rows have length 1, and a label's
    weights mean 1, so that the first step, 1 / (1/2 + regularization), is safe."""
    n, packs = rows.count(), _packed(rows, names)
    have = {r["x"]: r["count"] for r in rows.select(F.explode(F.array_distinct("labels")).alias("x")).groupBy("x").count().collect()}
    pos = np.array([have.get(x, 0) for x in names], float)
    weights = np.stack([n / (2 * np.maximum(pos, 1)), n / (2 * np.maximum(n - pos, 1))])
    together = max(1, min(LABELS, MODEL // (size + 1)))
    for lo in range(0, len(names), together):
        group = names[lo : lo + together]
        runs = [_descent(size + 1, 1 / (0.5 + regularization), tolerance) for _ in group]
        points = np.stack([next(r) for r in runs])
        left, passes = np.arange(len(group)), 0
        while len(left) and (iterations is None or passes < iterations):
            found, passes = _pass(packs, lo + left, points[left], weights[:, lo + left], n), passes + 1
            ended = set()
            for k, own in zip(left, found):
                own[:size] += regularization * points[k, :size]
                loss = own[-1] + regularization / 2 * (points[k, :size] @ points[k, :size])
                try:
                    points[k] = runs[k].send((loss, own[:-1]))
                except StopIteration as e:
                    points[k] = e.value
                    ended.add(k)
            left = np.array([k for k in left if k not in ended], int)
        yield group, points.T


def fit_labels(rows: DataFrame, names: list[str], size: int, regularization: float = 1e-3, iterations: int | None = None) -> np.ndarray:
    """The coefficients of `fit_groups` for all names as one array; it has to fit the driver. `fit_groups` has no such bound."""
    return np.hstack([np.zeros((size + 1, 0)), *[model for _, model in fit_groups(rows, names, size, regularization, iterations)]])


def label_scores(rows: DataFrame, keep: list[str], names: list[str], coefficients: np.ndarray) -> DataFrame:
    """(keep, topic, score) of each row and label."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(coefficients.T))
    held = rows.select(*keep, "terms", "weights")
    schema = StructType([*held.schema.fields[:-2], *StructType.fromDDL("topic string, score double").fields])

    def run(batches):
        model, topics, most = shared.value, pa.array(names, pa.string()), max(1, VALUES // max(1, len(names)))
        for whole in batches:
            some = (whole.slice(lo, most) for lo in range(0, whole.num_rows, most))
            for b in (p for few in some for p in pieces(few, few.num_columns - 2, VALUES)):
                lengths = pc.list_value_length(b.column(b.num_columns - 2)).to_numpy(zero_copy_only=False)
                at, value = (b.column(b.num_columns - k).flatten().to_numpy(zero_copy_only=False) for k in (2, 1))
                doc = np.repeat(np.arange(b.num_rows), lengths)
                scores = np.empty((b.num_rows, len(names)))
                for k, w in enumerate(model):
                    z = np.bincount(doc, w[at] * value, b.num_rows) + w[-1]
                    scores[:, k] = np.exp(-np.logaddexp(0, -z))
                row, topic = np.divmod(np.arange(scores.size), max(1, len(names)))
                own = [c.take(pa.array(row)) for c in b.columns[:-2]]
                yield pa.RecordBatch.from_arrays([*own, topics.take(pa.array(topic)), pa.array(scores.ravel())], names=schema.names)

    return held.mapInArrow(run, schema)
