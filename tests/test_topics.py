"""TF-IDF rows against plain counting; the joint fit against one fit a label."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from sluice.operators import topics

WORDS = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]


def texts(n=240):
    rng = random.Random(8)
    out = []
    for i in range(n):
        kind = i % 3
        out.append((i, " ".join(rng.choice(WORDS[kind * 6 : kind * 6 + 10]) for _ in range(rng.randint(3, 30))).title(), ["a", "b", "c"][kind : kind + 1 + (i % 5 == 0)] if i % 11 else []))
    return out + [(n, None, ["a"]), (n + 1, "x é 1", None)]


def test_rows_and_top_terms(spark):
    data = texts()
    df = spark.createDataFrame(data, "id long, text string, labels array<string>").repartition(4)
    vocab = topics.vocabulary(df, "text", features=15)
    bags = {i: Counter(w for w in (t or "").lower().split() if len(w) > 1 and w.isascii() and w.isalpha()) for i, t, _ in data}
    dfs = Counter(w for b in bags.values() for w in b)
    want = sorted((w for w in dfs if dfs[w] >= 2), key=lambda w: (-dfs[w], w))[:15]
    assert [r.term for r in vocab.orderBy("number").collect()] == want
    rows = topics.tfidf_rows(df, ["id"], "text", vocab, len(data))
    top = {}
    for r in topics.top_terms(rows, ["id"], vocab, 3).collect():
        top.setdefault(r.id, set()).add((r.term, r.weight))
    for r in rows.collect():
        raw = {w: (1 + math.log(c)) * (math.log((1 + len(data)) / (1 + dfs[w])) + 1) for w, c in bags[r.id].items() if w in want}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        assert dict(zip(r.terms, r.weights)) == pytest.approx({want.index(w): x / norm for w, x in raw.items()})
        best = sorted(((-round(x / norm, 9), w) for w, x in raw.items()))[:3]
        assert top.get(r.id, set()) == {(w, -x) for x, w in best}


def test_joint_fit_equals_a_fit_a_label(spark):
    data = texts()
    df = spark.createDataFrame(data, "id long, text string, labels array<string>").repartition(3)
    vocab = topics.vocabulary(df, "text", features=20)
    rows = topics.tfidf_rows(df, ["id", "labels"], "text", vocab, len(data)).cache()
    size, names = vocab.count(), ["a", "b", "c"]
    got = topics.fit_labels(rows, names, size, regularization=0.05, iterations=60)
    table = [(int(x in (r.labels or [])), x, Vectors.sparse(size, dict(zip(r.terms, r.weights)))) for r in rows.collect() for x in names]
    scores = {(r.id, r.topic): r.score for r in topics.label_scores(rows, ["id"], names, got).collect()}
    for k, x in enumerate(names):
        own = [(y, v) for y, n, v in table if n == x]
        n, pos = len(own), sum(y for y, _ in own)
        frame = spark.createDataFrame([(float(y), v, n / (2 * pos) if y else n / (2 * (n - pos))) for y, v in own], ["label", "features", "weight"])
        model = LogisticRegression(weightCol="weight", regParam=0.05, standardization=False, maxIter=200, tol=1e-10).fit(frame)
        assert np.allclose(got[:-1, k], model.coefficients.toArray(), atol=2e-3) and got[-1, k] == pytest.approx(model.intercept, abs=2e-3)
    some = rows.where("id = 7").first()
    z = got[-1] + sum(w * got[t] for t, w in zip(some.terms, some.weights))
    assert [scores[7, x] for x in names] == pytest.approx((1 / (1 + np.exp(-z))).tolist())


def test_python_holds_slices_of_a_batch(spark, monkeypatch):
    """The functions that tasks run, on one batch of 3000 texts of 300 different words: 0.9 million weights."""
    import tracemalloc

    import pyarrow as pa

    letters = [f"{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "klmnopqrst"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([None if i == 5 else " ".join(letters[i % 7 * 100 : i % 7 * 100 + 300]) for i in range(3000)])], names=["id", "text"])
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    vocab = spark.createDataFrame([(w, 3, i) for i, w in enumerate(letters)], "term string, df long, number int").cache()
    vocab.count()
    ran = []
    original = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema, **more: ran.append(fn) or original(self, fn, schema, **more))
    topics.tfidf_rows(df, ["id"], "text", vocab, 10)
    tracemalloc.start()
    rows, ids = 0, []
    for out in ran[0]([batch]):
        rows += out.num_rows
        ids += out.column(0).to_pylist()
        assert all(len(x) == (0 if i == 5 else 300) for i, x in zip(out.column(0).to_pylist(), out.column(1)))
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()
    assert rows == 3000 and ids == list(range(3000))


def test_pieces_hold_every_row_once():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 100, "", "c" * 3, "d" * 7, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([None if t is None else [1] * len(t) for t in texts])], names=["t", "x"])
    for column in (0, 1):
        cut = list(topics.pieces(batch, column, 10))
        assert [t for p in cut for t in p.column(0).to_pylist()] == texts
        assert [p.num_rows for p in cut] == [2, 1, 4]
    assert not list(topics.pieces(batch.slice(0, 0), 0, 10))


def test_every_label_is_fitted_until_it_has_converged(spark, tmp_path, monkeypatch):
    """The query on 230 languages, more than a group holds: scores of all of them, as Newton's method finds them."""
    from sluice.plans.topics import QUERIES

    rng = random.Random(9)
    letters = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrst"]
    data = [(i, " ".join(rng.choices(letters[i % 230 : i % 230 + 2] + letters[:6], k=12)), f"l{i % 230:03}") for i in range(500)]
    data += [(500, None, "l007"), (501, "aiq aiq ajr", None), (502, "", None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(topics, "LABELS", 150, raising=False)
    got = {(r.doc_id, r.topic): r.score for r in QUERIES["topic_scores"][0](spark, str(tmp_path)).collect()}
    names = [f"l{i:03}" for i in range(230)]
    assert set(got) == {(i, x) for i, _, _ in data for x in names}
    bags = [Counter((t or "").split()) for _, t, _ in data]
    dfs = Counter(w for b in bags for w in b)
    terms = [w for w in dfs if dfs[w] >= 2]
    rows = np.array([[(1 + math.log(b[w])) * (math.log((1 + len(data)) / (1 + dfs[w])) + 1) if w in b else 0 for w in terms] + [0.0] for b in bags])
    rows /= np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-300)
    rows[:, -1] = 1
    known = np.array([x is not None for _, _, x in data])
    own, ridge = rows[known], np.diag([1e-3] * len(terms) + [0.0])
    for x in ("l000", "l007", "l149", "l150", "l229"):
        y = np.array([lang == x for _, _, lang in data])[known]
        weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum())) / len(y)
        w = np.zeros(len(terms) + 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-own @ w))
            w -= np.linalg.solve((own.T * (weight * p * (1 - p))) @ own + ridge, own.T @ (weight * (p - y)) + ridge @ w)
        assert [got[i, x] for i, _, _ in data] == pytest.approx((1 / (1 + np.exp(-rows @ w))).tolist(), abs=2e-5)


def test_one_label_or_none(spark):
    data = [(i, [0, 1], [0.6, 0.8], ["a"] if i else None) for i in range(5)]
    rows = spark.createDataFrame(data, "id int, terms array<int>, weights array<double>, labels array<string>")
    model = topics.fit_labels(rows, ["none", "a"], 2)
    by = {(r.id, r.topic): r.score for r in topics.label_scores(rows, ["id"], ["none", "a"], model).collect()}
    assert len(by) == 10 and all(by[i, "none"] < 0.01 and abs(by[i, "a"] - 0.5) < 1e-4 for i in range(5))
    assert topics.label_scores(rows, ["id"], [], topics.fit_labels(rows, [], 2)).count() == 0
    alone = topics.fit_labels(rows.where("id > 0"), ["a"], 2)
    assert topics.label_scores(rows, ["id"], ["a"], alone).where("score > 0.99").count() == 5
