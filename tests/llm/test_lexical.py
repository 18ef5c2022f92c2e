"""Operator 11 against brute force, and its early stop."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [
    (1, "the cat sat on the mat"),
    (2, "The CAT, the hat!"),
    (3, None),
    (4, ""),
    (5, "... -- \n"),
    (6, "cat"),
    (7, "cat"),
    (8, "ÉCOLE école 日本 cat mat  x"),
    (8, "a second row of one document with a cat"),
    (9, "dog " * 5000 + "cat " * 3),
    (10, "x" * 9_000_000 + " mat " + "y " * 2_000_000),
    (None, "a cat without a number"),
    (-5, "cat"),
]
ITEMS = [(0, "Cat mat"), (1, "dog cat cat"), (2, None), (3, "?!"), (4, "absent words"), (5, "École x 日本"), (5, "hat"), (6, "the the the"), (None, "cat")]


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(w for _, c in tfs for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ws in wanted.items():
        found = []
        for i, c in tfs:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in ws if c[w])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search(spark, k):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in DOCS], "doc_id long, text string, item_id int, score string").repartition(3)
    items = spark.createDataFrame([(*r, 7) for r in ITEMS], "item_id long, text string, rank int")
    assert rows(lexical.search(docs, items, k)) == brute(DOCS, ITEMS, k)


def test_blocks_of_items_and_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:9], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(lexical.search(docs, items, 2, block_terms=3)) == brute(DOCS[:9], ITEMS, 2)
    assert rows(lexical.search(docs.limit(0), items)) == [] and rows(lexical.search(docs, items.limit(0))) == []


def test_stretches_and_ties(spark, monkeypatch):
    """Ties run over the borders of stretches and tasks: equal scores go by doc_id."""
    monkeypatch.setattr(lexical, "SHARD_ROWS", 1)
    data = [(i, "alpha beta" if i % 3 else "gamma alpha") for i in range(400)]
    items = [(0, "alpha"), (1, "beta gamma")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = rows(lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), 7))
    assert got == brute(data, items, 7)


def test_threshold_ends_the_search_early():
    rng = np.random.default_rng(3)
    size = 20_000
    tf = rng.zipf(1.6, size).clip(max=10_000).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * size + 1, 2), pa.int32()), pa.array(x, pa.int32())) for x in (np.tile([0, 1], size), np.repeat(tf, 2))]
    table = pa.table({"doc_id": np.arange(size), "n": np.full(size, 500), "terms": lists[0], "tfs": lists[1]})
    shard = lexical.Shard(table, np.array([900, 700]), size, 500 * size)
    place, score, read = shard.search(np.array([0, 1]), 10)
    whole = np.array([shard.scores(np.array([d]), np.ones(2, bool))[0] for d in range(size)])
    want = np.lexsort((np.arange(size), -whole))[:10]
    assert place.tolist() == want.tolist() and score.tolist() == whole[want].tolist()
    assert read < size / 4
    assert shard.search(np.array([0, 1]), 10, floor=int(score[0]) + 1)[2] == 2 * lexical.FIRST_DEPTH
