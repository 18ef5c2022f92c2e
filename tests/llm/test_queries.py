"""The registered queries on a small directory: their columns, and their rows against SQL or brute force."""

import hashlib
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sluice.llm import queries, tokens

from . import test_chat as chats
from . import test_erasure as shop
from .test_operators import ROWS, brute_components

URLS = ["http://www.Example.com/en/71?x", "https://example.com", "ftp://a.com/en/", "https://x.example.net/de/8/9", "http://q.org/es/#f", None, "no scheme", "http://EXAMPLE.ORG/en"]
SHOP = shop.make(50)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{root}/pages.parquet")
    items = [(0, "hello world"), (1, "one extra tail7 tail59"), (2, None), (3, "日本 and é")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(*r, 1) for r in chats.rows()], chats.SCHEMA).repartition(2).write.parquet(f"{root}/conversations.parquet")
    for t, rows, schema in zip(("clients", "clicks", "sales", "sale_lines"), SHOP, (shop.CLIENTS, shop.CLICKS, shop.SALES, shop.LINES)):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{root}/{t}.parquet")
    return root


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == [*range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.fetchall())


def test_language_query(spark, folder):
    rows = queries.op6_language_id(spark, folder).collect()
    assert len(rows) == len(ROWS) and list(rows[0].asDict())[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_jaccard_query(spark, folder):
    want = brute_components([r[:2] for r in ROWS])
    rows = queries.op7_ngram_jaccard(spark, folder).collect()
    assert len(rows) == len(ROWS) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows)


def area_means(a, height, width):
    """The means of equal areas, by repeating every sample."""
    wide = np.repeat(a, width, axis=1).reshape(a.shape[0], width, a.shape[1]).sum(2, dtype=np.int64)
    both = np.repeat(wide, height, axis=0).reshape(height, a.shape[0], width).sum(1)
    return np.floor(both / (a.shape[0] * a.shape[1]) + 0.5 + 1e-9).astype(np.uint8)


def test_media_query(spark, folder):
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    rows = queries.op10_media_columns(spark, folder).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        raw = text[r.doc_id]
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        height = len(padded) // 64
        flat = np.frombuffer(padded, np.uint8).reshape(height, 64)
        if height <= 64:
            stored = b"P5\n64 %d\n255\n" % height + padded
        else:  # 54 bytes of headers, 256 colours, rows from the bottom
            body = flat[::-1].tobytes()
            stored = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 1078 + len(body), 0, 0, 1078, 40, 64, height, 1, 8, 0, len(body), 2835, 2835, 256, 0)
            stored += b"".join(bytes((i, i, i, 0)) for i in range(256)) + body
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        thumb, tile = area_means(flat, 8, 9), area_means(flat, 16, 16)
        bits = "".join("01"[int(x < y)] for line in thumb.tolist() for x, y in zip(line, line[1:]))
        assert r.feature == f"{int(bits, 2):016x}:{hashlib.sha256(tile.tobytes()).hexdigest()[:16]}"


def test_token_queries(spark, folder):
    bpe = {k: tokens.encoding(p) for k, p in tokens.TOKENIZERS.items()}
    want = Counter()
    for _, t, lang, source in ROWS:
        for k, e in bpe.items():
            want[source, lang, k] += len(e.encode_ordinary(t or ""))
    got = {(r.source, r.lang, r.tokenizer): r.tokens for r in queries.op3_token_counts(spark, folder).collect()}
    assert got == dict(want)
    ids = queries.op4_training_order(spark, folder).collect()
    assert sorted(r.slot for r in ids) == list(range(len(ids)))
    total = sum(len(bpe["byte_bpe_50k"].encode_ordinary(t or "")) + 1 for _, t, *_ in ROWS)
    assert sum(r.n_ids for r in ids) == total


def test_piece_and_score_queries(spark, folder):
    rows = queries.op2_sentencepiece(spark, folder).collect()
    assert len(rows) == len(ROWS) and all(r.restored or r.ids_sha256 is None for r in rows)
    scored = {r.doc_id: r for r in queries.op5_lm_scoring(spark, folder).collect()}
    assert scored[4].n_tokens == 0 and scored[4].mean_logp is None and all(r.logp < 0 for r in scored.values() if r.n_tokens)


def test_erasure_query(spark, folder):
    assert shop.seen(queries.op12_erasure(spark, folder).collect()) == shop.brute(SHOP, 100)
