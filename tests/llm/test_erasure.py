"""Operator 12 against brute force on the shop's tables and on small ones; slices, intervals, and a repeated publication."""

import hashlib
import math
import os
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sluice.llm import erasure

CLIENTS = "client_id long, master_id long, name string, balance double"
CLICKS = "click_id long, client_id long, value double"
SALES = "sale_id long, client_id long, total double"
LINES = "sale_id long, line_no int, amount double"


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def low(row):
    return tuple((v is not None, 0 if v is None else v) for v in row)


def brute(tables, every):
    """{(table, file_no): (n_rows, n_erased, cents, rewritten, ids_sha256)} of the files that are left."""
    clients, clicks, sales, lines = tables
    per_client = Counter(c[1] for c in clicks)
    masters = {}
    for c in clients:
        if c[1] is not None:
            masters.setdefault(c[1], set()).add(c[0])
    chosen = {m for m in masters if crc(m) % every == 0}
    if masters:
        chosen.add(min(masters, key=lambda m: (-sum(per_client[c] for c in masters[m] if c is not None), m)))
    gone = {c[0] for c in clients if c[1] in chosen and c[0] is not None}
    owner = {}
    for s in sales:
        if s[0] is not None:
            owner[s[0]] = min((x for x in (owner.get(s[0]), s[1]) if x is not None), default=None)
    dead = {s[0] for s in sales if s[1] in gone and s[0] is not None}
    jobs = [
        ("clients", clients, lambda r: r[0], lambda r: r[1] in chosen, -1),
        ("clicks", clicks, lambda r: r[1], lambda r: r[1] in gone, -1),
        ("sales", sales, lambda r: r[1], lambda r: r[1] in gone, -1),
        ("sale_lines", lines, lambda r: owner.get(r[0]), lambda r: r[0] in dead, -1),
    ]
    out = {}
    for name, rows, key, victim, at in jobs:
        rows = sorted(rows, key=lambda r: (crc(key(r)), low(r)))
        size = 1 + len(rows) // erasure.FILES
        for no in range(-(-len(rows) // size)):
            part = rows[no * size : no * size + size]
            left = [r for r in part if not victim(r)]
            if left:
                cents = sum(math.floor(100 * (r[at] or 0) + 0.5) for r in left)
                ids = ",".join("" if r[0] is None else str(r[0]) for r in left)
                out[name, no] = (len(left), len(part) - len(left), cents, len(left) < len(part), hashlib.sha256(ids.encode()).hexdigest())
    return out


def make(n):
    """Clients of few masters, one with a third of the clicks; repeated rows, nulls, references to nothing."""
    clients = [(i if i % 41 else None, (i * 7 % 60) if i % 13 else None, None if i % 5 == 0 else f"n{i % 7}", i / 3 if i % 11 else None) for i in range(n)] + [(3, 59, "twice", -1.005)]
    clicks = [(i, 9 if i % 3 == 0 else i * 31 % (n + 9) if i % 17 else None, -i / 7 if i % 10 else None) for i in range(4 * n)] * 2
    sales = [(i, i * 13 % n if i % 19 else None, i * 1.115) for i in range(2 * n)] + [(None, 9, 4.0), (5, 2, 5.0)]
    lines = [(i * 17 % (2 * n + 5) if i % 23 else None, i % 4, i / 9 if i % 8 else None) for i in range(5 * n)] + [(7, 1, 2.5)] * n
    return clients, clicks, sales, lines


def run(spark, tables, every, root=None):
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in zip(tables, (CLIENTS, CLICKS, SALES, LINES))]
    return erasure.erase(erasure.shop_sources(*frames, every=every), root)


def seen(rows):
    return {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256) for r in rows}


@pytest.fixture(autouse=True)
def few_files(monkeypatch):
    monkeypatch.setattr(erasure, "FILES", 12)


@pytest.mark.parametrize("n, every, bound, files", [(400, 9, 100_000, 12), (400, 9, 1, 12), (60, 100, 100_000, 150), (1, 1, 100_000, 12)])
def test_erasure(spark, tmp_path, monkeypatch, n, every, bound, files):
    monkeypatch.setattr(erasure, "BROADCAST_IDS", bound)
    monkeypatch.setattr(erasure, "FILES", files)
    tables = make(n)
    rows = run(spark, tables, every, f"{tmp_path}/final").collect()
    assert seen(rows) == brute(tables, every)
    assert any(r.rewritten for r in rows) or n == 1
    on_disk = {os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/final") for f in fs if f.endswith(".parquet")}
    assert on_disk == {r.path for r in rows}
    for r in rows:
        meta = pq.ParquetFile(r.path).metadata
        table = pq.ParquetFile(r.path).read()
        assert meta.num_rows == r.n_rows and r.columns == ",".join(table.column_names)
        first = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
        ids = [x for x in table.column(0).to_pylist() if x is not None]
        if ids:
            assert min(s.min for s in first if s.has_min_max) == min(ids) and max(s.max for s in first if s.has_min_max) == max(ids)


def test_spark_reads_rewritten_files(spark, tmp_path):
    tables = make(300)
    rows = run(spark, tables, 7, f"{tmp_path}/final").collect()
    for name, k in (("clients", 0), ("sale_lines", 3)):
        back = spark.read.parquet(f"{tmp_path}/final/{name}")
        assert back.count() == sum(r.n_rows for r in rows if r.table_name == name)
        assert not Counter(map(tuple, back.collect())) - Counter(tables[k])


def test_empty_tables(spark, tmp_path):
    assert run(spark, ([], [], [], []), 3, f"{tmp_path}/a").collect() == []
    tables = make(30)
    got = run(spark, ([], *tables[1:]), 3, f"{tmp_path}/b").collect()
    assert seen(got) == brute(([], *tables[1:]), 3) and not any(r.rewritten for r in got)


def test_publication_can_be_repeated(spark, tmp_path, monkeypatch):
    tables = make(200)
    want = brute(tables, 5)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(tables, (CLIENTS, CLICKS, SALES, LINES))]
    root = f"{tmp_path}/final"
    layouts = {s.name: erasure.lay_out(s, root) for s in erasure.shop_sources(*frames, every=5)}
    manifest = erasure.stage(layouts, erasure.victims(layouts), root)
    with monkeypatch.context() as m:
        m.setattr(erasure, "drop_path", lambda *a: None)  # interrupted after a part of the moves
        erasure.publish(manifest.limit(5), root)
    erasure.publish(manifest, root)
    assert seen(erasure.report(layouts, manifest, root).collect()) == want
    erasure.publish(manifest, root)
    assert seen(erasure.report(layouts, manifest, root).collect()) == want


def test_intervals_and_slices(spark):
    ranks = [0, 1, 2, 5, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 31]
    df = spark.createDataFrame([(r,) for r in ranks], "rank long")
    for block in (4, 1000):
        spans = sorted(tuple(r) for r in erasure.intervals(df, 10, block).collect())
        assert all(0 <= lo < hi <= 10 for _, lo, hi in spans)
        assert sorted(f * 10 + x for f, lo, hi in spans for x in range(lo, hi)) == ranks
    assert sorted(tuple(r) for r in erasure.intervals(df, 10, 1000).collect()) == [(0, 0, 3), (0, 5, 6), (0, 9, 10), (1, 0, 10), (2, 0, 1), (3, 1, 2)]
    batches = [pa.record_batch({"x": list(range(a, a + 8))}) for a in range(0, 40, 8)]
    for gaps in ([], [(0, 40)], [(0, 3), (3, 5), (7, 20), (39, 40)], [(8, 16)], [(15, 17), (24, 32)]):
        left = [x for s in erasure.surviving_slices(iter(batches), iter(gaps)) for x in s.column(0).to_pylist()]
        assert left == [x for x in range(40) if not any(lo <= x < hi for lo, hi in gaps)]
    part = next(erasure.surviving_slices(iter(batches), iter([(0, 3)])))
    assert part.column(0).buffers()[1].address == batches[0].column(0).buffers()[1].address  # shared, not copied
