"""Ranges that repeat: query and SQL give the lines that a plain sweep finds, however equal ranges are ordered."""

from collections import defaultdict

import duckdb
import pytest

from sluice.plans import joins


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Events of 7 users whose ranges have many equals and lie apart, and the united ranges."""
    folder = str(tmp_path_factory.mktemp("ties"))
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT (i // 3) * 15600 + (i // 3) % 9 * 40 AS event_id, i % 7 AS user_id FROM (SELECT range * 7919 % 300000 AS i FROM range(300000)))
        TO '{folder}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    ranges = defaultdict(set)
    for user, event in con.execute("SELECT user_id, event_id FROM events").fetchall():
        ranges[user].add((event % 400, event % 400 + event % 13))
    united = []
    for user, some in ranges.items():
        own = []
        for s, e in sorted(some):
            if own and s <= own[-1][1] + 1:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        united += [(user, s, e) for s, e in own]
    return folder, con, united


def test_covered_lines(spark, tied):
    folder, con, united = tied
    want = defaultdict(int)
    for user, s, e in united:
        want[user] += e - s + 1
    sql = joins.QUERIES["covered_lines"][1]
    assert dict(map(tuple, joins.covered_lines(spark, folder).collect())) == want
    assert all(dict(con.execute(sql).fetchall()) == want for _ in range(3))


def test_merge_ranges(spark, tied):
    folder, con, united = tied
    sql = joins.QUERIES["merge_ranges"][1]
    assert sorted(map(tuple, joins.merge_ranges(spark, folder).collect())) == sorted(united)
    assert all(sorted(con.execute(sql).fetchall()) == sorted(united) for _ in range(3))


def test_windows_order_no_equal_ranges(spark, tied):
    folder, con, _ = tied
    given, apart = con.execute("SELECT count(*), count(DISTINCT (user_id, event_id % 400, event_id % 13)) FROM events").fetchone()
    assert apart < given
    assert con.execute(f"WITH {joins._ISLANDS} SELECT count(*) FROM i").fetchone() == (apart,)
    plan = joins.merge_ranges(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [user_id" in plan.split("Window")[-1]


def test_odd_events(spark, tmp_path):
    """Nulls, negatives and repeats: query and SQL agree."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES (NULL, 1), (NULL, 1), (5, NULL), (5, NULL), (-399, 1), (-399, 1), (-7, 2), (-393, 2), (18, 2), (18, 2), (31, 2), (418, 2)) t(event_id, user_id)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    for name in ("merge_ranges", "covered_lines"):
        query, sql = joins.QUERIES[name][:2]
        assert sorted(map(repr, map(tuple, query(spark, str(tmp_path)).collect()))) == sorted(map(repr, con.execute(sql).fetchall()))
