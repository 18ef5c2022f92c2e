"""The full sampler, choice by thresholds and two-level running sums, against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.operators import picking, ranks, sampler, stats


def pri(seed, x):
    return hashlib.sha256(f"{seed}\0{'' if x is None else x}".encode()).hexdigest()


def loop_allocate(sizes, weights, target):
    """Shares rounded down, then one each in turn by remainder while there is room."""
    if sum(sizes.values()) <= target:
        return dict(sizes)
    total = sum(weights.values())
    exact = {k: weights[k] / total * target for k in sizes}
    out = {k: min(int(exact[k]), sizes[k]) for k in sizes}
    order = sorted(sizes, key=lambda k: (-(exact[k] - out[k]), k))
    left = target - sum(out.values())
    while left:
        for k in order:
            if left and out[k] < sizes[k]:
                out[k] += 1
                left -= 1
    return out


def loop_sample(rows, labels, target, alphas, spill):
    """{id: pass} of rows (id, language, month, stars)."""
    rows = [(i, *[x or "unknown" for x in key]) for i, *key in rows]
    if len(rows) <= target:
        return {r[0]: 0 for r in rows}
    strata = defaultdict(list)
    for r in rows:
        strata[r[1:]].append(r)
    out = {}
    for at, lang in enumerate(labels):
        quota = target // len(labels) + (at < target % len(labels))
        sizes = {k: len(v) for k, v in strata.items() if k[0] == lang}
        n, weights = sum(sizes.values()), {}
        for k in sizes:
            weights[k] = 1.0 if any(alphas.values()) else float(sizes[k])
            for d, alpha in alphas.items() if any(alphas.values()) else ():
                p = 1 + ["month", "stars"].index(d)
                share = sum(m for x, m in sizes.items() if x[p] == k[p]) / n
                weights[k] *= (1 - alpha) * share + alpha / len({x[p] for x in sizes})
        for k, take in loop_allocate(sizes, weights, quota).items() if sizes else ():
            for r in sorted(strata[k], key=lambda r: (pri(42, r[0]), r[0]))[:take]:
                out[r[0]] = 1
    at = {"language": 1, "month": 2, "stars": 3}
    rest = defaultdict(list)
    for r in rows:
        if r[0] not in out:
            rest[tuple(r[at[c]] for c in spill)].append(r)
    sizes = {k: len(v) for k, v in rest.items()}
    for k, take in loop_allocate(sizes, {k: float(n) for k, n in sizes.items()}, target - len(out)).items():
        for r in sorted(rest[k], key=lambda r: (pri("42:spill", r[0]), r[0]))[:take]:
            out[r[0]] = 2
    return out


@pytest.mark.parametrize("target, alphas, spill", [
    (150, {}, None), (150, {"month": 0.5, "stars": 0.3}, None), (331, {"month": 1.0, "stars": 0.0}, ["language", "month", "stars"]), (590, {}, None), (900, {}, None), (3, {}, None)
])
def test_sample(spark, target, alphas, spill):
    rng = random.Random(7)
    langs = ["java"] * 20 + ["c"] * 300 + ["python"] * 250 + ["other"] * 25 + [None] * 5
    rows = [(i, x, rng.choice(["01", "01", "01", "02", "03", None]), rng.choice(["p0", "p0", "p1", "p3"])) for i, x in enumerate(langs)]
    df = spark.createDataFrame(rows, "id long, language string, month string, stars string").repartition(3)
    got = {r["id"]: r["pass"] for r in sampler.sample(df, "language", ["month", "stars"], ["java", "c", "python", "go"], target, "id", alphas, spill).collect()}
    assert got == loop_sample(rows, ["java", "c", "python", "go"], target, alphas, spill or ["month", "stars"])
    assert len(got) == min(target, 600)


def test_water_fill(spark):
    rng = random.Random(1)
    cases = []
    for g in range(40):
        rooms = [rng.choice([0, 0, 1, 2, 5, 9]) for _ in range(rng.randint(1, 7))]
        cases.append((g, rooms, rng.randint(0, sum(rooms))))
    rows = [(g, k, r, need) for g, rooms, need in cases for k, r in enumerate(rooms)]
    df = spark.createDataFrame(rows, "g int, k int, room long, need long")
    got = {(r.g, r.k): r.got for r in sampler.water_fill(df, ["g"], "need", "room", [F.col("k")], "got").collect()}
    for g, rooms, need in cases:
        want = [0] * len(rooms)
        while need:
            for k, r in enumerate(rooms):
                if need and want[k] < r:
                    want[k], need = want[k] + 1, need - 1
        assert [got[g, k] for k in range(len(rooms))] == want


@pytest.mark.parametrize("digits", [1, 3])
def test_pick(spark, monkeypatch, digits):
    monkeypatch.setattr(picking, "DIGITS", digits)
    rows = [(i, "hot" if i % 3 else ("rare" if i % 2 else None)) for i in range(900)]
    quotas = [("hot", 77), ("rare", 0), (None, 1000), ("absent", 4)]
    df, q = spark.createDataFrame(rows, "id long, s string"), spark.createDataFrame(quotas, "s string, quota long")
    got = {r.id for r in picking.pick(df, ["s"], q, "quota", "id").where("picked").collect()}
    want = set()
    for s, n in quotas:
        want |= set(sorted((i for i, x in rows if x == s), key=lambda i: pri(42, i))[:n])
    assert got == want
    assert picking.pick(df, ["s"], q, "quota", "id").count() == len(rows)
    assert picking.pick(df.limit(0), ["s"], q, "quota", "id").count() == 0


def test_topups_follow_the_quotas(spark):
    one = lambda rows: spark.createDataFrame(rows, "url string, lang string, day int")
    candidates = [(f"u{i}", "abc"[i % 3], i // 5) for i in range(60)]
    selected, attempted = candidates[:9], candidates[:15]
    got = sampler.quota_topups(one(candidates), one(selected), one(attempted), "lang", {"b": 5, "a": 30, "c": 4}, 20, "url", ["day"]).collect()
    want, left = [], 20 - len(selected)
    for lang, quota in (("b", 5), ("a", 30), ("c", 4)):
        free = sorted((d, u) for u, x, d in candidates[15:] if x == lang)
        n = min(quota - 3, left, len(free))
        want += [u for _, u in free[:n]]
        left -= n
    assert sorted(r.url for r in got) == sorted(want) and len(want) == 11


def test_running_sums_need_no_window_over_the_family(spark):
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else ("a" if i % 10 else "b"), i * 7919 % 2003, rng.randint(-5, 5)) for i in range(2003)]
    df = spark.createDataFrame(rows, "f string, k long, x long")
    for fold, plain in ((F.sum, sum), (F.min, min), (F.max, max)):
        for down in (False, True):
            out = ranks.running(df, ["f"], [F.col("k").desc() if down else F.col("k").asc()], "x", "r", fold)
            got, by = {r.k: r.r for r in out.collect()}, defaultdict(list)
            for f, k, x in sorted(rows, key=lambda r: -r[1] if down else r[1]):
                by[f].append(x)
                assert got[k] == plain(by[f])
    plan = ranks.running(df, ["f"], [F.col("k").asc()], "x", "r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 1 and "__range" in plan
    assert ranks.running(df, [], [F.col("k").asc()], "x", "r").agg(F.max_by("r", "k")).first()[0] == sum(r[2] for r in rows)


def test_ranks_and_adjustment_with_null_families(spark):
    rows = [(None if i % 7 == 0 else i % 3, "g" if i % 2 else "h", i % 11, (i * 37 % 50) / 50) for i in range(300)]
    df = spark.createDataFrame(rows, "f int, g string, v int, p double")
    got = Counter((r.f, r.p, round(r.q, 12)) for r in stats.benjamini_hochberg(df, ["f"], "p", "q").collect())
    want = Counter()
    for f in {r[0] for r in rows}:
        ps = sorted(r[3] for r in rows if r[0] == f)
        best = 1.0
        for k in range(len(ps), 0, -1):
            best = min(best, ps[k - 1] * len(ps) / k)
            want[f, ps[k - 1], round(best, 12)] += 1
    assert got == want
    per = {(r.f, r.g, r.v): r["rank"] for r in stats.value_ranks(df, ["f"], "v", "g").collect()}
    for (f, _, v), rank in per.items():
        vs = [r[2] for r in rows if r[0] == f]
        assert rank == sum(x < v for x in vs) + (vs.count(v) + 1) / 2
