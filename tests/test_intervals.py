"""Intervals over all values, and exact p-values, against pairs and enumeration."""

import itertools
import math
import random

import pytest

from sluice.operators import stats

Z = 1.9599639845400536


def test_u_tail_counts_all_orders():
    for n1, n2 in ((1, 1), (2, 3), (3, 3), (4, 2), (5, 4)):
        us = [sum(sum(x > y for y in set(range(n1 + n2)) - set(own)) for x in own) for own in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert stats.u_tail(n1, n2, u) == pytest.approx(sum(x >= u for x in us) / len(us))


def test_small_samples_get_exact_p_values(spark):
    rng = random.Random(4)
    rows = []
    for f in range(12):
        values = rng.sample(range(1000), 9) if f % 3 else [rng.randint(0, 3) for _ in range(9)]
        rows += [(f, "a" if i < 3 + f % 4 else "b", float(v)) for i, v in enumerate(values)]
    rows += [(99, "ab"[i % 2], float(i * i % 997)) for i in range(60)]
    df = spark.createDataFrame(rows, "f int, g string, v double")
    for r in stats.mann_whitney_p(stats.mann_whitney(df, ["f"], "v", "g", "a", "b", ties=True)).collect():
        a, b = ([v for f, g, v in rows if f == r.f and g == x] for x in "ab")
        u = sum((x > y) + (x == y) / 2 for x in a for y in b)
        tied = len(set(a + b)) < len(a + b)
        assert (r.u, r.tied) == (u, tied)
        if not tied and min(len(a), len(b)) <= stats.EXACT:
            pool, top = a + b, max(u, len(a) * len(b) - u)
            us = [sum(x > y for x in own for y in set(pool) - set(own)) for own in map(set, itertools.combinations(pool, len(a)))]
            assert r.p_value == pytest.approx(min(1.0, 2 * sum(x >= top for x in us) / len(us)))
        else:
            assert r.p_value == pytest.approx(min(1.0, math.erfc(max(r.z, 0.0) / math.sqrt(2))) if r.z is not None else 1.0)


def test_intervals_take_all_values(spark):
    rng = random.Random(5)
    rows = [(k, "a" if i % (k + 2) else "b", None if i % 50 == 7 else float(rng.randint(0, 40) + (k == 2) * 100 * (i % (k + 2) == 0))) for k in range(3) for i in range(700)]
    df = spark.createDataFrame(rows, "f int, g string, v double")
    for r in stats.median_interval(df, ["f"], "v").collect():
        vs = sorted(v for f, _, v in rows if f == r.f and v is not None)
        n = len(vs)
        assert (r.n, r.median) == (n, (vs[(n - 1) // 2] + vs[n // 2]) / 2)
        assert r.ci_low == vs[max(1, math.floor((n - Z * math.sqrt(n)) / 2)) - 1] and r.ci_high == vs[min(n, math.ceil((n + Z * math.sqrt(n)) / 2) + 1) - 1]
    for r in stats.delta_interval(df, ["f"], "v", "g", "a", "b").collect():
        a, b = ([v for f, g, v in rows if f == r.f and g == x and v is not None] for x in "ab")
        n, m = len(a), len(b)
        d = [[(x > y) - (x < y) for y in b] for x in a]
        delta = sum(map(sum, d)) / (n * m)
        assert r.delta == pytest.approx(delta)
        rows_1 = sum((sum(row) / m - delta) ** 2 for row in d)
        rows_2 = sum((sum(col) / n - delta) ** 2 for col in zip(*d))
        pairs = sum((x - delta) ** 2 for row in d for x in row)
        var = max((m * m * rows_1 + n * n * rows_2 - pairs) / (n * m * (n - 1) * (m - 1)), (1 - delta**2) / (n * m - 1))
        if abs(delta) < 1:
            reach = Z * math.sqrt(var) * math.sqrt((1 - delta**2) ** 2 + Z * Z * var)
            base = 1 - delta**2 + Z * Z * var
            assert r.ci_low == pytest.approx((delta - delta**3 - reach) / base) and r.ci_high == pytest.approx((delta - delta**3 + reach) / base)
        else:
            assert (r.ci_low, r.ci_high) == (-1.0, pytest.approx(-(min(n, m) - Z * Z) / (min(n, m) + Z * Z)))
