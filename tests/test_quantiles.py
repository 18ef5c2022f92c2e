"""Exact quantiles without a group in one buffer, against Spark's percentile."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import aggregate


def rows():
    rng = random.Random(11)
    out = [("even", float(rng.randrange(50))) for _ in range(400)] + [("odd", rng.gauss(0, 5)) for _ in range(401)]
    out += [("zeros", 0.0)] * 30 + [("mixed", rng.choice([-3.5, -1.0, 0.0, -0.0, 2.0, 9.0])) for _ in range(222)]
    out += [("one", -4.0), ("two", -1.0), ("two", 3.0), ("gap", -2.0), ("gap", 0.0), ("gap", 0.0), ("gap", 4.0)]
    out += [("odd values", x) for x in (float("nan"), float("inf"), float("-inf"), 1.0, None)] + [(None, float(x)) for x in range(9)] + [("none", None)]
    return out


def plain(df):
    return {r.g: tuple(None if x is None else str(x) if x != x or abs(x) == float("inf") else pytest.approx(x) for x in r[1:]) for r in df.collect()}


def test_summaries_equal_percentile(spark):
    df = spark.createDataFrame(rows(), "g string, v double").repartition(3)
    p = lambda x, c="v": F.percentile(c, F.lit(x))
    want = df.where("v is not null").groupBy("g").agg(p(0.5).alias("median"), p(0.5, F.expr("nullif(v, 0)")).alias("m"), p(0.25), p(0.75))
    got = aggregate.distribution_summary(df, ["g"], "v")
    assert plain(got.select("g", "median", "median_nonzero", "q1", "q3")) == plain(want)
    assert plain(aggregate.numeric_summary(df, ["g"], "v").select("g", "n", "min", "median", "max")) == plain(df.groupBy("g").agg(F.count("v"), F.min("v"), p(0.5), F.max("v")))
    for q in (got, aggregate.numeric_summary(df, ["g"], "v")):
        assert "percentile" not in q._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("low, high", [(1.0, 99.0), (0.0, 100.0), (33.0, 50.0)])
def test_limits_by_ranks(spark, low, high, monkeypatch):
    df = spark.createDataFrame([(x - 20.0,) for g, x in rows() if g == "even"], "v double").repartition(3)
    a, b = df.agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100)))).first()[0]
    monkeypatch.setattr(F, "percentile", None)
    r = aggregate.capped_limits(df, "v", low, high).first()
    assert (r.lower, r.upper) == pytest.approx((a - (b - a) * 0.06, b + (b - a) * 0.06)) and r.total_count == 400
