"""Draws from counts: moments of the binomial, intervals beside those of resampled rows, cost by counts."""

import math

import pytest
from pyspark.sql import functions as F

from gradus.operators import paired

DRAWS = 4000


@pytest.mark.parametrize(("n", "part", "whole"), [(1, 1, 3), (7, 2, 5), (90, 30, 90), (1300, 13, 1300), (50_000, 17_000, 50_000), (10**9, 1, 10**6)])
def test_binomial_has_its_moments(spark, n, part, whole):
    long = lambda x: F.lit(x).cast("bigint")
    x = paired.binomial(long(n), long(part), long(whole), F.concat_ws("|", F.lit("t"), F.col("id").cast("string")))
    df = spark.range(DRAWS, numPartitions=4).select(x.alias("x"))
    r = df.agg(F.avg("x").alias("mean"), F.variance("x").alias("var"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.skewness("x").alias("skew")).first()
    p = part / whole
    mean, var = n * p, n * p * (1 - p)
    assert abs(r["mean"] - mean) < 5 * math.sqrt(var / DRAWS)
    assert abs(r["var"] / var - 1) < 5 * math.sqrt((2 + max(0, (1 - 6 * p * (1 - p)) / var)) / DRAWS)
    assert 0 <= r.lo and r.hi <= n and abs(r.skew - (1 - 2 * p) / math.sqrt(var)) < 0.35
    if n == 7:  # every outcome as often as it should be
        got = {c.x: c["count"] for c in df.groupBy("x").count().collect()}
        for k in range(8):
            want = DRAWS * math.comb(7, k) * p**k * (1 - p) ** (7 - k)
            assert abs(got.get(k, 0) - want) < 5 * math.sqrt(want) + 1


def test_certain_and_impossible_parts(spark):
    long = lambda x: F.lit(x).cast("bigint")
    r = spark.range(1).select(*[paired.binomial(long(5), long(a), long(b), F.lit("t")) for a, b in ((3, 3), (0, 3))], paired.binomial(long(0), long(1), long(3), F.lit("t"))).first()
    assert tuple(r) == (5, 0, 0)


def test_interval_is_that_of_resampled_rows(spark):
    rows = [("d", f"q{i:03}", -1 if i < 20 else 1 if i < 75 else 0) for i in range(200)]
    rows += [("same", f"s{i}", 0) for i in range(5)] + [(None, "n", 1), (None, "m", -1), ("d", "none", None)]
    df = spark.createDataFrame(rows, "g string, id string, d int")
    got = {r.g: r for r in paired.bootstrap_counts(df, "g", "d", 2000).collect()}
    exact = {r.g: r for r in paired.bootstrap_ci_exact(df.where("d is not null and g = 'd'"), "g", "d", "id", 2000).collect()}
    assert got["d"].n == 200 and abs(got["d"].ci_low - exact["d"].ci_low) <= 1.5 and abs(got["d"].ci_high - exact["d"].ci_high) <= 1.5
    assert (got["same"].ci_low, got["same"].ci_high) == (0.0, 0.0) and (got[None].ci_low, got[None].ci_high) == (-100.0, 100.0)
    assert paired.bootstrap_counts(df.limit(0), "g", "d").collect() == []


def test_rows_are_counted_and_not_multiplied(spark):
    """Half a million rows make as many draws as few rows: replicates times groups."""
    df = spark.range(500_000).select((F.col("id") % 2).alias("g"), ((F.col("id") % 7 == 0).cast("int") - (F.col("id") % 11 == 0).cast("int")).alias("d"))
    got = {r.g: r for r in paired.bootstrap_counts(df, "g", "d", 300).collect()}
    for r in got.values():
        sd = 100 * math.sqrt((1 / 7 + 1 / 11 - 2 / 77 - (1 / 7 - 1 / 11) ** 2) / r.n)
        assert abs(r.mean_estimate - 100 * (1 / 7 - 1 / 11)) < 0.5 * sd + 0.01 and 3.2 * sd < r.ci_high - r.ci_low < 4.6 * sd
