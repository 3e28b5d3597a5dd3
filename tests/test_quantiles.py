"""Refined quantiles equal ``percentile`` to the last bit."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import quantiles
from trackloom.plans import fixtures

SHARES = [0.0, 0.01, 0.25, 0.5, 0.995, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(2)
    rows = [(0, "a", rng.gauss(0, 1)) for _ in range(3000)] + [(0, "b", float(rng.randint(0, 9))) for _ in range(2000)]
    rows += [(1, "a", 7.5)] * 900 + [(1, "b", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 307)) for _ in range(1500)]
    rows += [(2, "a", 1.0), (2, "a", None), (2, "b", None), (3, "a", 2.0), (3, "a", 5.0), (3, "a", float("nan")), (3, "a", -0.0), (3, "a", 0.0)]
    return spark.createDataFrame(rows, "movie_id long, channel string, level double").repartition(5)


@pytest.mark.parametrize(("direct", "finish"), [(10**6, 1000), (0, 40)])
def test_refined_quantiles(values, direct, finish):
    by = ["movie_id", "channel"]
    found = {(r.movie_id, r.channel): (r.n, list(r.p)) for r in quantiles.quantiles(values, by, "level", SHARES, direct, finish).collect()}
    want = values.where("level IS NOT NULL AND NOT isnan(level)").groupBy(*by).agg(F.count("*").alias("n"), F.percentile("level", F.array(*map(F.lit, SHARES))).alias("p"))
    assert found == {(r.movie_id, r.channel): (r.n, list(r.p)) for r in want.collect()}
    assert quantiles.quantiles(values.limit(0), by, "level", SHARES, direct).count() == 0


def test_refined_medians_of_pixels(spark):
    pixels = fixtures.channel_pixels(spark, "/root/testdata/sf0.001")
    by = ["movie_id", "channel"]
    found = {tuple(r) for r in quantiles.medians(pixels, by, "value", "m", direct=0).collect()}
    assert found == {tuple(r) for r in pixels.groupBy(*by).agg(F.median("value").alias("m")).collect()}
