"""Steps that must not grow faster than the rows, against brute force."""

import math
import random

from pyspark.sql import functions as F

from trackloom.operators import anomaly, intensity, pixels


def test_nearest_in_crowded_frames(spark):
    rng = random.Random(3)
    rows = [(m, i, f, rng.randint(0, 60) / 2, rng.randint(0, 40) / 2) for m in (0, 1) for f in (0, 1) for i in range(1, 301)]
    rows += [(0, i, 2, 5.0, 5.0) for i in range(1, 40)] + [(0, i, 3, 100.0 * i, -7.0) for i in range(1, 5)] + [(0, 1, 3, 130.0, -7.0), (0, 9, 4, 0.0, 0.0), (0, 8, 4, 40.0, 0.0)]
    table = spark.createDataFrame(rows, "movie_id long, track_id long, frame long, x double, y double")
    got = {tuple(r[c] for c in ("movie_id", "track_id", "frame", "x", "y")): (r["distance"], r["other"]) for r in anomaly._nearest(table, table, 40.0).collect()}
    want = {}
    for m, i, f, x, y in rows:
        near = [(math.hypot(x - u, y - v), j) for n, j, g, u, v in rows if (n, g) == (m, f) and j != i and math.hypot(x - u, y - v) <= 40]
        if near:
            want[m, i, f, x, y] = min(near)
    assert got == want
    assert len(want) > 1200
    assert anomaly._nearest(table.limit(0), table.limit(0), 40.0).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_not_broadcast(spark, monkeypatch):
    """The driver never holds a table of pixels, however small the files of a stored one are."""
    rows = [(0, f, y, x, 1 + x // 4) for f in range(3) for y in range(8) for x in range(16) if x % 4 != 3]
    mask = spark.createDataFrame(rows, "movie_id long, frame long, y long, x long, label long")
    plans, keep = [], pixels.stored
    monkeypatch.setattr(pixels, "stored", lambda df, name: plans.append(_plan(df)) or keep(df, name))
    assert pixels.components(mask).select("label", "part").distinct().count() == 4
    levelled = mask.withColumns({"channel": F.lit("a"), "q": (F.col("x") % 5).cast("int")})
    plans.append(_plan(intensity.haralick(levelled)))
    assert len(plans) > 2
    assert not [p for p in plans if "Broadcast" in p]
