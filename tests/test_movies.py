"""Movies are apart: an operator gives a movie the same rows whether another one is there or not."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import anomaly, clean, edits, intensity, lineage, pixels, statistics, trajectory, triage
from trackloom.plans import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tracks(spark):
    """Movie 0, and as movie 1 the same ids at other places, with other fates and later."""
    one = fixtures.tracks(spark, SF).drop("event_id", "event_type")
    two = one.withColumns({"movie_id": F.lit(1).cast("long"), "frame": F.col("frame") * 2 + 3, "pos_x": F.col("pos_y") * 3, "area_px": F.col("area_px") * 5, "outcome": F.lit("Exit")})
    return one, one.unionByName(two)


def swaps(df):
    return df.where("track_id = 2").select("movie_id", F.lit(2).cast("long").alias("a"), F.lit(3).cast("long").alias("b"), F.lit(100).cast("long").alias("frame")).distinct()


def no_mask(df):
    return df.select("movie_id", "frame", F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x"), F.col("track_id").alias("label"))


TRACKS = {
    "roots": lineage.roots,
    "labels": lineage.labels,
    "violations": lineage.violations,
    "flags": anomaly.track_flags,
    "lives": lambda t: anomaly.division_life_outliers(t, anomaly.Thresholds(mitosis_life_mad_k=1.0)),
    "swaps": anomaly.identity_swaps,
    "balance": anomaly.mass_balance,
    "relinks": anomaly.relink_suggestions,
    "lifetimes": lambda t: anomaly.histogram(lineage.spans(t), "last_frame", 30),
    "scores": triage.scores,
    "calibration": lambda t: triage.calibration(triage.scores(t), t.where("track_id % 9 = 0")),
    "summary": trajectory.track_summary,
    "motility": trajectory.motility,
    "aggregated": lambda t: statistics.aggregated(t, "fase", "area_px", "sum", "outcome"),
    "compared": lambda t: statistics.compared(t, trajectory.track_summary(t), ["mean_speed"], F.col("track_id") < 9),
    "sample": lambda t: triage.validation_sample(t.select("movie_id", "track_id").distinct(), 3),
    "thresholds": clean.adaptive_thresholds,
    "outcomes": lambda t: statistics.outcomes(trajectory.track_summary(t)),
    "growth": statistics.growth,
    "exchanged": lambda t: edits.swap_from(t, no_mask(t), swaps(t))[0],
    "ghosts": lambda t: edits.cut_ghosts(t, no_mask(t))[0],
    "relabelled": lambda t: edits.relabel(t, no_mask(t), t.where("track_id < 5"))[0],
    "filled": edits.fill_gaps,
}


def rows(df):
    """Rows of movie 0, numbers to nine digits."""
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.where("movie_id = 0").collect())


@pytest.mark.parametrize("name", sorted(TRACKS))
def test_another_movie_changes_no_row(tracks, name):
    alone, both = tracks
    assert rows(TRACKS[name](alone)) == rows(TRACKS[name](both))


def test_another_movie_changes_no_pixel(spark):
    mask, channel, frames = (f(spark, SF) for f in (fixtures.mask_pixels, fixtures.channel_pixels, fixtures.frames))
    first = lambda t: t.where("movie_id = 0")
    for work in (
        lambda m, c, f: pixels.morphometry(m),
        lambda m, c, f: intensity.compartment_stats(c, m, intensity.background(c, m, f)),
        lambda m, c, f: intensity.haralick(intensity.quantised(c, m, intensity.background(c, m, f))),
        lambda m, c, f: pixels.split_blobs(m),
        lambda m, c, f: intensity.ring_sweep(c, m, intensity.background(c, m, f)),
    ):
        assert rows(work(first(mask), first(channel), first(frames))) == rows(work(mask, channel, frames))
