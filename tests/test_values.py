"""Small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import timeaxis
from trackloom.operators import anomaly, clean, edits, intensity, lineage, pixels, trajectory
from trackloom.sources import tables

TRACK = "movie_id long, track_id long, frame long, pos_x double, pos_y double, outcome string, parent_id long, area_px double, fase string"


def tracks(spark, rows):
    """Rows of (track, frame, x, parent, outcome)."""
    return spark.createDataFrame([(0, t, f, float(x), 1.0, o, p, 10.0, "control") for t, f, x, p, o in rows], TRACK)


def square(spark, rows):
    return spark.createDataFrame(rows, "movie_id long, frame long, y long, x long, label long")


def block(label, y, x, n, frame=0):
    return [(0, frame, y + i, x + j, label) for i in range(n) for j in range(n)]


def test_false_division_is_dissolved(spark):
    df = tracks(spark, [(10, 0, 0, -1, "Mitosis"), (11, 1, 0, 10, ""), (12, 1, 0, 10, "")])
    out, _ = edits.merge(df, square(spark, block(11, 0, 0, 2, 1)), spark.createDataFrame([(0, 11, 10)], "movie_id long, a long, b long"))
    assert {(r.track_id, r.parent_id, r.outcome) for r in out.collect()} == {(10, -1, ""), (12, -1, "")}


def test_merged_rows_take_the_parent_of_the_track_that_they_join(spark):
    df = tracks(spark, [(1, 0, 0, -1, "Mitosis"), (2, 1, 0, 1, ""), (3, 1, 0, 1, ""), (8, 0, 0, -1, "Mitosis"), (9, 2, 0, 8, ""), (4, 6, 0, 9, "")])
    out, _ = edits.merge(df, square(spark, block(9, 0, 0, 2, 2)), spark.createDataFrame([(0, 9, 2)], "movie_id long, a long, b long"))
    assert {(r.track_id, r.frame, r.parent_id) for r in out.where("track_id IN (2, 4)").collect()} == {(2, 1, 1), (2, 2, 1), (4, 6, 2)}


def test_forced_links_still_refuse_the_impossible(spark):
    df = tracks(spark, [(1, 0, 0, -1, ""), (2, 1, 0, 1, ""), (3, 2, 0, 1, ""), (4, 3, 0, -1, ""), (5, 0, 0, -1, "")])
    asked = spark.createDataFrame([(0, 1, 4), (0, 77, 2), (0, 4, 5), (0, 3, 3)], "movie_id long, mother long, daughter long")
    assert {r.track_id: r.parent_id for r in edits.link(df, asked, force=True).collect()} == {1: -1, 2: 1, 3: -1, 4: 1, 5: -1}
    again = spark.createDataFrame([(0, 1, 3)], "movie_id long, mother long, daughter long")
    assert {r.track_id: r.parent_id for r in edits.link(df, again, force=True).collect()} == {1: -1, 2: 1, 3: 1, 4: -1, 5: -1}


def test_a_local_swap_clears_and_dissolves(spark):
    df = tracks(spark, [*((t, f, 0, -1, "Mitosis" if t == 1 else "") for t in (1, 2) for f in range(1, 5)), (3, 3, 0, 1, "")])
    out, _ = edits.swap_from(df, square(spark, block(1, 0, 0, 2)), spark.createDataFrame([(0, 1, 2, 2)], "movie_id long, a long, b long, frame long"), True)
    got = {(r.track_id, r.frame): (r.parent_id, r.outcome) for r in out.collect()}
    assert got[(2, 2)] == got[(1, 2)] == (-1, "") and got[(1, 1)] == (-1, "Mitosis") and got[(3, 3)] == (1, "")


def test_a_cut_goes_on_as_a_new_track(spark):
    df = tracks(spark, [(1, f, 0, -1, "") for f in range(4)])
    out, mask = edits.swap_from(df, square(spark, block(1, 0, 0, 2, 3) + block(2, 5, 5, 2, 3)), spark.createDataFrame([(0, 1, 0, 2)], "movie_id long, a long, b long, frame long"))
    assert {(r.track_id, r.frame) for r in out.collect()} == {(1, 0), (1, 1), (3, 2), (3, 3)}  # 2 is the label of a pixel
    assert {r.label for r in mask.collect()} == {2, 3}


def test_small_areas_are_no_outliers(spark):
    areas = [(0, 0, i, a, 0.5) for i, a in enumerate([100.0, 101.0, 99.0, 102.0, 98.0, 20.0, 300.0])]
    found = anomaly.area_outliers(spark.createDataFrame(areas, "movie_id long, frame long, label long, area double, eccentricity double"))
    assert [(r.label, r.reason) for r in found.collect()] == [(6, "area outlier")]


def test_axes_of_a_square(spark):
    row = pixels.morphometry(square(spark, block(1, 3, 4, 10))).first()
    assert (row.major, row.minor) == pytest.approx((4 * (99 / 12) ** 0.5,) * 2)
    assert row.eccentricity == pytest.approx(0.0, abs=1e-6) and row.aspect == pytest.approx(1.0)


def test_swap_takes_only_later_daughters(spark):
    df = tracks(spark, [*((t, f, 0, -1, "") for t in (1, 2) for f in range(10)), (3, 6, 0, 1, ""), (4, 1, 0, 1, "")])
    swaps = spark.createDataFrame([(0, 1, 2, 3)], "movie_id long, a long, b long, frame long")
    out, _ = edits.swap_from(df, square(spark, block(1, 0, 0, 2)), swaps)
    assert {r.track_id: r.parent_id for r in out.where("track_id IN (3, 4)").collect()} == {3: 2, 4: 1}


def test_hierarchical_labels(spark):
    df = tracks(spark, [(5, 0, 0, -1, "Mitosis"), (8, 2, 0, 5, "Mitosis"), (9, 3, 0, 5, ""), (20, 5, 0, 8, ""), (30, 4, 0, -1, "Mitosis"), (31, 6, 0, 30, "")])
    assert {r.track_id: r.label for r in lineage.labels(df).collect()} == {5: "1", 8: "1.1", 9: "1.2", 20: "1.1.1", 30: "2", 31: "2.1"}


def test_labels_reach_every_depth(spark):
    df = tracks(spark, [(t, t, 0, t - 1 if t > 1 else -1, "Mitosis") for t in range(1, 69)])
    assert {r.track_id: r.generation for r in lineage.labels(df).collect()} == {t: t - 1 for t in range(1, 69)}


def test_root_of_a_parent_known_at_birth_only(spark):
    df = tracks(spark, [(1, 0, 0, -1, ""), (11, 1, 0, 1, ""), (11, 2, 0, -1, ""), (11, 3, 0, -1, "")])
    assert {r.track_id: r.root_id for r in lineage.roots(df).collect()} == {1: 1, 11: 1}


def test_a_cycle_has_its_smallest_id_as_root(spark):
    df = tracks(spark, [(7, 0, 0, 9, ""), (8, 0, 0, 7, ""), (9, 0, 0, 8, ""), (4, 0, 0, 9, "")])
    assert {r.root_id for r in lineage.roots(df).collect() if r.track_id in (7, 8, 9)} == {7}


def test_minted_ids_fill_the_gaps(spark):
    df = tracks(spark, [(1, 0, 0, -1, ""), (2, 0, 0, -1, ""), (5, 0, 0, -1, "")])
    wanted = spark.createDataFrame([(0, i) for i in range(1, 21)], "movie_id long, ord long")
    assert sorted(r.new_id for r in edits.minted_ids(df, wanted).collect()) == [3, 4, *range(6, 24)]


def clock(spark, names):
    return spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "movie_id long, frame long, filename string")


def test_clock_from_names(spark):
    rows = timeaxis.time_table(clock(spark, ["VID_00d00h00m.tif", "VID_00d00h30m.tif", "VID_00d03h00m.tif", "VID_00d03h30m.tif"])).orderBy("frame").collect()
    assert [r.gap for r in rows] == [False, False, True, False] and rows[2].dt_h == 2.5 and rows[3].tempo_h == 3.5
    for names in (["VID_00d00h00m.tif", "x.tif"], ["a_2h.tif", "a_1h.tif"]):
        assert {r.hours for r in timeaxis.parsed_times(clock(spark, names)).collect()} == {None}


def test_speed_across_a_gap(spark):
    df = tracks(spark, [(1, i, 10 + 10 * i, -1, "") for i in range(4)])
    times = spark.createDataFrame([(0, 0, 0.0, 0.5), (0, 1, 0.5, 0.5), (0, 2, 3.0, 0.5), (0, 3, 3.5, 0.5)], "movie_id long, frame long, tempo_h double, modal_h double")
    steps = trajectory.step_features(df)
    assert [r.speed for r in trajectory.speed(steps).orderBy("frame").collect()][2] == 20.0
    timed = trajectory.speed(steps, times=times).orderBy("frame").collect()
    assert timed[2].speed == 4.0 and [r.gap_antes for r in timed] == [False, False, True, False]


def test_lifetime_lies_on_the_middle_row(spark):
    df = tracks(spark, [*((1, f, 0, -1, "") for f in range(5)), *((2, f, 0, -1, "") for f in range(3))])
    rows = trajectory.middle_lifetime(df, 2.0).where("lifetime_h IS NOT NULL").collect()
    assert {(r.track_id, r.frame): r.lifetime_h for r in rows} == {(1, 2): 10.0, (2, 1): 6.0}


def test_ring_avoids_nuclei(spark):
    mask = square(spark, [*block(1, 2, 2, 5), *block(2, 2, 9, 5)])
    assert pixels.areas(mask).where("area = 25").count() == 2
    assert pixels.rings(mask).join(mask.select("frame", "y", "x"), ["frame", "y", "x"]).count() == 0


def test_perimeter_and_solidity_of_a_square(spark):
    mask = square(spark, block(1, 0, 0, 10))
    assert pixels.perimeters(mask).first().perimeter == pytest.approx(36.0)
    assert pixels.solidity(mask).first().solidity == 1.0


def test_background_and_ratio(spark):
    frames = spark.createDataFrame([(0, 0, 20, 20)], "movie_id long, frame long, height long, width long")
    mask = square(spark, block(1, 7, 7, 6))
    values = [(0, "c", 0, y, x, 60.0 if 7 <= y < 13 and 7 <= x < 13 else 10.0) for y in range(20) for x in range(20)]
    channel = spark.createDataFrame(values, "movie_id long, channel string, frame long, y long, x long, value double")
    bg = intensity.background(channel, mask, frames)
    assert bg.first().bg == 10.0
    row = intensity.compartment_stats(channel, mask, bg).first()
    assert row.nuc_px == 36 and row.cell_px == 36 + row.ring_px and row.nuc_median == 50.0 and row.cn is None


def test_drift(spark):
    mask = square(spark, [*block(1, 0, 0, 2, 0), *block(1, 0, 0, 2, 1), *block(1, 0, 0, 2, 2)])
    channel = mask.select("movie_id", F.lit("c").alias("channel"), "frame", "y", "x", (100.0 / F.pow(F.lit(2.0), F.col("frame"))).alias("value"))
    assert [r.drift for r in intensity.signal_drift(channel, mask).orderBy("frame").collect()] == [1.0, 0.5, 0.25]


def test_foreign_labels(spark):
    df = spark.createDataFrame([(" Mitose ",), ("início",), ("morte",), ("custom",), (None,)], "o string")
    assert [r[0] for r in df.select(clean.translated_outcome(F.col("o"))).collect()] == ["Mitosis", "", "Death/Senescence", "custom", ""]
    assert tables.guessed_columns(["TRACKID", "Frame", "X", "centroid-0"]) == {"track_id": "TRACKID", "frame": "Frame", "pos_x": "X", "pos_y": "centroid-0"}


def test_frames_by_name(spark):
    ref, cand = clock(spark, ["r/a.tif", "r/b.tif"]), clock(spark, ["1/a.tif", "2/a.tif"])
    assert [r.match for r in tables.matched_frames(ref, cand).orderBy("frame").collect()] == ["1/a.tif", None]


def test_harmonised_splits_blobs_and_names_pixels_by_track(spark):
    df = tracks(spark, [(1, 0, 0, -1, "Mitosis"), (9, 0, 5, -1, "")]).withColumn("continuous_label", F.when(F.col("track_id") == 9, 2).otherwise(1).cast("long"))
    rows, mask = edits.harmonised(df, square(spark, block(1, 0, 0, 3) + block(1, 0, 6, 2) + block(2, 6, 6, 2)), F.lit("treated"))
    got = {r.track_id: (r.outcome, r.pos_x, r.fase, r.continuous_label) for r in rows.collect()}
    assert got == {1: ("Mitosis", 0.0, "control", 1), 9: ("", 5.0, "control", 9), 3: ("Unknown", None, "treated", 3)}
    assert {r.label: r["count"] for r in mask.groupBy("label").count().collect()} == {1: 9, 3: 4, 9: 4}


def test_a_line_has_the_ring_of_its_contour(spark):
    line = square(spark, [(0, 0, 5, x, 1) for x in range(4)])
    assert {(r.y, r.x) for r in pixels.ellipse_rings(line).collect()} == {(r.y, r.x) for r in pixels.rings(line).collect()}


def test_problems_of_a_measurement_source(spark):
    plane = [(f, y, x, float((x * x * 7 + y * y * 3 + x * y) % 23)) for f in range(2) for y in range(20) for x in range(24)]
    kind = "movie_id long, channel string, frame long, y long, x long, value double"
    reference = spark.createDataFrame([(0, "ref", *p) for p in plane], kind)
    moved = [(0, "moved", f, y, (x + 4) % 24, v) for f, y, x, v in plane]
    channel = spark.createDataFrame([(0, "good", *p) for p in plane] + moved + [(0, "short", *p) for p in plane if p[0] == 0], kind)
    frames = spark.createDataFrame([(0, f, 20, 24) for f in range(2)], "movie_id long, frame long, height long, width long")
    assert {(r.channel, r.problem) for r in intensity.source_problems(channel, reference, frames).collect()} == {("moved", "misaligned"), ("short", "number of frames")}


@pytest.mark.parametrize("height, width, dy, dx", [(64, 96, 20, -31), (64, 96, 0, 0), (33, 47, -12, 5)])
def test_phase_shift_finds_long_shifts(height, width, dy, dx):
    image = np.random.default_rng(3).random((height, width))
    assert intensity.phase_shift(image, np.roll(image, (dy, dx), (0, 1))) == pytest.approx((dy, dx), abs=0.05)
    assert intensity.phase_shift(np.ones((8, 8)), np.ones((8, 8))) == (0.0, 0.0)


def test_shifted_square_is_misaligned(spark):
    square = [(0, "a", f, y, x, 200.0 if 4 <= y < 9 and 4 <= x < 9 else 10.0) for f in range(4) for y in range(16) for x in range(16)]
    columns = "movie_id long, channel string, frame long, y long, x long, value double"
    reference = spark.createDataFrame(square, columns)
    moved = spark.createDataFrame([(*r[:4], (r[4] + 4) % 16, r[5]) for r in square], columns)
    frames = spark.createDataFrame([(0, f, 16, 16) for f in range(4)], "movie_id long, frame long, height long, width long")
    assert [r.problem for r in intensity.source_problems(moved, reference, frames).collect()] == ["misaligned"]
    assert intensity.source_problems(reference, reference, frames).count() == 0
    assert intensity.alignment(moved.limit(0), reference).count() == 0
