"""Published versions, readers by header, paths, labels, rings, order of files: branches that the tables of the queries do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import timeaxis
from trackloom.operators import anomaly, lineage, pixels, statistics, trajectory, triage
from trackloom.plans import fixtures, q_statistics
from trackloom.sources import published, tables

TRACK = "movie_id long, track_id long, frame long, pos_x double, pos_y double, outcome string, parent_id long, fase string"


def test_a_failed_version_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "out")
    assert published.versions(spark, path).count() == 0
    with pytest.raises(ValueError):
        published.table(spark, path, "summary")
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    published.publish({"summary": one, "features": one}, path, "v1", {"pixel_size": 0.5, "channels": ["gfp"]})
    broken = two.withColumn("x", F.raise_error(F.lit("half-way")).cast("long"))
    with pytest.raises(Exception, match="half-way"):
        published.publish({"summary": two, "windows": broken}, path, "v2")
    assert published.table(spark, path, "summary").count() == 3
    assert [r.version for r in published.versions(spark, path).collect()] == ["v1"]
    published.publish({"summary": two}, path, "v2")  # the attempt is repeated
    assert published.table(spark, path, "summary").count() == 5 and published.table(spark, path, "summary", "v1").count() == 3
    assert published.table(spark, path, "features").count() == 3  # only the first version has it
    found = published.versions(spark, path).collect()
    assert [r.ordinal for r in found] == [1, 2] and found[0].provenance == {"pixel_size": "0.5", "channels": "['gfp']"}
    with pytest.raises(ValueError, match="already"):
        published.publish({"summary": one}, path, "v1")
    for name in ("a/b", "", "..", "_x"):
        with pytest.raises(ValueError, match="name"):
            published.publish({name: one}, path, "v3")


def test_published_tables_do_not_compute_the_tracks_again(spark, monkeypatch):
    seen, publish = [], published.publish
    monkeypatch.setattr(published, "publish", lambda made, path, version, *more: (seen.append((made, path, version)), publish(made, path, version, *more)))
    q_statistics._published(spark, "/root/testdata/sf0.001")
    assert [v for _, _, v in seen] == ["v1", "v2"]
    assert not [f for made, _, _ in seen for df in made.values() for f in df.inputFiles() if "events.parquet" in f]  # before, each of 16 tables read the events
    raw = fixtures.tracks(spark, "/root/testdata/sf0.001")
    whole = {"features": raw.select(*published.TRACK, "frame", F.col("area_px").alias("gfp_mean")), "windows": statistics.growth(raw).withColumn("track_id", F.col("n")), "summary": trajectory.track_summary(raw)}
    for (made, path, version), k in zip(seen, (2, 3)):
        keys = raw.where(F.col("track_id") % k == 0).select(*published.TRACK).distinct()
        want = whole | {f"{n}_validated": df.join(keys, published.TRACK, "left_semi") for n, df in whole.items()} | {"validated_cells": raw.where(F.col("track_id") % k == 0), "fluorescence_gfp": whole["features"]}
        assert set(made) == set(want)
        for name, df in want.items():
            got = published.table(spark, path, name, version)
            assert sorted(map(repr, got.select(*df.columns).collect())) == sorted(map(repr, df.collect())), (version, name)


def test_the_audit_is_appended(spark, tmp_path):
    path = str(tmp_path / "audit")
    for ids in ([1, 2], [3]):
        tables.append_audit(spark, spark.createDataFrame([("bulk_accept", i) for i in ids], "action string, track_id long"), path)
    assert {r.track_id for r in spark.read.parquet(path).collect()} == {1, 2, 3}


def test_formats_by_header(spark, tmp_path):
    assert [tables.detected_format(n) for n in (["SPOT_ID", "Track_ID"], ["POSITION_X", "POSITION_T"], ["L", "B", "E", "P"], ["Label", "begin", "END", "parent"], ["track", "frame"])] == ["spots", "spots", "tracks", "tracks", "generic"]

    def written(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    key = lambda df: sorted((r.track_id, r.frame, r.pos_x) for r in df.collect())
    spots = written("spots.csv", "SPOT_ID,TRACK_ID,FRAME,POSITION_X,POSITION_Y\nSpot ID,Track ID,Frame,X,Y\n1,7,0,1.5,2\n2,7,1.0,?,2\n")
    assert key(tables.opened(spark, spots).fillna(-9.0)) == [(7, 0, 1.5), (7, 1, -9.0)]
    assert key(tables.opened(spark, written("list.csv", "P,L,B,E\n0,3,4,5\n3,4,6,6\n"))) == [(3, 4, -1.0), (3, 5, -1.0), (4, 6, -1.0)]
    assert key(tables.opened(spark, written("list.txt", "3 4 5 0\n4 6 6 3\n"))) == [(3, 4, -1.0), (3, 5, -1.0), (4, 6, -1.0)]
    assert key(tables.opened(spark, written("plain.csv", "Track,T,X,Y\n5,2,1,1\n"))) == [(5, 2, 1.0)]
    assert key(tables.opened(spark, written("given.csv", "SPOT_ID,TRACK_ID,when,X\n5,2,1,1\n"), {"frame": "when", "track_id": "SPOT_ID"})) == [(5, 1, 1.0)]


def test_a_saved_table_is_read_with_types(spark, tmp_path):
    (tmp_path / "saved.csv").write_text("track_id,frame,pos_x,note,at_border\n1.0,0,2.5,a,True\n,1,x,b,False\n")
    df = tables.reopened(spark, str(tmp_path / "saved.csv"))
    assert dict(df.dtypes) == {"track_id": "bigint", "frame": "bigint", "pos_x": "double", "note": "string", "at_border": "boolean", "bad_record": "string", "outcome": "string", "parent_id": "bigint"}
    assert [tuple(r) for r in df.orderBy("frame").collect()] == [(1, 0, 2.5, "a", True, None, "", -1), (None, 1, None, "b", False, ",1,x,b,False", "", -1)]


def tracks(spark, rows):
    """Rows of (movie, track, frame, x, parent, outcome, phase)."""
    return spark.createDataFrame([(m, t, f, float(x), 2.0 * x, o, p, c) for m, t, f, x, p, o, c in rows], TRACK)


def test_paths_between_and_beyond_rows(spark):
    df = tracks(spark, [(0, 1, 10, 0, -1, "", ""), (0, 1, 14, 8, -1, "", ""), (0, 2, 3, 5, -1, "", "")])
    asked = spark.createDataFrame([(0, 1, 2), (0, 1, 10), (0, 1, 11), (0, 1, 11), (0, 1, 14), (0, 1, 90), (0, 2, 1), (0, 2, 9), (0, 3, 1), (1, 1, 10)], "movie_id long, track_id long, frame long")
    got = sorted((r.track_id, r.frame, r.pos_x, r.pos_y) for r in anomaly.predicted_paths(df, asked).collect())
    assert got == [(1, 2, 0.0, 0.0), (1, 10, 0.0, 0.0), (1, 11, 2.0, 4.0), (1, 14, 8.0, 16.0), (1, 90, 8.0, 16.0), (2, 1, 5.0, 10.0), (2, 9, 5.0, 10.0)]


def test_labels_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    chain = [(0, t, t, 0, t - 1 if t > 1 else -1, "Mitosis", "") for t in range(1, 201)] + [(0, 500, 9, 0, 4, "", "")]
    cycle = [(0, 301, 1, 0, 302, "Mitosis", ""), (0, 302, 2, 0, 301, "Mitosis", ""), (0, 303, 3, 0, 302, "", "")]
    rounds = []
    stored = lineage.stored
    monkeypatch.setattr(lineage, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    got = {r.track_id: (r.label, r.generation) for r in lineage.labels(tracks(spark, chain + cycle)).collect()}
    assert rounds.count("ways") <= 10  # the first table and nine rounds
    assert got[1] == ("1", 0) and got[5] == ("1.1.1.1.1", 4) and got[500] == ("1.1.1.1.2", 4)
    assert got[200] == ("1" + ".1" * 199, 199)
    assert 302 not in got and 303 not in got


def test_single_families_where_nothing_else_is_there(spark):
    df = tracks(spark, [(0, 1, 0, 0, -1, "Exit", ""), (0, 2, 0, 0, -1, "Exit", ""), (1, 1, 0, 0, -1, "Mitosis", ""), (1, 2, 1, 0, 1, "", ""), (1, 3, 1, 0, -1, "Exit", "")])
    assert sorted((r.movie_id, r.root_id, r.size) for r in lineage.ranked_families(df).collect()) == [(0, 1, 1), (0, 2, 1), (1, 1, 2)]


def test_rings_keep_clear_of_the_other_nucleus(spark):
    """Two touching squares and a far one, against a plain count of distances."""
    squares = {1: (10, 10), 2: (10, 13), 3: (10, 20)}
    mask = [(0, 0, y + i, x + j, k) for k, (y, x) in squares.items() for i in range(3) for j in range(3)]
    df = spark.createDataFrame(mask, "movie_id long, frame long, y long, x long, label long")
    at = {(y, x): k for _, _, y, x, k in mask}
    far = lambda y, x, keep: min((abs(y - a) + abs(x - b) for (a, b), k in at.items() if keep(k)), default=99)
    for clear in (0, 1, 3):
        want = {(k, y, x) for k in squares for y in range(0, 30) for x in range(0, 40) if (y, x) not in at and 1 < far(y, x, lambda o: o == k) <= 4 and (clear == 0 or far(y, x, lambda o: o != k) > clear)}
        assert {(r.label, r.y, r.x) for r in pixels.rings(df, 1, 3, clear).collect()} == want
    assert {(r.nearest, r.second) for r in pixels.nearest_two(df, 4).where("y = 11 AND x = 17").collect()} == {(2, 3)}


def test_natural_order_of_files(spark):
    names = ["b/img1.tif", "a/img10.tif", "a/img2.tif", "a/img002.tif", "a/img.tif", "a/img2b.tif"]
    files = spark.createDataFrame([(0, n) for n in names] + [(1, "x9"), (1, "x" + "9" * 30), (1, "x10")], "movie_id long, filename string")
    got = timeaxis.numbered_files(files).orderBy("movie_id", "frame").collect()
    assert [r.filename for r in got if r.movie_id == 0] == ["a/img.tif", "a/img002.tif", "a/img2.tif", "a/img2b.tif", "a/img10.tif", "b/img1.tif"]
    assert [r.filename for r in got if r.movie_id == 1] == ["x9", "x10", "x" + "9" * 30]


def test_samples_by_movie(spark):
    accepted = spark.createDataFrame([(m, t) for m in (0, 1) for t in range(9)], "movie_id long, track_id long")
    got = triage.validation_sample(accepted, 2).collect()
    assert sorted(r.movie_id for r in got) == [0, 0, 1, 1]


def test_compared_tracks_have_the_phase_of_their_first_row(spark):
    rows = [(0, t, f, t, -1, "", "control" if f == 0 else "treated") for t in range(1, 5) for f in range(4)] + [(0, 9, 5, 1, -1, "", "treated")]
    summary = spark.createDataFrame([(0, t, float(t), "treated", False) for t in (1, 2, 3, 4, 9)], "movie_id long, track_id long, v double, fase string, is_mitotic boolean")
    got = {r.group: r.n for r in statistics.compared(tracks(spark, rows), summary, ["v"], F.col("track_id") == 1).collect()}
    assert got == {"all": 5, "non-mitotic": 5, "control": 4}


def test_hulls_of_many_objects_at_once(spark):
    """Random objects, lines and dots against a hull that is worked out object by object."""
    rng = random.Random(11)
    objects = [[(3, 4)], [(0, 0), (2, 1)], [(0, 0), (2, 2)], [(5, x) for x in range(4)], [(y, 7) for y in range(9)], [(0, 0), (0, 6), (6, 3)]]
    objects += [sorted({(rng.randint(0, 9), rng.randint(-4, 12)) for _ in range(rng.randint(1, 40))}) for _ in range(150)]
    rows = [(k % 2, k % 3, y, x, k) for k, points in enumerate(objects) for y, x in points]

    def hull(points):
        """Lattice points that no line through two of the points parts from all of them."""
        ys, xs = [p[0] for p in points], [p[1] for p in points]
        side = lambda a, b, q: (b[1] - a[1]) * (q[0] - a[0]) - (b[0] - a[0]) * (q[1] - a[1])
        edges = [(a, b) for a in points for b in points if a != b and all(side(a, b, q) >= 0 for q in points)]
        return sum(all(side(a, b, (y, x)) >= 0 for a, b in edges) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1))

    df = spark.createDataFrame(rows, "movie_id long, frame long, y long, x long, label long").repartition(4)
    got = {r.label: r.solidity for r in pixels.solidity(df).collect()}
    assert got == {k: len(points) / hull(points) for k, points in enumerate(objects)}
    assert pixels.solidity(df.limit(0)).count() == 0
