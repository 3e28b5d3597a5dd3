"""Queries and oracles of statistics, time axis and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import timeaxis as ta
from ..operators import statistics as st
from ..operators import trajectory as tr
from ..sources import published as pb
from ..sources import tables as tb
from ..sources.work import shared_dir, stored
from . import fixtures as fx
from .fixtures import duck
from .q_trajectory import _MOTILITY, _STEP, _SUMMARY, rounded

_BOX = ["q1", "median", "q3"]
_FATE = """
, fo AS (
  SELECT movie_id, track_id, coalesce(arg_min(outcome, frame) FILTER (outcome NOT IN ('', 'nan', 'None')), 'none') AS fate
  FROM tracks GROUP BY movie_id, track_id)"""
_QB = "count(*) AS n, round(quantile_cont({v}, 0.25), 6) AS q1, round(median({v}), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q3"
_NAME = "concat('dir/', lpad(cast(frame as string), 5, '0'), '_', cast(floor(frame / 48) as string), 'd', cast(floor((frame % 48) / 2) as string), 'h', cast((frame % 2) * 30 as string), 'm.tif')"


def _summary(s, d):
    return tr.track_summary(fx.tracks(s, d))


def _files(s, d):
    t = fx.tracks(s, d).select("movie_id", "frame").distinct().where("frame < 90 OR frame > 100")
    return t.withColumn("filename", F.expr(_NAME))


_FILES = ", fl AS (SELECT DISTINCT movie_id, frame, frame * 0.5::DOUBLE AS h FROM tracks WHERE frame < 90 OR frame > 100), tt AS (SELECT movie_id, frame, h - min(h) OVER () AS tempo_h, h - lag(h) OVER (ORDER BY frame) AS dt_h FROM fl), md AS (SELECT dt_h AS modal_h FROM tt WHERE dt_h IS NOT NULL GROUP BY dt_h ORDER BY count(*) DESC, dt_h LIMIT 1)"


def _foreign(s, d):
    return fx.tracks(s, d).select(F.col("track_id").cast("string").alias("TrackID"), F.when(F.col("event_id") % 10 == 0, F.lit("x")).otherwise(F.col("frame").cast("string")).alias("FRAME"), F.col("pos_x").cast("string").alias("POSITION_X"), F.col("pos_y").cast("string").alias("Y"), F.lit("fim").alias("Fate"), F.col("event_id"))


def _lists(s, d):
    t = fx.tracks(s, d).groupBy("track_id").agg(F.min("frame").alias("b"), F.max("frame").alias("e"), F.max("parent_id").alias("p"))
    return t.select(F.concat_ws(" ", F.col("track_id"), F.when(F.col("track_id") % 10 == 0, F.col("e") + 1).otherwise(F.col("b")), F.col("e"), F.col("p")).alias("value"))


def _names(s, d, k):
    return fx.tracks(s, d).select("frame").distinct().where(F.col("frame") % k == 0).select("frame", F.concat(F.lit(f"{k}/f"), "frame", F.lit(".tif")).alias("filename"))


_MOTION = ["diffusion_coeff", "persistence_time", "mean_turning_angle", "confinement_ratio"]


def _motility(s, d):
    return tr.motility(fx.tracks(s, d))


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _opened(s, d):
    """The tracks written as a spots export with header remnants, and opened by what the header says."""
    path = _folder(s, "spots")
    frame = F.when(F.col("event_id") % 10 == 0, F.lit("Frame")).otherwise(F.col("frame").cast("string"))
    rows = fx.tracks(s, d).select(F.col("event_id").alias("SPOT_ID"), F.col("track_id").alias("TRACK_ID"), frame.alias("FRAME"), F.round("pos_x", 3).alias("POSITION_X"), F.round("pos_y", 3).alias("POSITION_Y"))
    rows.write.option("header", True).csv(path)
    return tb.opened(s, path)


def _reopened(s, d):
    """The tracks saved as CSV, every tenth row with a frame that is no number, every fourth without a parent, and read again."""
    path = _folder(s, "saved")
    frame = F.when(F.col("event_id") % 10 == 0, F.lit("?")).otherwise(F.col("frame").cast("string"))
    parent = F.when(F.col("event_id") % 4 != 0, F.col("parent_id").cast("double"))
    rows = fx.tracks(s, d).select("event_id", "track_id", frame.alias("frame"), F.round("pos_x", 3).alias("pos_x"), parent.alias("parent_id"), "outcome", "at_border")
    rows.write.option("header", True).csv(path)
    return tb.reopened(s, path)


def _published(s, d):
    """Two versions of the derived tables; the latest summary of validated tracks is read."""
    path = _folder(s, "versions")
    tracks = stored(fx.tracks(s, d), "tracks")  # all tables of both versions read them
    summary, windows = stored(tr.track_summary(tracks), "summary"), stored(st.growth(tracks).withColumn("track_id", F.col("n")), "windows")
    features = tracks.select("movie_id", "track_id", "frame", F.col("area_px").alias("gfp_mean"))
    for version, k in (("v1", 2), ("v2", 3)):
        validated = tracks.where(F.col("track_id") % k == 0)
        pb.publish(pb.derived(tracks, features, windows, summary, validated, ["gfp"]), path, version, {"pixel_size": 1.0})
    return pb.table(s, path, "summary_validated").select("movie_id", "track_id", "fase", "final_outcome")


QUERIES = {
    "q1_lifetime_boxes": (lambda s, d: rounded(st.boxes(_summary(s, d), ["lifetime_h"], "movie_id", "fase", "is_mitotic"), *_BOX), duck(_SUMMARY + f" SELECT movie_id, fase, is_mitotic, 'lifetime_h' AS metric, {_QB.format(v='lifetime_h')} FROM summary GROUP BY ALL")),
    "q2_migration_boxes": (
        lambda s, d: rounded(st.boxes(_summary(s, d), ["mean_speed", "net_displacement", "directionality"], "movie_id", "fase"), *_BOX),
        duck(_SUMMARY + ", u AS (UNPIVOT (SELECT movie_id, fase, mean_speed, net_displacement, directionality FROM summary) ON mean_speed, net_displacement, directionality INTO NAME metric VALUE v) SELECT movie_id, fase, metric, " + _QB.format(v="v") + " FROM u GROUP BY ALL"),
    ),
    "q3_motility_boxes": (
        lambda s, d: rounded(st.boxes(rounded(_motility(s, d), *_MOTION).join(_summary(s, d).select("movie_id", "track_id", "fase"), ["movie_id", "track_id"]), _MOTION, "movie_id", "fase"), *_BOX),
        f"WITH mot AS ({duck(_MOTILITY)}), ph AS ({duck(_SUMMARY + ' SELECT movie_id, track_id, fase FROM summary')}), u AS (UNPIVOT (SELECT ph.movie_id, fase, {', '.join(c + '::DOUBLE AS ' + c for c in _MOTION)} FROM mot JOIN ph USING (track_id)) ON {', '.join(_MOTION)} INTO NAME metric VALUE v) SELECT movie_id, fase, metric, {_QB.format(v='v')} FROM u GROUP BY ALL",
    ),
    "q4_area_by_frame": (lambda s, d: rounded(st.area_by_frame(fx.mask_pixels(s, d)), "mean_area"), duck(" SELECT frame, round(avg(n), 6) AS mean_area FROM (SELECT frame, label, count(*) AS n FROM mask_pixels GROUP BY ALL) GROUP BY frame", True)),
    "q4_area_by_phase": (
        lambda s, d: rounded(st.area_by_phase(fx.tracks(s, d), _summary(s, d)), *_BOX),
        duck(_SUMMARY + ", ar AS (SELECT movie_id, track_id, avg(area_px) AS a FROM tracks GROUP BY movie_id, track_id) SELECT movie_id, fase, " + _QB.format(v="a") + " FROM summary JOIN ar USING (movie_id, track_id) GROUP BY ALL"),
    ),
    "f5_middle_lifetime_clock": (
        lambda s, d: rounded(tr.middle_lifetime(fx.tracks(s, d), times=ta.time_table(_files(s, d))).select("event_id", "lifetime_h"), "lifetime_h"),
        duck(_FILES + """,
cl AS (
  SELECT event_id, track_id, tempo_h, row_number() OVER (PARTITION BY t.movie_id, track_id ORDER BY t.frame) - 1 AS i, count(*) OVER (PARTITION BY t.movie_id, track_id) AS n
  FROM tracks t LEFT JOIN tt ON tt.movie_id = t.movie_id AND tt.frame = t.frame),
lf AS (SELECT track_id, max(tempo_h) - min(tempo_h) + (SELECT modal_h FROM md) AS life FROM cl GROUP BY track_id)
SELECT event_id, CASE WHEN i = n // 2 THEN round(life, 6) END AS lifetime_h FROM cl JOIN lf USING (track_id)"""),
    ),
    "q5_outcomes": (lambda s, d: st.outcomes(_summary(s, d)), duck(_SUMMARY + " SELECT movie_id, final_outcome, count(*) AS n FROM summary GROUP BY ALL")),
    "q6_growth": (lambda s, d: st.growth(fx.tracks(s, d)), duck(" SELECT movie_id, frame, count(DISTINCT track_id) AS n FROM tracks GROUP BY ALL")),
    "q7_divisions": (lambda s, d: st.divisions(fx.tracks(s, d)), duck(" SELECT movie_id, frame, count(*) AS n FROM (SELECT movie_id, track_id, min(frame) AS frame FROM tracks WHERE parent_id > 0 GROUP BY ALL) GROUP BY ALL")),
    "q8_ensemble_msd": (lambda s, d: rounded(st.ensemble_msd(fx.tracks(s, d)), "msd"), duck(_STEP + ", l AS (SELECT a.movie_id, a.track_id, b.rn - a.rn AS lag, avg(power(b.pos_x - a.pos_x, 2) + power(b.pos_y - a.pos_y, 2)) AS m FROM st a JOIN st b ON a.track_id = b.track_id AND b.rn - a.rn BETWEEN 1 AND 20 GROUP BY ALL) SELECT movie_id, lag, round(avg(m), 6) AS msd, count(*) AS n FROM l GROUP BY ALL")),
    "q9_time_bins": (lambda s, d: rounded(st.time_bins(fx.tracks(s, d), "area_px"), *_BOX), duck(", e AS (SELECT min(frame) AS lo, max(frame) AS hi FROM tracks) SELECT movie_id, least(7, floor((frame - lo) * 8 / (hi - lo)))::BIGINT AS bin, " + _QB.format(v="area_px") + " FROM tracks CROSS JOIN e GROUP BY ALL")),
    "q9_by_outcome": (
        lambda s, d: rounded(st.gradient(fx.tracks(s, d), "area_px", "outcome"), *_BOX),
        duck(_FATE + ' SELECT movie_id, fate AS "group", ' + _QB.format(v="area_px") + " FROM tracks JOIN fo USING (movie_id, track_id) GROUP BY movie_id, fate"),
    ),
    "q9_by_division": (
        lambda s, d: rounded(st.gradient(fx.tracks(s, d), "area_px", "mitotic"), *_BOX),
        duck(_FATE + """, md AS (
  SELECT movie_id, track_id, CASE WHEN fate = 'Mitosis' OR track_id IN (SELECT parent_id FROM tracks WHERE parent_id > 0) THEN 'mitotic' ELSE 'non-mitotic' END AS g
  FROM fo)
SELECT movie_id, g AS "group", """ + _QB.format(v="area_px") + " FROM tracks JOIN md USING (movie_id, track_id) GROUP BY movie_id, g"),
    ),
    "q9_by_phase": (
        lambda s, d: rounded(st.gradient(fx.tracks(s, d), "area_px", "phase"), *_BOX),
        duck(' SELECT movie_id, fase AS "group", ' + _QB.format(v="area_px") + " FROM tracks GROUP BY movie_id, fase"),
    ),
    "q12_odometer": (
        lambda s, d: rounded(st.odometer(fx.tracks(s, d), 0.5).select("event_id", "way"), "way"),
        duck(_STEP + " SELECT event_id, round(sum(0.5 * coalesce(step, 0)) OVER (PARTITION BY track_id ORDER BY frame), 6) AS way FROM st"),
    ),
    "q10_aggregated": (lambda s, d: rounded(st.aggregated(fx.tracks(s, d), "fase", "area_px", "median", "outcome"), "value"), duck(" SELECT movie_id, outcome, fase, round(median(area_px), 6) AS value FROM tracks GROUP BY ALL")),
    "q11_moving_average": (lambda s, d: rounded(st.moving_average(fx.tracks(s, d), "area_px", 5).select("event_id", "smooth"), "smooth"), duck(" SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY track_id) >= 5 THEN sum(area_px) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE area_px END, 6) AS smooth FROM tracks")),
    "q12_cumulative": (lambda s, d: st.cumulative_change(fx.tracks(s, d), "area_px").select("event_id", "cumulative"), duck(", x AS (SELECT *, coalesce(abs(area_px - lag(area_px) OVER (PARTITION BY track_id ORDER BY frame)), 0) AS dl FROM tracks) SELECT event_id, sum(dl) OVER (PARTITION BY track_id ORDER BY frame) AS cumulative FROM x")),
    "q13_spider": (lambda s, d: st.spider(fx.tracks(s, d)).select("event_id", "dx", "dy"), duck(" SELECT event_id, pos_x - first_value(pos_x) OVER w AS dx, pos_y - first_value(pos_y) OVER w AS dy FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame)")),
    "q14_rolling": (
        lambda s, d: rounded(st.rolling(fx.tracks(s, d), "area_px", 7).select("event_id", "mean", "cv", "lowest", "highest", "slope"), "mean", "cv", "slope"),
        duck(_STEP + " SELECT a.event_id, round(avg(b.area_px), 6) AS mean, round(stddev_pop(b.area_px) / avg(b.area_px), 6) AS cv, min(b.area_px) AS lowest, max(b.area_px) AS highest, round(regr_slope(b.area_px, b.rn), 6) AS slope FROM st a JOIN st b ON a.track_id = b.track_id AND b.rn BETWEEN a.rn - 3 AND a.rn + 3 GROUP BY a.event_id HAVING count(*) >= 3"),
    ),
    "q15_track_series": (
        lambda s, d: rounded(st.track_series(fx.tracks(s, d)).select("event_id", "speed", "cum_distance", "displacement", "directionality"), "speed", "cum_distance", "displacement", "directionality"),
        duck(_STEP + ", z AS (SELECT event_id, step AS speed, sum(coalesce(step, 0)) OVER w AS cd, sqrt(power(pos_x - first_value(pos_x) OVER w, 2) + power(pos_y - first_value(pos_y) OVER w, 2)) AS di FROM st WINDOW w AS (PARTITION BY track_id ORDER BY frame)) SELECT event_id, round(speed, 6) AS speed, round(cd, 6) AS cum_distance, round(di, 6) AS displacement, round(CASE WHEN cd > 0 THEN di / cd END, 6) AS directionality FROM z"),
    ),
    "q16_whole_windows": (
        lambda s, d: rounded(st.whole_windows(fx.tracks(s, d), 6), "net", "path", "persistence", "area_slope"),
        duck(_STEP + ", w AS (SELECT a.movie_id, a.track_id, a.frame, sqrt(power(arg_max(b.pos_x, b.rn) - any_value(a.pos_x), 2) + power(arg_max(b.pos_y, b.rn) - any_value(a.pos_y), 2)) AS net, sum(b.step) FILTER (b.rn > a.rn) AS path, regr_slope(b.area_px, b.frame) AS sl FROM st a JOIN st b ON a.track_id = b.track_id AND b.rn BETWEEN a.rn AND a.rn + 5 GROUP BY a.movie_id, a.track_id, a.frame, a.rn HAVING count(*) = 6) SELECT movie_id, track_id, frame, round(net, 6) AS net, round(path, 6) AS path, round(CASE WHEN path > 0 THEN net / path END, 6) AS persistence, round(sl, 6) AS area_slope FROM w"),
    ),
    "q17_compared": (
        lambda s, d: rounded(st.compared(fx.tracks(s, d), _summary(s, d), ["mean_speed", "lifetime_h"], F.col("track_id") == 7), "value", "z"),
        duck(_SUMMARY + """, bg AS (SELECT movie_id, track_id, arg_min(fase, frame) AS begun FROM tracks GROUP BY movie_id, track_id),
g AS (SELECT track_id, 'all' AS "group", mean_speed, lifetime_h FROM summary UNION ALL SELECT track_id, CASE WHEN is_mitotic THEN 'mitotic' ELSE 'non-mitotic' END, mean_speed, lifetime_h FROM summary UNION ALL SELECT track_id, begun, mean_speed, lifetime_h FROM summary JOIN bg USING (movie_id, track_id)), l AS (UNPIVOT g ON mean_speed, lifetime_h INTO NAME metric VALUE v),
a AS (SELECT "group", metric, median(v) AS med, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT l."group", l.metric, 1.4826 * median(abs(v - med)) AS sc FROM l JOIN a ON l."group" = a."group" AND l.metric = a.metric GROUP BY ALL),
m AS (UNPIVOT (SELECT movie_id, track_id, mean_speed, lifetime_h FROM summary WHERE track_id = 7) ON mean_speed, lifetime_h INTO NAME metric VALUE v), z AS (SELECT m.movie_id, m.track_id, a."group", m.metric, v, n, CASE WHEN n < 3 THEN NULL WHEN sc > 0 THEN (v - med) / sc WHEN std > 0 THEN (v - mean) / std END AS z FROM m JOIN a ON a.metric = m.metric JOIN b ON b."group" = a."group" AND b.metric = a.metric WHERE n >= 2)
SELECT movie_id, track_id, "group", metric, round(v, 6) AS value, n, round(z, 6) AS z, coalesce(abs(z) >= 3, false) AS outlier FROM z"""),
    ),
    "q19_longest": (lambda s, d: st.longest(fx.tracks(s, d), 20, 5), duck(", c AS (SELECT movie_id, track_id, count(*) AS n FROM tracks GROUP BY ALL HAVING count(*) >= 5) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY n DESC, track_id) AS rank FROM c) WHERE rank <= 20")),
    "q20_final_outcomes": (lambda s, d: st.final_outcomes(fx.tracks(s, d), True), duck(", o AS (SELECT movie_id, track_id, coalesce(arg_min(outcome, frame) FILTER (outcome <> ''), 'none') AS f FROM tracks GROUP BY ALL) SELECT movie_id, track_id, CASE WHEN track_id IN (SELECT parent_id FROM tracks WHERE parent_id > 0) THEN 'Mitosis' ELSE f END AS final_outcome FROM o")),
    "m1_m2_time_table": (
        lambda s, d: rounded(ta.time_table(_files(s, d)).select("movie_id", "frame", "tempo_h", "dt_h", "modal_h", "gap", "source"), "tempo_h", "dt_h"),
        duck(_FILES + " SELECT movie_id, frame, tempo_h, dt_h, modal_h, coalesce(dt_h > modal_h + 1e-6, false) AS gap, 'filename' AS source FROM tt CROSS JOIN md"),
    ),
    "m2_numbered_files": (
        lambda s, d: ta.numbered_files(fx.tracks(s, d).select("movie_id", F.concat(F.lit("a10/img"), F.col("frame"), F.lit("_c1.tif")).alias("filename")).distinct()),
        duck(" SELECT movie_id, 'a10/img' || frame || '_c1.tif' AS filename, row_number() OVER (PARTITION BY movie_id ORDER BY frame) - 1 AS frame FROM (SELECT DISTINCT movie_id, frame FROM tracks)"),
    ),
    "m4_drift_summary": (lambda s, d: rounded(ta.drift_summary(ta.time_table(_files(s, d))), "span_h", "regular_h"), duck(_FILES + " SELECT movie_id, max(tempo_h) AS span_h, (count(*) - 1) * any_value(modal_h) AS regular_h, count(*) FILTER (dt_h > modal_h + 1e-6) AS gaps FROM tt CROSS JOIN md GROUP BY movie_id")),
    "m5_phases": (lambda s, d: fx.tracks(s, d).select("event_id", ta.phase(F.col("frame"), F.lit(100), F.when(F.col("track_id") % 2 == 0, -1).otherwise(300), F.col("track_id") % 5 == 0).alias("fase")), duck(" SELECT event_id, CASE WHEN track_id % 5 = 0 OR frame < 100 THEN 'control' WHEN track_id % 2 <> 0 AND frame > 300 THEN 'washout' ELSE 'treated' END AS fase FROM tracks")),
    "s1_s2_generic_table": (lambda s, d: tb.generic_table(_foreign(s, d)).select("event_id", "track_id", "frame", "pos_x", "pos_y", "outcome"), duck(" SELECT event_id, track_id, CASE WHEN event_id % 10 <> 0 THEN frame END AS frame, pos_x, pos_y, 'fim' AS outcome FROM tracks")),
    "s4_spots_export": (lambda s, d: tb.spots_export(_foreign(s, d).withColumnsRenamed({"TrackID": "TRACK_ID", "Y": "POSITION_Y"})).select("event_id", "track_id", "frame"), duck(" SELECT event_id, track_id, frame FROM tracks WHERE event_id % 10 <> 0")),
    "s5_track_list": (lambda s, d: tb.track_list(_lists(s, d)).groupBy("track_id", "parent_id").agg(F.count("*").alias("n"), F.min("frame").alias("first")), duck(", t AS (SELECT track_id, min(frame) AS b, max(frame) AS e, max(parent_id) AS p FROM tracks GROUP BY ALL) SELECT track_id, CASE WHEN p > 0 THEN p ELSE -1 END AS parent_id, e - b + 1 AS n, b AS first FROM t WHERE track_id % 10 <> 0")),
    "s7_load": (lambda s, d: tb.load(_foreign(s, d)).select("event_id", "movie_id", "outcome", "parent_id", "continuous_label"), duck(" SELECT event_id, movie_id, 'Exit' AS outcome, -1::BIGINT AS parent_id, track_id AS continuous_label FROM tracks")),
    "s1_opened": (
        lambda s, d: _opened(s, d).select("track_id", "frame", "pos_x", "pos_y"),
        duck(" SELECT track_id, frame, round(pos_x, 3) AS pos_x, round(pos_y, 3) AS pos_y FROM tracks WHERE event_id % 10 <> 0"),
    ),
    "s8_reopened": (
        lambda s, d: _reopened(s, d).select("event_id", "track_id", "frame", "pos_x", "parent_id", "outcome", "at_border", F.col("bad_record").isNotNull().alias("bad")),
        duck("""
SELECT event_id::VARCHAR AS event_id, track_id, CASE WHEN event_id % 10 <> 0 THEN frame END AS frame, round(pos_x, 3) AS pos_x,
       CASE WHEN event_id % 4 = 0 THEN -1 ELSE parent_id END AS parent_id, outcome, at_border, event_id % 10 = 0 AS bad
FROM tracks"""),
    ),
    "s9_published": (
        lambda s, d: _published(s, d),
        duck(_SUMMARY + " SELECT movie_id, track_id, fase, final_outcome FROM summary WHERE track_id % 3 = 0"),
    ),
    "s10_channel_columns": (lambda s, d: tb.channel_columns(fx.tracks(s, d).withColumn("gfp_mean", F.col("area_px") * 2).withColumn("rfp_mean", F.lit(1.0)), "gfp"), duck(" SELECT movie_id, track_id, frame, area_px * 2 AS gfp_mean FROM tracks")),
    "s13_review_progress": (
        lambda s, d: tb.progress(tb.marked(*(fx.tracks(s, d).where(c).select("movie_id", F.lit("cell").alias("kind"), F.col("track_id").alias("id")).distinct() for c in ("track_id % 3 = 0", "track_id % 5 = 0", "track_id % 15 = 0"))), fx.tracks(s, d).select("movie_id", F.col("track_id").alias("id")).distinct()),
        duck(", i AS (SELECT DISTINCT movie_id, track_id FROM tracks) SELECT movie_id, count(*) FILTER ((track_id % 3 = 0 OR track_id % 5 = 0) AND track_id % 15 <> 0) AS done, count(*) AS total, round(100.0 * count(*) FILTER ((track_id % 3 = 0 OR track_id % 5 = 0) AND track_id % 15 <> 0) / count(*), 6) AS percent FROM i GROUP BY movie_id"),
    ),
    "s15_matched_frames": (lambda s, d: tb.matched_frames(_names(s, d, 2), _names(s, d, 3)), duck(" SELECT DISTINCT frame, 'f' || frame || '.tif' AS name, CASE WHEN frame % 3 = 0 THEN '3/f' || frame || '.tif' END AS match FROM tracks WHERE frame % 2 = 0")),
}
