"""Queries and oracles of the trajectory operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage
from ..operators import trajectory as tr
from . import fixtures as fx
from .fixtures import duck

_STEP = ", st AS (SELECT *, sqrt(power(pos_x - lag(pos_x) OVER w, 2) + power(pos_y - lag(pos_y) OVER w, 2)) AS step, row_number() OVER w AS rn FROM tracks WINDOW w AS (PARTITION BY movie_id, track_id ORDER BY frame))"
_F1 = _STEP + ", f1 AS (SELECT *, coalesce(step, 0) AS step_disp, sum(coalesce(step, 0)) OVER w AS cum_path, sqrt(power(pos_x - first_value(pos_x) OVER w, 2) + power(pos_y - first_value(pos_y) OVER w, 2)) AS net_disp FROM st WINDOW w AS (PARTITION BY movie_id, track_id ORDER BY frame))"
_SUMMARY = (
    _STEP
    + """, ps AS (SELECT movie_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames, coalesce(arg_min(outcome, frame) FILTER (outcome <> ''), 'none') AS final_outcome,
  coalesce(sum(step), 0) AS total_path, sqrt(power(arg_max(pos_x, frame) - arg_min(pos_x, frame), 2) + power(arg_max(pos_y, frame) - arg_min(pos_y, frame), 2)) AS net_displacement, avg(area_px) AS mean_area, max(area_px) AS max_area FROM st GROUP BY ALL),
md AS (SELECT movie_id, track_id, fase FROM (SELECT movie_id, track_id, fase, row_number() OVER (PARTITION BY movie_id, track_id ORDER BY count(*) DESC, fase) AS r FROM tracks GROUP BY movie_id, track_id, fase) WHERE r = 1),
summary AS (SELECT ps.movie_id, ps.track_id, first_frame, last_frame, n_frames, (last_frame - first_frame + 1) * 0.5::DOUBLE AS lifetime_h, fase, final_outcome, final_outcome = 'Mitosis' OR ps.track_id IN (SELECT parent_id FROM tracks WHERE parent_id > 0) AS is_mitotic,
  total_path, net_displacement, CASE WHEN last_frame > first_frame THEN total_path / ((last_frame - first_frame) * 0.5::DOUBLE) ELSE 0 END AS mean_speed, CASE WHEN total_path > 0 THEN net_displacement / total_path ELSE 0 END AS directionality, mean_area, max_area FROM ps JOIN md USING (movie_id, track_id))"""
)
_MEASURES = ["total_path", "net_displacement", "mean_speed", "directionality", "mean_area", "max_area"]


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _rnd(names):
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


def _times(s, d):
    t = fx.tracks(s, d).select("movie_id", "frame").distinct()
    return t.withColumn("tempo_h", F.col("frame") * 0.25 + F.when(F.col("frame") >= 100, 2.0).otherwise(0.0)).withColumn("modal_h", F.lit(0.25))


def _features(s, d):
    return tr.step_features(fx.tracks(s, d))


_MSD = ", lagged AS (SELECT a.movie_id, a.track_id, b.rn - a.rn AS lag, avg(power(b.pos_x - a.pos_x, 2) + power(b.pos_y - a.pos_y, 2)) AS msd FROM st a JOIN st b ON a.track_id = b.track_id AND b.rn - a.rn BETWEEN 1 AND 10 GROUP BY ALL)"
_MOTILITY = (
    _STEP + _MSD
    + """, sv AS (SELECT *, pos_x - lag(pos_x) OVER w AS dx, pos_y - lag(pos_y) OVER w AS dy FROM st WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
sv2 AS (SELECT *, lag(dx) OVER w AS dx0, lag(dy) OVER w AS dy0, lag(step) OVER w AS step0 FROM sv WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
base AS (SELECT movie_id, track_id, count(*) AS n, sum(step) AS total, sqrt(power(arg_max(pos_x, rn) - arg_min(pos_x, rn), 2) + power(arg_max(pos_y, rn) - arg_min(pos_y, rn), 2)) AS net,
  avg(CASE WHEN step > 0 AND step0 > 0 THEN acos(greatest(-1.0, least(1.0, (dx * dx0 + dy * dy0) / (step * step0)))) END) AS mean_turning_angle FROM sv2 GROUP BY ALL),
fit AS (SELECT movie_id, track_id, CASE WHEN count(*) >= 2 THEN regr_slope(msd, lag) / 4 END AS diffusion_coeff, CASE WHEN count(*) FILTER (msd > 0) >= 2 THEN regr_slope(CASE WHEN msd > 0 THEN ln(msd) END, CASE WHEN msd > 0 THEN ln(lag) END) END AS anomalous_exponent FROM lagged GROUP BY ALL),
mv AS (SELECT movie_id, track_id, dx / step AS ux, dy / step AS uy, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS q FROM sv WHERE step > 0),
ac AS (SELECT a.movie_id, a.track_id, b.q - a.q AS lag, avg(a.ux * b.ux + a.uy * b.uy) AS c FROM mv a JOIN mv b ON a.track_id = b.track_id AND b.q - a.q BETWEEN 1 AND 10 GROUP BY ALL),
pt AS (SELECT track_id, min(lag) FILTER (c < 0.36787944117144233)::DOUBLE AS p FROM ac WHERE track_id IN (SELECT track_id FROM mv GROUP BY track_id HAVING count(*) >= 3) GROUP BY track_id)
SELECT base.movie_id, base.track_id, round(CASE WHEN n < 2 THEN NULL WHEN total > 0 THEN net / total ELSE 0 END, 6) AS confinement_ratio, round(mean_turning_angle, 6) AS mean_turning_angle, round(diffusion_coeff, 6) AS diffusion_coeff, round(anomalous_exponent, 6) AS anomalous_exponent, CASE WHEN n >= 4 THEN p END AS persistence_time
FROM base LEFT JOIN fit USING (track_id) LEFT JOIN pt USING (track_id)"""
)
_WIN = ["displacement", "delta_path", "area_cv", "area_slope", "mean_area_px", "delta_area_px", "persistence", "speed_mean"]

QUERIES = {
    "f1_step_features": (
        lambda s, d: rounded(_features(s, d).select("event_id", "step_disp", "cum_path", "net_disp"), "step_disp", "cum_path", "net_disp"),
        duck(_F1 + f" SELECT event_id, {_rnd(['step_disp', 'cum_path', 'net_disp'])} FROM f1"),
    ),
    "f2_speed": (
        lambda s, d: rounded(tr.speed(_features(s, d), times=_times(s, d)).select("event_id", "dt", "speed", "gap_antes"), "speed"),
        duck(_F1 + ", h AS (SELECT *, frame * 0.25::DOUBLE + CASE WHEN frame >= 100 THEN 2 ELSE 0 END AS tempo FROM f1), h2 AS (SELECT *, tempo - lag(tempo) OVER (PARTITION BY track_id ORDER BY frame) AS dt FROM h) SELECT event_id, dt, round(CASE WHEN dt > 0 THEN step_disp / dt END, 6) AS speed, coalesce(dt > 0.25 + 1e-6, false) AS gap_antes FROM h2"),
    ),
    "f3_joined_features": (
        lambda s, d: tr.joined_features(fx.tracks(s, d), fx.tracks(s, d).where("event_id % 2 = 0").select("movie_id", "track_id", "frame", (F.col("area_px") * 2).alias("gfp"), F.lit(0.0).alias("area_px"))).select("event_id", "area_px", "gfp"),
        duck("SELECT event_id, area_px, CASE WHEN event_id % 2 = 0 THEN area_px * 2 END AS gfp FROM tracks"),
    ),
    "f4_root_id": (
        lambda s, d: fx.tracks(s, d).join(lineage.roots(fx.tracks(s, d)), ["movie_id", "track_id"], "left").groupBy("root_id").agg(F.count("*").alias("n")),
        duck(", pm AS (SELECT track_id AS child, max(parent_id) AS parent FROM tracks WHERE parent_id > 0 GROUP BY ALL), walk(track_id, root_id) AS (SELECT DISTINCT track_id, track_id FROM tracks UNION ALL SELECT w.track_id, pm.parent FROM walk w JOIN pm ON pm.child = w.root_id) SELECT root_id, count(*) AS n FROM tracks JOIN walk USING (track_id) WHERE root_id NOT IN (SELECT child FROM pm) GROUP BY root_id", recursive=True),
    ),
    "f5_middle_lifetime": (
        lambda s, d: tr.middle_lifetime(fx.tracks(s, d)).select("event_id", "lifetime_h"),
        duck(_STEP + " SELECT event_id, CASE WHEN rn - 1 = count(*) OVER (PARTITION BY track_id) // 2 THEN (max(frame) OVER (PARTITION BY track_id) - min(frame) OVER (PARTITION BY track_id) + 1) * 0.5::DOUBLE END AS lifetime_h FROM st"),
    ),
    "f6_features_table": (
        lambda s, d: rounded(tr.middle_lifetime(tr.speed(_features(s, d))).select("event_id", "step_disp", "speed", "gap_antes", "lifetime_h"), "step_disp", "speed"),
        duck(_F1 + ", h AS (SELECT *, (frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame)) * 0.5::DOUBLE AS dt, count(*) OVER (PARTITION BY track_id) AS n, max(frame) OVER (PARTITION BY track_id) AS l, min(frame) OVER (PARTITION BY track_id) AS f FROM f1) SELECT event_id, round(step_disp, 6) AS step_disp, round(CASE WHEN dt > 0 THEN step_disp / dt END, 6) AS speed, coalesce(dt > 0.5 + 1e-6, false) AS gap_antes, CASE WHEN rn - 1 = n // 2 THEN (l - f + 1) * 0.5::DOUBLE END AS lifetime_h FROM h"),
    ),
    "f7_sliding_windows": (
        lambda s, d: rounded(tr.sliding_windows(_features(s, d), 5), *_WIN),
        duck(_F1 + f""", w AS (SELECT a.movie_id, a.track_id, a.frame AS frame_center, count(*) AS n_rows,
  sqrt(power(arg_max(b.pos_x, b.rn) - arg_min(b.pos_x, b.rn), 2) + power(arg_max(b.pos_y, b.rn) - arg_min(b.pos_y, b.rn), 2)) AS displacement, coalesce(sum(b.step) FILTER (b.rn > greatest(a.rn - 2, 1)), 0) AS delta_path, max(b.frame) - min(b.frame) AS span,
  stddev_pop(b.area_px) / avg(b.area_px) AS area_cv, regr_slope(b.area_px, b.frame) AS area_slope, avg(b.area_px) AS mean_area_px, arg_max(b.area_px, b.rn) - arg_min(b.area_px, b.rn) AS delta_area_px
  FROM f1 a JOIN f1 b ON a.track_id = b.track_id AND b.rn BETWEEN a.rn - 2 AND a.rn + 2 GROUP BY a.movie_id, a.track_id, a.frame, a.rn),
 x AS (SELECT *, CASE WHEN delta_path > 0 THEN displacement / delta_path END AS persistence, CASE WHEN span > 0 THEN delta_path / span END AS speed_mean FROM w WHERE n_rows >= 2)
 SELECT movie_id, track_id, frame_center, n_rows, span, {_rnd(_WIN)} FROM x"""),
    ),
    "f8_track_summary": (
        lambda s, d: rounded(tr.track_summary(fx.tracks(s, d)), *_MEASURES),
        duck(_SUMMARY + f" SELECT movie_id, track_id, first_frame, last_frame, n_frames, lifetime_h, fase, final_outcome, is_mitotic, {_rnd(_MEASURES)} FROM summary"),
    ),
    "f9_motility": (
        lambda s, d: rounded(tr.motility(fx.tracks(s, d)), "confinement_ratio", "mean_turning_angle", "diffusion_coeff", "anomalous_exponent"),
        duck(_MOTILITY),
    ),
}
