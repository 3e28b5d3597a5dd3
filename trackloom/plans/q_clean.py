"""Queries and oracles of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normal_id, quarantined
from ..operators import clean
from ..schema import TRANSLATIONS
from . import fixtures as fx
from .fixtures import duck

_RAW = "CASE event_type WHEN 'signup' THEN ' Mitose ' WHEN 'purchase' THEN 'FIM' WHEN 'error' THEN 'Morte' WHEN 'view' THEN 'Início' ELSE 'custom' END"
_STEPS = ", st AS (SELECT *, hypot_ AS step FROM (SELECT *, sqrt(power(pos_x - lag(pos_x) OVER w, 2) + power(pos_y - lag(pos_y) OVER w, 2)) AS hypot_, frame - lag(frame) OVER w AS hop FROM tracks WINDOW w AS (PARTITION BY movie_id, track_id ORDER BY frame)))"


def _label_tracks(spark, d):
    """Centroids of each label and frame as observations."""
    m = fx.mask_pixels(spark, d)
    return m.groupBy("movie_id", "frame", F.col("label").alias("track_id")).agg(F.avg("x").alias("pos_x"), F.avg("y").alias("pos_y"))


QUERIES = {
    "p1_translate_outcome": (
        lambda s, d: fx.tracks(s, d).select("event_id", clean.translated_outcome(F.expr(_RAW)).alias("outcome")),
        duck(f"SELECT event_id, CASE WHEN lower(trim({_RAW})) IN ('início') THEN '' " + " ".join(f"WHEN lower(trim({_RAW})) = '{k}' THEN '{v}'" for k, v in list(TRANSLATIONS.items()) if k in ("mitose", "fim", "morte")) + f" ELSE {_RAW} END AS outcome FROM tracks"),
    ),
    "p2_standard_links": (
        lambda s, d: clean.standard_links(fx.tracks(s, d).drop("continuous_label", "fase").withColumn("parent_id", F.when(F.col("track_id") % 4 == 0, F.lit("none")).otherwise(F.col("parent_id").cast("string"))).withColumn("treatment", F.lit("control"))).select("event_id", "parent_id", "continuous_label", "fase"),
        duck("SELECT event_id, CASE WHEN track_id % 4 = 0 THEN -1 ELSE parent_id END::BIGINT AS parent_id, track_id AS continuous_label, 'control' AS fase FROM tracks"),
    ),
    "p3_flag_mothers": (
        lambda s, d: clean.flag_mothers(fx.tracks(s, d)).select("event_id", "outcome"),
        duck("SELECT event_id, CASE WHEN outcome = '' AND track_id IN (SELECT parent_id FROM tracks WHERE parent_id > 0) THEN 'Mitosis' ELSE outcome END AS outcome FROM tracks"),
    ),
    "p4_area": (
        lambda s, d: clean.with_area(_label_tracks(s, d), fx.mask_pixels(s, d)).select("movie_id", "frame", "track_id", "area_px"),
        duck("SELECT frame, label AS track_id, count(*)::DOUBLE AS area_px FROM mask_pixels GROUP BY ALL", pixels=True),
    ),
    "p5_border": (
        lambda s, d: clean.with_border(_label_tracks(s, d), fx.mask_pixels(s, d), fx.frames(s, d)).select("movie_id", "frame", "track_id", "at_border"),
        duck("SELECT frame, label AS track_id, bool_or(x = 0 OR y = 0 OR x = 95 OR y = 39) AS at_border FROM mask_pixels GROUP BY ALL", pixels=True),
    ),
    "p6_border_exits": (
        lambda s, d: clean.flag_border_exits(fx.tracks(s, d).withColumn("area_px", F.col("area_px") - 200 + 10)).select("event_id", "outcome"),
        duck(""", r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame DESC) AS back FROM tracks),
 p AS (SELECT track_id FROM r GROUP BY track_id HAVING NOT bool_or(outcome <> '') AND max(frame) < (SELECT max(frame) FROM tracks) AND count(*) >= 3
       AND bool_or(back <= 3 AND at_border) AND median(area_px - 190) FILTER (back <= 3) <= 0.6 * max(area_px - 190) FILTER (back <= 5))
 SELECT event_id, CASE WHEN outcome = '' AND track_id IN (SELECT track_id FROM p) THEN 'Exit' ELSE outcome END AS outcome FROM tracks"""),
    ),
    "p7_propagate_outcome": (
        lambda s, d: clean.propagate_outcome(fx.tracks(s, d).withColumn("outcome", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.lit("")))).select("event_id", "outcome"),
        duck("SELECT event_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS outcome FROM tracks"),
    ),
    "p8_adaptive_thresholds": (
        lambda s, d: clean.adaptive_thresholds(fx.tracks(s, d)).withColumn("max_jump_px", F.round("max_jump_px", 6)),
        duck(_STEPS + " SELECT movie_id, round(CASE WHEN count(step) >= 20 THEN quantile_cont(step, 0.995) * 1.5 ELSE 40.0 END, 6) AS max_jump_px, greatest(3, round_even((max(frame) - min(frame) + 1) * 0.05, 0))::BIGINT AS min_valid_frames FROM st GROUP BY movie_id"),
    ),
    "p9_frame_coherence": (
        lambda s, d: clean.frame_coherence(fx.frames(s, d), fx.frames(s, d).where("frame > 0").withColumn("width", F.lit(95))),
        duck("SELECT DISTINCT movie_id, unnest(['frame count', 'frame size']) AS reason FROM frames", pixels=True),
    ),
    "p10_id_ranges": (
        lambda s, d: fx.tracks(s, d).select("event_id", F.when(F.col("track_id") % 2 == 0, F.col("track_id") + 1_000_000_000).otherwise(F.col("track_id")).alias("track_id")).select("event_id", normal_id("track_id").alias("normal"), quarantined("track_id").alias("quarantined")),
        duck("SELECT event_id, track_id % 2 = 1 AS normal, track_id % 2 = 0 AS quarantined FROM tracks"),
    ),
    "p11_without_border_rows": (
        lambda s, d: clean.without_interpolated(clean.without_border_rows(fx.tracks(s, d).withColumn("interpolated", F.col("event_id") % 5 == 0))).select("event_id"),
        duck("SELECT event_id FROM tracks WHERE NOT at_border AND event_id % 5 <> 0"),
    ),
    "p12_with_fate": (
        lambda s, d: clean.with_fate(fx.tracks(s, d), "MITOSIS").select("event_id"),
        duck("SELECT event_id FROM tracks WHERE track_id IN (SELECT track_id FROM tracks WHERE outcome = 'Mitosis')"),
    ),
    "p13_duplicates": (
        lambda s, d: clean.duplicate_observations(fx.tracks(s, d).withColumn("frame", F.floor(F.col("frame") / 3))),
        duck("SELECT movie_id, track_id, floor(frame / 3.0)::BIGINT AS frame, count(*) AS n FROM tracks GROUP BY ALL HAVING count(*) > 1"),
    ),
    "p14_quality_filter": (
        lambda s, d: clean.quality_filter(fx.tracks(s, d)).select("event_id"),
        duck(_STEPS + " SELECT event_id FROM tracks WHERE track_id NOT IN (SELECT track_id FROM st GROUP BY track_id HAVING count(*) < 20 OR coalesce(max(hop) > 1, false) OR coalesce(max(step) > 40, false))"),
    ),
    "p15_curation_progress": (
        lambda s, d: clean.curation_progress(fx.tracks(s, d)),
        duck(", c AS (SELECT track_id FROM tracks WHERE outcome NOT IN ('', 'Unknown') UNION SELECT parent_id FROM tracks WHERE parent_id > 0 UNION SELECT track_id FROM tracks WHERE parent_id > 0), i AS (SELECT DISTINCT movie_id, track_id FROM tracks) SELECT movie_id, count(*) AS total, count(c.track_id) AS curated, round(100.0 * count(c.track_id) / count(*), 6) AS percent FROM i LEFT JOIN c USING (track_id) GROUP BY movie_id"),
    ),
}
