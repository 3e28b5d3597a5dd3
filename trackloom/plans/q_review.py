"""Queries and oracles of anomaly detection and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import step
from ..operators import anomaly as an
from ..operators import lineage
from ..operators import triage as tg
from . import fixtures as fx
from .fixtures import duck
from .q_lineage import _LINKS, _ROOTS, _SPAN
from .q_trajectory import _STEP, rounded

_FINAL = "outcome IN ('Mitosis', 'Exit', 'Death/Senescence', 'Ambiguous')"
_FLAGS = _STEP + f""", hp AS (SELECT *, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS hop FROM st),
fl AS (SELECT movie_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, count(*) < 20 AND NOT bool_or({_FINAL}) AS short, coalesce(max(hop) > 1, false) AND NOT bool_or({_FINAL}) AS gap,
  coalesce(max(step) > 40, false) AS jump, NOT bool_or({_FINAL}) AS no_outcome, arg_max(outcome, frame) = 'Mitosis' AS divides FROM hp GROUP BY ALL)"""
_METRICS = _STEP + ", tm AS (SELECT movie_id, track_id, count(DISTINCT frame)::DOUBLE AS lifetime, coalesce(avg(step), 0) AS mobility, avg(area_px) AS area FROM st GROUP BY ALL)"
_POP = """, lg AS (UNPIVOT (SELECT movie_id, track_id, area, mobility, lifetime FROM tm) ON area, mobility, lifetime INTO NAME trait VALUE value),
c0 AS (SELECT movie_id, trait, count(*) AS n, median(value) AS center, stddev_pop(value) AS std FROM lg GROUP BY ALL),
c1 AS (SELECT lg.movie_id, lg.trait, 1.4826 * median(abs(value - center)) AS mad FROM lg JOIN c0 ON lg.trait = c0.trait GROUP BY ALL),
pop AS (SELECT c0.movie_id, c0.trait, center, CASE WHEN mad > 1e-9 THEN mad ELSE std END AS scale FROM c0 JOIN c1 USING (movie_id, trait))"""
_TRACES = f""", tr0 AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame DESC) AS back, abs(area_px - lag(area_px) OVER w) / greatest(lag(area_px) OVER w, 1) AS turn FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
tr AS (SELECT track_id, count(*) AS rows_, max(frame) < (SELECT max(frame) FROM tracks) AS vanished, coalesce(arg_min(outcome, frame) FILTER (outcome <> ''), '') AS outcome, bool_or(back <= 3 AND at_border) AS edge, median(area_px) FILTER (back <= 3) AS end_area, max(area_px) AS peak, max(turn) AS turn FROM tr0 GROUP BY ALL),
co AS (SELECT avg(f::INT::DOUBLE) AS coverage FROM (SELECT bool_or({_FINAL}) AS f FROM tracks GROUP BY track_id)),
sc0 AS (SELECT fl.*, tr.outcome, coalesce(rows_ >= 3 AND turn > 1, false) AS ajump, (tr.outcome = 'Exit' AND NOT edge AND NOT vanished) OR (tr.outcome = 'Death/Senescence' AND rows_ >= 4 AND end_area > 0.8 * peak AND NOT vanished) AS wrong FROM fl JOIN tr USING (track_id)),
sc AS (SELECT movie_id, track_id, first_frame, last_frame, outcome, CASE WHEN n <= 1 THEN 0 WHEN jump THEN 0.7 ELSE 1 END::DOUBLE AS s_mobility, CASE WHEN n <= 1 THEN 0 WHEN gap THEN 0.8 ELSE 1 END::DOUBLE AS s_lifetime, CASE WHEN ajump THEN 0.9 ELSE 1 END::DOUBLE AS s_area,
  round_even(1 - CASE WHEN no_outcome THEN 0.45 * coverage ELSE 0 END - CASE WHEN wrong THEN 0.25 ELSE 0 END, 3)::DOUBLE AS s_outcome FROM sc0 CROSS JOIN co)"""
_SCORE = "round(greatest(0, 1 - ((1 - s_area) + (1 - s_mobility) + (1 - s_lifetime) + (1 - s_outcome))), 6) AS score"
_ids = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


def _flags(kind):
    return (lambda s, d: an.track_flags(fx.tracks(s, d)).where(kind).select("movie_id", "track_id", "n"), duck(_FLAGS + f" SELECT movie_id, track_id, n FROM fl WHERE {kind}"))


def _scores(s, d):
    return tg.scores(fx.tracks(s, d))


def _errors(s, d):
    return fx.tracks(s, d).where("track_id % 9 = 0").select("movie_id", "track_id")


_ERROR = "event_type IN ('error', 'purchase') AND value > 150"


def _some(s, d, where):
    return fx.tracks(s, d).where(where).select("movie_id", "track_id").distinct()


def _audit(s, d):
    """Every event as an entry of the log: large errors and purchases are edits of the track, all else is bulk acceptance."""
    e = s.read.parquet(f"{d}/events.parquet")
    action = F.when(F.expr(_ERROR), F.col("event_type")).otherwise("bulk_accept")
    return e.select(F.lit(0).cast("long").alias("movie_id"), "ts", action.alias("action"), F.array(F.col("user_id") + 1).alias("ids"), F.col("event_id").cast("string").alias("detail"))


def _wilson(s, d):
    rows = fx.tracks(s, d).groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(F.col("at_border")).alias("errors"))
    point, upper = tg.wilson(F.col("errors"), F.col("n"))
    return rows.select("track_id", point.alias("point"), upper.alias("upper"))


_BAL = """, pr AS (SELECT DISTINCT track_id, frame FROM tracks), per AS (SELECT track_id, min(frame) AS first, max(frame) AS last, bool_or(parent_id > 0) AS born, arg_min(outcome, frame) FILTER (outcome <> '') AS fate FROM tracks GROUP BY ALL),
cnt AS (SELECT frame, count(*) AS n FROM pr GROUP BY frame),
came AS (SELECT p.frame - 1 AS frame, p.track_id, per.born AND per.first = p.frame AS b FROM pr p JOIN per USING (track_id) WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.track_id = p.track_id AND q.frame = p.frame - 1)),
went AS (SELECT p.frame, p.track_id, coalesce(per.fate IN ('Exit', 'Death/Senescence'), false) AND per.last = p.frame AS e FROM pr p JOIN per USING (track_id) WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.track_id = p.track_id AND q.frame = p.frame + 1)),
c2 AS (SELECT frame, count(*) FILTER (b) AS nb, coalesce(string_agg(track_id::VARCHAR, ',' ORDER BY track_id) FILTER (NOT b), '') AS appeared FROM came GROUP BY frame),
w2 AS (SELECT frame, count(*) FILTER (e) AS ne, coalesce(string_agg(track_id::VARCHAR, ',' ORDER BY track_id) FILTER (NOT e), '') AS disappeared FROM went GROUP BY frame),
o AS (SELECT 0::BIGINT AS movie_id, a.frame, a.n AS n_prev, b.n AS n_curr, b.n - a.n AS observed_delta, coalesce(nb, 0) - coalesce(ne, 0) AS expected_delta, coalesce(appeared, '') AS appeared, coalesce(disappeared, '') AS disappeared FROM cnt a JOIN cnt b ON b.frame = a.frame + 1 LEFT JOIN c2 ON c2.frame = a.frame LEFT JOIN w2 ON w2.frame = a.frame)
SELECT movie_id, frame, n_prev, n_curr, observed_delta, expected_delta, observed_delta - expected_delta AS residual, appeared, disappeared FROM o WHERE abs(observed_delta - expected_delta) >= 1 OR appeared <> '' OR disappeared <> ''"""

def _asked(s, d):
    """Frames before, at, between and after the rows of every third track."""
    ends = fx.tracks(s, d).where("track_id % 3 = 0").groupBy("movie_id", "track_id").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    return ends.select("movie_id", "track_id", F.expr("explode(array(f0 - 5, f0, f0 + 21, f0 + 22, (f0 + f1) div 2, f1, f1 + 7))").alias("frame")).distinct()


QUERIES = {
    "a1_short_tracks": (  # no track of the fixture is shorter than the default
        lambda s, d: an.track_flags(fx.tracks(s, d), an.Thresholds(min_valid_frames=70)).where("short").select("movie_id", "track_id", "n"),
        duck(_FLAGS + " SELECT movie_id, track_id, n FROM fl WHERE n < 70 AND no_outcome"),
    ),
    "a2_temporal_gaps": _flags("gap"),
    "a3_impossible_jumps": _flags("jump"),
    "a4_no_outcome": _flags("no_outcome"),
    "a5_division_life_outliers": (
        lambda s, d: an.division_life_outliers(fx.tracks(s, d), an.Thresholds(mitosis_life_mad_k=1.0)),
        duck(_FLAGS + ", lf AS (SELECT movie_id, track_id, (last_frame - first_frame + 1)::DOUBLE AS life FROM fl WHERE divides), md AS (SELECT median(life) AS med, count(*) AS k FROM lf), ma AS (SELECT median(abs(life - med)) AS mad FROM lf CROSS JOIN md) SELECT movie_id, track_id, life FROM lf CROSS JOIN md CROSS JOIN ma WHERE k >= 4 AND mad > 0 AND abs(life - med) / (1.4826 * mad) > 1.0"),
    ),
    "a7_identity_swaps": (
        lambda s, d: an.identity_swaps(fx.tracks(s, d)),
        duck(""", nx AS (SELECT a.movie_id, a.track_id, a.frame, a.pos_x, a.pos_y, a.area_px, b.pos_x AS x1, b.pos_y AS y1, b.area_px AS a1 FROM tracks a JOIN tracks b ON a.track_id = b.track_id AND b.frame = a.frame + 1),
pp AS (SELECT a.movie_id, a.frame, a.track_id AS ta, b.track_id AS tb, sqrt(power(a.pos_x - b.pos_x, 2) + power(a.pos_y - b.pos_y, 2)) AS sep, sqrt(power(a.x1 - a.pos_x, 2) + power(a.y1 - a.pos_y, 2)) AS ii, sqrt(power(b.x1 - b.pos_x, 2) + power(b.y1 - b.pos_y, 2)) AS jj,
 sqrt(power(a.x1 - b.pos_x, 2) + power(a.y1 - b.pos_y, 2)) AS ij, sqrt(power(b.x1 - a.pos_x, 2) + power(b.y1 - a.pos_y, 2)) AS ji, abs(a.a1 - b.area_px) + abs(b.a1 - a.area_px) < abs(a.a1 - a.area_px) + abs(b.a1 - b.area_px) AS ac FROM nx a JOIN nx b ON a.frame = b.frame AND a.track_id <> b.track_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame, ta ORDER BY sep, tb) AS r FROM pp)
SELECT DISTINCT movie_id, frame, least(ta, tb) AS track_a, greatest(ta, tb) AS track_b, round(sep, 2) AS separation, round((ii + jj) - (ij + ji), 2) AS cost_improvement, ac AS area_corroborates FROM rk WHERE r = 1 AND sep <= 40 AND ij < ii AND ji < jj AND (ii + jj) - (ij + ji) >= greatest(0.25 * (ii + jj), 1.0)"""),
    ),
    "a8_mass_balance": (lambda s, d: an.mass_balance(fx.tracks(s, d)).withColumns({"appeared": _ids("appeared"), "disappeared": _ids("disappeared")}), duck(_BAL)),
    "a10_relink_suggestions": (
        lambda s, d: rounded(an.relink_suggestions(fx.tracks(s, d)), "distance"),
        duck(""", g AS (SELECT movie_id, track_id, frame + 1 AS gap_start, lead(frame) OVER w - 1 AS gap_end, pos_x + coalesce(pos_x - lag(pos_x) OVER w, 0) AS expected_x, pos_y + coalesce(pos_y - lag(pos_y) OVER w, 0) AS expected_y FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
c AS (SELECT g.*, t.track_id AS candidate, t.pos_x, t.pos_y, sqrt(power(t.pos_x - expected_x, 2) + power(t.pos_y - expected_y, 2)) AS distance FROM g JOIN tracks t ON t.frame = gap_start AND t.track_id <> g.track_id WHERE gap_end >= gap_start),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, gap_start ORDER BY distance, candidate) AS k FROM c WHERE distance <= 60)
SELECT movie_id, track_id, gap_start, gap_end, gap_end - gap_start + 1 AS missing, expected_x, expected_y, candidate, pos_x, pos_y, round(distance, 6) AS distance FROM r WHERE k = 1"""),
    ),
    "a11_gap_fills": (
        lambda s, d: rounded(an.gap_fills(fx.tracks(s, d)), "pos_x", "pos_y"),
        duck(", g AS (SELECT movie_id, track_id, frame AS f0, pos_x, pos_y, lead(frame) OVER w AS f1, lead(pos_x) OVER w AS x1, lead(pos_y) OVER w AS y1 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame)), e AS (SELECT *, unnest(range(f0 + 1, f1)) AS frame FROM g WHERE f1 - f0 - 1 BETWEEN 1 AND 12) SELECT movie_id, track_id, frame, round(pos_x + (frame - f0) * (x1 - pos_x) / (f1 - f0), 6) AS pos_x, round(pos_y + (frame - f0) * (y1 - pos_y) / (f1 - f0), 6) AS pos_y FROM e"),
    ),
    "a9_predicted_paths": (
        lambda s, d: rounded(an.predicted_paths(fx.tracks(s, d), _asked(s, d)), "pos_x", "pos_y"),
        duck("""
, sp AS (SELECT movie_id, track_id, min(frame) AS f0, max(frame) AS f1 FROM tracks WHERE track_id % 3 = 0 GROUP BY movie_id, track_id),
ask AS (SELECT DISTINCT movie_id, track_id, unnest([f0 - 5, f0, f0 + 21, f0 + 22, (f0 + f1) // 2, f1, f1 + 7]) AS frame FROM sp),
a AS (SELECT ask.*, t.frame AS fa, t.pos_x AS xa, t.pos_y AS ya FROM ask ASOF LEFT JOIN tracks t ON ask.movie_id = t.movie_id AND ask.track_id = t.track_id AND ask.frame >= t.frame),
b AS (SELECT a.*, t.frame AS fb, t.pos_x AS xb, t.pos_y AS yb FROM a ASOF LEFT JOIN tracks t ON a.movie_id = t.movie_id AND a.track_id = t.track_id AND a.frame <= t.frame)
SELECT movie_id, track_id, frame,
       round(CASE WHEN fa IS NULL THEN xb WHEN fb IS NULL OR fa = frame THEN xa ELSE xa + (frame - fa) / (fb - fa) * (xb - xa) END, 6) AS pos_x,
       round(CASE WHEN fa IS NULL THEN yb WHEN fb IS NULL OR fa = frame THEN ya ELSE ya + (frame - fa) / (fb - fa) * (yb - ya) END, 6) AS pos_y
FROM b"""),
    ),
    "a12_displacement_histogram": (
        lambda s, d: an.histogram(fx.tracks(s, d).withColumn("step", step()), "step", 40),
        duck(_STEP + ", b AS (SELECT min(step) AS lo, max(step) AS hi FROM st) SELECT 0::BIGINT AS movie_id, least(39, floor((step - lo) * 40 / (hi - lo)))::BIGINT AS bin, count(*) AS n FROM st CROSS JOIN b WHERE step IS NOT NULL GROUP BY ALL"),
    ),
    "a12_lifetime_histogram": (
        lambda s, d: an.histogram(lineage.spans(fx.tracks(s, d)).withColumn("life", F.col("last_frame") - F.col("first_frame") + 1), "life", 30),
        duck(", sp AS (SELECT max(frame) - min(frame) + 1 AS life FROM tracks GROUP BY track_id), b AS (SELECT min(life) AS lo, max(life) AS hi FROM sp) SELECT 0::BIGINT AS movie_id, least(29, floor((life - lo) * 30 / (hi - lo)))::BIGINT AS bin, count(*) AS n FROM sp CROSS JOIN b GROUP BY ALL"),
    ),
    "a13_flagged_cells": (
        lambda s, d: an.flagged_cells(fx.tracks(s, d)),
        duck(_FLAGS + _LINKS + _SPAN + ", v AS (SELECT parent AS track_id, count(*) > 2 AS a, coalesce(bool_or(c.first_frame <= p.first_frame), false) AS b, any_value(p.last_frame) >= min(coalesce(c.first_frame, 1000000000)) AS c FROM links l LEFT JOIN span c ON c.track_id = child LEFT JOIN span p ON p.track_id = parent GROUP BY ALL), k AS (SELECT track_id, 'too many daughters' AS kind FROM v WHERE a UNION ALL SELECT track_id, 'daughter not after mother' FROM v WHERE b UNION ALL SELECT track_id, 'mother outlives division' FROM v WHERE c UNION ALL SELECT track_id, 'short' FROM fl WHERE short UNION ALL SELECT track_id, 'gap' FROM fl WHERE gap UNION ALL SELECT track_id, 'jump' FROM fl WHERE jump) SELECT 0::BIGINT AS movie_id, k.track_id, kind, first_frame FROM k LEFT JOIN span USING (track_id)"),
    ),
    "t1_track_metrics": (lambda s, d: rounded(tg.track_metrics(fx.tracks(s, d)), "mobility", "area"), duck(_METRICS + " SELECT movie_id, track_id, lifetime, round(mobility, 6) AS mobility, round(area, 6) AS area FROM tm")),
    "t2_coverage": (lambda s, d: rounded(tg.coverage(fx.tracks(s, d)), "coverage"), duck(f" SELECT movie_id, round(avg(f::INT::DOUBLE), 6) AS coverage FROM (SELECT movie_id, track_id, bool_or({_FINAL}) AS f FROM tracks GROUP BY ALL) GROUP BY movie_id")),
    "t3_population": (lambda s, d: rounded(tg.population(tg.track_metrics(fx.tracks(s, d))), "center", "scale"), duck(_METRICS + _POP + " SELECT movie_id, trait, round(center, 6) AS center, round(scale, 6) AS scale FROM pop")),
    "t4_deviation": (
        lambda s, d: rounded(_scores(s, d).select("movie_id", "track_id", "deviation"), "deviation"),
        duck(_METRICS + _POP + ", z AS (SELECT lg.movie_id, track_id, abs(value - center) / scale AS z FROM lg JOIN pop USING (movie_id, trait)), dv AS (SELECT movie_id, track_id, round_even(CASE WHEN z <= 1 THEN 1 ELSE exp(-0.5 * power((z - 1) / 1.25, 2)) END, 3) AS dv FROM z) SELECT movie_id, track_id, round(greatest(0, 1 - sum(1 - dv)), 6) AS deviation FROM dv GROUP BY ALL"),
    ),
    "t5_t6_t7_scores": (
        lambda s, d: rounded(_scores(s, d).select("movie_id", "track_id", "outcome", "s_area", "s_mobility", "s_lifetime", "s_outcome", "score"), "score"),
        duck(_FLAGS + _TRACES + f" SELECT movie_id, track_id, outcome, s_area, s_mobility, s_lifetime, s_outcome, {_SCORE} FROM sc"),
    ),
    "t7_blended_scores": (
        lambda s, d: rounded(tg.scores(fx.tracks(s, d), blend=True).withColumn("far", F.expr("size(filter(reasons, r -> r LIKE '% far from the movie%'))").cast("long")).select("movie_id", "track_id", "s_area", "s_mobility", "s_lifetime", "score", "far"), "score"),
        duck(_FLAGS + _METRICS[len(_STEP):] + _POP + _TRACES + f""", z AS (SELECT lg.movie_id, track_id, trait, abs(value - center) / scale AS z FROM lg JOIN pop USING (movie_id, trait)),
dv AS (SELECT movie_id, track_id, trait, CASE WHEN z <= 1 THEN 1 ELSE exp(-0.5 * power((z - 1) / 1.25, 2)) END AS dv FROM z),
wd AS (SELECT movie_id, track_id, count(*) FILTER (dv < 0.75) AS far, max(round_even(dv, 3)) FILTER (trait = 'area') AS da, max(round_even(dv, 3)) FILTER (trait = 'mobility') AS dm, max(round_even(dv, 3)) FILTER (trait = 'lifetime') AS dl FROM dv GROUP BY ALL),
bl AS (SELECT sc.movie_id, sc.track_id, coalesce(far, 0) AS far, round_even(s_area * coalesce(da, 1), 3) AS s_area, round_even(s_mobility * coalesce(dm, 1), 3) AS s_mobility, round_even(s_lifetime * coalesce(dl, 1), 3) AS s_lifetime, s_outcome FROM sc LEFT JOIN wd ON wd.track_id = sc.track_id AND wd.movie_id = sc.movie_id)
SELECT movie_id, track_id, s_area, s_mobility, s_lifetime, {_SCORE}, far FROM bl"""),
    ),
    "t8_review_queue": (
        lambda s, d: tg.queue(_scores(s, d)).where("bucket = 'review'").select("movie_id", "track_id", "first_frame"),
        duck(_FLAGS + _TRACES + f", q AS (SELECT *, {_SCORE} FROM sc) SELECT movie_id, track_id, first_frame FROM q WHERE score < 0.85"),
    ),
    "t9_queue_ticks": (
        lambda s, d: tg.queue(_scores(s, d)).where("bucket = 'review'").withColumn("done", F.col("track_id") % 2 == 0).groupBy("movie_id").agg(F.count_if("done").alias("done"), F.count("*").alias("total")),
        duck(_FLAGS + _TRACES + f", q AS (SELECT *, {_SCORE} FROM sc) SELECT movie_id, count(*) FILTER (track_id % 2 = 0) AS done, count(*) AS total FROM q WHERE score < 0.85 GROUP BY movie_id"),
    ),
    "t10_validation_sample": (lambda s, d: tg.validation_sample(tg.queue(_scores(s, d)).where("bucket = 'accept'")).select("movie_id", "track_id"), duck(_FLAGS + _METRICS[len(_STEP):] + _POP + _TRACES + f""", q AS (SELECT *, {_SCORE} FROM sc), z AS (SELECT lg.movie_id, track_id, abs(value - center) / scale AS z FROM lg JOIN pop USING (movie_id, trait)),
dv AS (SELECT movie_id, track_id, round_even(CASE WHEN z <= 1 THEN 1 ELSE exp(-0.5 * power((z - 1) / 1.25, 2)) END, 3) AS dv FROM z), de AS (SELECT track_id, round_even(greatest(0, 1 - sum(1 - dv)), 6) AS deviation FROM dv GROUP BY ALL)
SELECT movie_id, track_id FROM q LEFT JOIN de USING (track_id) WHERE score >= 0.85 AND NOT coalesce(deviation < 0.5, false) QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY md5('0:' || movie_id || ':' || track_id)) <= 50""")),
    "t12_tally": (
        lambda s, d: tg.tally(_some(s, d, "track_id % 5 = 0"), _audit(s, d), _some(s, d, "track_id % 2 = 0")),
        duck(f", au AS (SELECT track_id, ts FROM ev1 WHERE {_ERROR}), ed AS (SELECT track_id, count(*) AS edits, max(ts) AS last_edit FROM au GROUP BY track_id) SELECT DISTINCT movie_id, track_id, coalesce(edits, 0) AS edits, last_edit, CASE WHEN edits > 0 AND track_id % 2 = 0 THEN 'fixed' WHEN edits > 0 THEN 'modified' WHEN track_id % 2 = 0 THEN 'correct' ELSE 'pending' END AS status FROM tracks LEFT JOIN ed USING (track_id) WHERE track_id % 5 = 0"),
    ),
    "t12_edit_log": (
        lambda s, d: tg.edit_log(_some(s, d, "track_id % 5 = 0"), _audit(s, d)).select("track_id", "ts", "action", "detail"),
        duck(f" SELECT track_id, ts, event_type AS action, event_id::VARCHAR AS detail FROM ev1 WHERE track_id % 5 = 0 AND {_ERROR}"),
    ),
    "t11_wilson": (
        _wilson,
        duck(", w AS (SELECT track_id, count(*)::DOUBLE AS n, count(*) FILTER (at_border) / count(*)::DOUBLE AS p FROM tracks GROUP BY track_id) SELECT track_id, round(p, 4) AS point, round(least(1.0, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS upper FROM w"),
    ),
    "t13_calibration": (
        lambda s, d: rounded(tg.calibration(_scores(s, d), _errors(s, d)), "error_rate"),
        duck(_FLAGS + _TRACES + f", q AS (SELECT *, {_SCORE} FROM sc), lo AS (SELECT floor(least(0.85, min(score)) * 20) / 20 AS low FROM q) SELECT movie_id, least(4, floor((score - low) * 5 / (1 - low)))::BIGINT AS bin, round(avg((track_id % 9 = 0)::INT::DOUBLE), 6) AS error_rate, count(*) AS n FROM q CROSS JOIN lo GROUP BY ALL"),
    ),
    "t14_reliability": (
        lambda s, d: rounded(tg.reliability(_scores(s, d), _errors(s, d)), "error_rate"),
        duck(_FLAGS + _TRACES + ", u AS (SELECT track_id, 'area' AS trait, s_area AS s FROM sc UNION ALL SELECT track_id, 'mobility', s_mobility FROM sc UNION ALL SELECT track_id, 'lifetime', s_lifetime FROM sc UNION ALL SELECT track_id, 'outcome', s_outcome FROM sc) SELECT 0::BIGINT AS movie_id, trait, s < 0.85 AS low, round(avg((track_id % 9 = 0)::INT::DOUBLE), 6) AS error_rate, count(*) AS n FROM u GROUP BY ALL"),
    ),
    "t15_validated": (
        lambda s, d: tg.validated(fx.tracks(s, d), lineage.roots(fx.tracks(s, d)), fx.tracks(s, d).where("track_id < 5").select("movie_id", F.col("track_id").alias("root_id")).distinct(), _errors(s, d)),
        duck(_ROOTS + " SELECT DISTINCT t.movie_id, t.track_id FROM tracks t JOIN roots r USING (track_id) WHERE root_id < 5 OR t.track_id % 9 = 0", recursive=True),
    ),
}
