"""Queries and oracles of label-image and intensity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly
from ..operators import intensity as it
from ..operators import pixels as px
from ..operators import statistics as st
from . import fixtures as fx
from .fixtures import duck
from .q_trajectory import rounded

_IN = " m.frame = n.frame AND m.label = n.label"
_BOUND = """, n4 AS (SELECT m.frame, m.label, m.y, m.x, count(n.x) AS k FROM mask_pixels m LEFT JOIN mask_pixels n ON m.frame = n.frame AND m.label = n.label AND abs(m.x - n.x) + abs(m.y - n.y) = 1 GROUP BY ALL), bd AS (SELECT frame, label, y, x FROM n4 WHERE k < 4)"""
_PERIM = _BOUND + """, pw AS (SELECT m.frame, m.label, m.y, m.x, 1 + 2 * count(n.x) FILTER (abs(m.x - n.x) + abs(m.y - n.y) = 1) + 10 * count(n.x) FILTER (abs(m.x - n.x) = 1 AND abs(m.y - n.y) = 1) AS code FROM bd m LEFT JOIN bd n ON m.frame = n.frame AND m.label = n.label AND abs(m.x - n.x) <= 1 AND abs(m.y - n.y) <= 1 GROUP BY ALL),
pe AS (SELECT frame, label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM pw GROUP BY ALL)"""
_CENT = ", ce AS (SELECT frame, label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM mask_pixels GROUP BY ALL)"
_RR = _CENT + ", dd AS (SELECT bd.frame, bd.label, n, sqrt(power(x - cx, 2) + power(y - cy, 2)) AS d FROM bd JOIN ce USING (frame, label)), rr AS (SELECT frame, label, CASE WHEN any_value(n) >= 4 AND count(*) >= 2 THEN max(d) / min(d) END AS radius_ratio FROM dd WHERE d > 0 GROUP BY ALL)"
_BG = ", bg AS (SELECT c.frame, median(value) AS bg, count(*) AS n FROM channel_pixels c ANTI JOIN mask_pixels m ON c.frame = m.frame AND c.y = m.y AND c.x = m.x GROUP BY c.frame)"
_RING = _BOUND + """, off AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-4, 5)) AS i) a CROSS JOIN (SELECT unnest(range(-4, 5)) AS i) b WHERE abs(a.i) + abs(b.i) <= 4),
far AS (SELECT DISTINCT frame, label, y + dy AS y, x + dx AS x FROM bd CROSS JOIN off), nea AS (SELECT DISTINCT frame, label, y + dy AS y, x + dx AS x FROM bd CROSS JOIN off WHERE abs(dy) + abs(dx) <= 1),
ring AS (SELECT * FROM far ANTI JOIN nea USING (frame, label, y, x)), ring2 AS (SELECT * FROM ring ANTI JOIN mask_pixels USING (frame, y, x))"""
_STATS = _RING + _BG + """, parts AS (SELECT frame, label, y, x, 'nuc' AS part FROM mask_pixels UNION ALL SELECT frame, label, y, x, 'ring' FROM ring2),
vals AS (SELECT p.frame, p.label, part, greatest(value - bg, 0) AS v FROM parts p JOIN channel_pixels c USING (frame, y, x) JOIN bg USING (frame)),
st AS (SELECT frame, label, avg(v) FILTER (part = 'nuc') AS nuc_mean, median(v) FILTER (part = 'nuc') AS nuc_median, stddev_pop(v) FILTER (part = 'nuc') AS nuc_std, quantile_cont(v, 0.9) FILTER (part = 'nuc') AS nuc_p90, count(*) FILTER (part = 'nuc') AS nuc_px, avg(v) FILTER (part = 'ring') AS ring_mean, median(v) FILTER (part = 'ring') AS ring_median, count(*) FILTER (part = 'ring') AS ring_px, sum(v) AS cell_sum FROM vals GROUP BY ALL)"""
_TEXTURE = """, iv AS (SELECT frame, label, y, x, greatest(value - bg, 0) AS value FROM channel_pixels JOIN mask_pixels USING (frame, y, x) JOIN bg USING (frame)), e AS (SELECT frame // 100000 AS mv, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM iv GROUP BY 1),
q AS (SELECT frame, label, y, x, (round_even(greatest(0, least(1, (value - lo) / (hi - lo))) * 14, 0) + 1)::BIGINT AS q FROM iv JOIN e ON mv = frame // 100000), o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) t(a, dy, dx)),
pr AS (SELECT m.frame, m.label, a, unnest([m.q, n.q]) AS i, unnest([n.q, m.q]) AS j FROM q m CROSS JOIN o JOIN q n ON m.frame = n.frame AND m.label = n.label AND n.y = m.y + dy AND n.x = m.x + dx),
c AS (SELECT frame, label, a, i, j, count(*) AS n FROM pr GROUP BY ALL), tp AS (SELECT *, n / sum(n) OVER (PARTITION BY frame, label, a) AS p FROM c),
s AS (SELECT frame, label, a, sum(p * (i - j) * (i - j)) AS contrast, sqrt(sum(p * p)) AS energy, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(-p * log2(p)) AS entropy FROM tp GROUP BY ALL), z AS (SELECT frame, label, count(*) AS px FROM mask_pixels GROUP BY ALL)"""
_ELLIPSE = """, mo AS (SELECT frame, label, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cov FROM mask_pixels GROUP BY ALL), el AS (SELECT *, sqrt(power(vy - vx, 2) + 4 * cov * cov) AS r FROM mo),
ax AS (SELECT frame, label, cx, cy, 2 * sqrt((vx + vy + r) / 2) AS a, 2 * sqrt((vx + vy - r) / 2) AS b, CASE WHEN r > 0 THEN atan2(2 * cov, vy - vx) / 2 ELSE 0 END AS t FROM el),
pp AS (SELECT g.frame, ax.label, g.y, g.x, a, b, power((g.x - cx) * sin(t) + (g.y - cy) * cos(t), 2) AS u, power((g.x - cx) * cos(t) - (g.y - cy) * sin(t), 2) AS v FROM dense g JOIN ax ON g.frame = ax.frame WHERE g.label IS NULL),
er AS (SELECT frame, label, y, x FROM pp WHERE u / power(a + 4, 2) + v / power(b + 4, 2) <= 1 AND NOT u / power(a + 1, 2) + v / power(b + 1, 2) <= 1)"""
# A pixel lies in the convex hull unless some line through two pixels of the object has all of the object on one side and it on the other.
_SOLID = _BOUND + """, ob0 AS (SELECT frame, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*)::DOUBLE AS n FROM mask_pixels GROUP BY ALL),
ed AS (SELECT p.frame, p.label, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by FROM bd p JOIN bd q ON p.frame = q.frame AND p.label = q.label AND (p.x <> q.x OR p.y <> q.y) JOIN bd r ON p.frame = r.frame AND p.label = r.label GROUP BY ALL HAVING min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) >= 0),
bx AS (SELECT frame, label, n, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM ob0)),
hu AS (SELECT bx.frame, bx.label, n, count(*) AS h FROM bx WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.frame = bx.frame AND ed.label = bx.label AND (ed.bx - ax) * (bx.y - ay) - (ed.by - ay) * (bx.x - ax) < 0) GROUP BY ALL),
so AS (SELECT frame, label, n / h AS solidity FROM hu)"""
_NII = _PERIM + _RR + """, mo AS (SELECT frame, label, count(*)::DOUBLE AS area, var_pop(y) AS a, var_pop(x) AS c, covar_pop(x, y) AS b, (max(x) - min(x) + 1) * (max(y) - min(y) + 1)::DOUBLE AS box FROM mask_pixels GROUP BY ALL),
l AS (SELECT *, (a + c) / 2 + sqrt(4 * b * b + power(a - c, 2)) / 2 AS l1, greatest((a + c) / 2 - sqrt(4 * b * b + power(a - c, 2)) / 2, 0) AS l2 FROM mo),
q AS (SELECT l.frame, l.label, area, perimeter, 4 * pi() * area / power(perimeter, 2) AS circularity, sqrt(1 - l2 / l1) AS eccentricity, sqrt(l1) / sqrt(l2) AS aspect, area / box AS area_box, radius_ratio, power(perimeter, 2) / (4 * pi() * area) AS roundness FROM l LEFT JOIN pe USING (frame, label) LEFT JOIN rr USING (frame, label)),
ni AS (SELECT *, aspect - area_box + radius_ratio + roundness AS nii FROM q)"""
_STRICT = anomaly.Thresholds(area_mad_k=0.6, min_solidity=0.93, max_eccentricity=0.75)
_CN = "CASE WHEN ring_median > 0 AND nuc_median > 0 THEN ring_median / nuc_median END"


def _stats(s, d):
    return it.compartment_stats(fx.channel_pixels(s, d), fx.mask_pixels(s, d), it.background(fx.channel_pixels(s, d), fx.mask_pixels(s, d), fx.frames(s, d)))


def _levels(s, d):
    return it.quantised(fx.channel_pixels(s, d), fx.mask_pixels(s, d), it.background(fx.channel_pixels(s, d), fx.mask_pixels(s, d), fx.frames(s, d)))


def _stretched(s, d):
    """The channel as an 8-bit export with both ends cut off."""
    return fx.channel_pixels(s, d).withColumns({"channel": F.lit("stretched"), "value": F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("value") - 120) * 3))})


def _tracks(s, d):
    """Centroids as observations, ids swapped in pairs in odd frames."""
    c = px.centroids(fx.mask_pixels(s, d))
    return c.select("movie_id", "frame", (F.col("label") + F.when(F.col("frame") % 2 == 1, 100).otherwise(0)).alias("track_id"), F.col("x").alias("pos_x"), F.col("y").alias("pos_y"))


_T = ", ob AS (SELECT frame, label + CASE WHEN frame % 2 = 1 THEN 100 ELSE 0 END AS track_id, round_even(avg(x), 0)::BIGINT AS x, round_even(avg(y), 0)::BIGINT AS y FROM mask_pixels GROUP BY frame, label)"
_OUTCOME = "CASE label % 3 WHEN 0 THEN 'Mitosis' WHEN 1 THEN '' ELSE 'Exit' END"
_MORPH = ["area", "perimeter", "circularity", "eccentricity", "aspect", "area_box", "radius_ratio", "roundness", "nii"]

#: A channel that lies 1 pixel lower and, on even frames, 17 pixels to the right, with the pixels that the frame still holds.
_DRIFTED = """, dr AS (SELECT frame, y + 1 AS y, x + CASE WHEN frame % 2 = 0 THEN 17 ELSE 0 END AS x, value FROM channel_pixels),
fs AS (SELECT frame, row_number() OVER (PARTITION BY frame // 100000 ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY frame // 100000) AS n FROM fr),
sf AS (SELECT frame FROM fs WHERE n <= 5 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(5)) AS k) WHERE i = k * (n - 1) // 4)),
im AS (SELECT frame, 0 AS src, y, x, value AS v FROM channel_pixels JOIN sf USING (frame) UNION ALL SELECT frame, 1, y, x, value FROM dr JOIN sf USING (frame) WHERE y < 40 AND x < 96)"""

#: Discrete Fourier transforms of both, row by row and column by column; the phases of their product; and its transform back.
_PHASE = """, us AS (SELECT unnest(range(96))::BIGINT AS u), vs AS (SELECT unnest(range(40))::BIGINT AS v),
r1 AS (SELECT frame, src, y, u, sum(im.v * cos(2 * pi() * ((u * x) % 96) / 96)) AS re, -sum(im.v * sin(2 * pi() * ((u * x) % 96) / 96)) AS i FROM im CROSS JOIN us GROUP BY ALL),
f1 AS (SELECT frame, src, v, u, sum(re * cos(2 * pi() * ((v * y) % 40) / 40) + i * sin(2 * pi() * ((v * y) % 40) / 40)) AS re, sum(i * cos(2 * pi() * ((v * y) % 40) / 40) - re * sin(2 * pi() * ((v * y) % 40) / 40)) AS i FROM r1 CROSS JOIN vs GROUP BY ALL),
cr AS (SELECT b.frame, b.v, b.u, b.re * a.re + b.i * a.i AS re, b.i * a.re - b.re * a.i AS i FROM f1 a JOIN f1 b ON a.frame = b.frame AND a.u = b.u AND a.v = b.v AND a.src = 0 AND b.src = 1),
ph AS (SELECT frame, v, u, re / m AS re, i / m AS i FROM (SELECT *, sqrt(re * re + i * i) AS m, max(sqrt(re * re + i * i)) OVER (PARTITION BY frame) AS top FROM cr) WHERE m > 1e-9 * top),
b1 AS (SELECT frame, v, x, sum(re * cos(2 * pi() * ((u * x) % 96) / 96) - i * sin(2 * pi() * ((u * x) % 96) / 96)) / 96 AS re, sum(re * sin(2 * pi() * ((u * x) % 96) / 96) + i * cos(2 * pi() * ((u * x) % 96) / 96)) / 96 AS i FROM ph CROSS JOIN (SELECT u AS x FROM us) GROUP BY ALL),
pk AS (SELECT frame, y, x, round(sum(re * cos(2 * pi() * ((v * y) % 40) / 40) - i * sin(2 * pi() * ((v * y) % 40) / 40)) / 40, 9) AS p FROM b1 CROSS JOIN (SELECT v AS y FROM vs) GROUP BY ALL),
mx AS (SELECT frame, y AS my, x AS mx FROM pk QUALIFY row_number() OVER (PARTITION BY frame ORDER BY p DESC, y, x) = 1),
nr AS (SELECT frame, my, mx, p, (y - my + 60) % 40 - 20 AS oy, (x - mx + 144) % 96 - 48 AS ox FROM pk JOIN mx USING (frame)),
ce AS (SELECT frame, my, mx, sum(p * oy) / sum(p) AS oy, sum(p * ox) / sum(p) AS ox FROM nr WHERE abs(oy) <= 2 AND abs(ox) <= 2 GROUP BY ALL),
sh AS (SELECT frame, CASE WHEN 2 * my > 40 THEN my - 40 ELSE my END + oy AS dy, CASE WHEN 2 * mx > 96 THEN mx - 96 ELSE mx END + ox AS dx FROM ce)
"""


def _drawn(s, d):
    """A drawn region: the pixels of some objects, on two of three frames."""
    return fx.mask_pixels(s, d).where("label % 5 = 2 AND (movie_id * 100000 + frame) % 3 < 2").select("movie_id", "frame", "y", "x")


def _drifted(s, d):
    """The drifted channel of the oracle."""
    shift = F.when(F.col("frame") % 2 == 0, 17).otherwise(0)
    return fx.channel_pixels(s, d).withColumns({"channel": F.lit("drifted"), "y": F.col("y") + 1, "x": F.col("x") + shift}).where("y < 40 AND x < 96")


_CORNER = "0.08578643762690492 * v11 + 0.20710678118654757 * (v{0}1 + v1{1}) + 0.5 * v{0}{1} - value >= -1e-9"  # (1 - s)^2, (1 - s) s and s^2 of s, the root of 1/2
_PATTERNS = """
, core AS (
  SELECT m.frame, m.label, m.y, m.x
  FROM mask_pixels m JOIN mask_pixels n ON n.frame = m.frame AND n.label = m.label AND abs(n.y - m.y) + abs(n.x - m.x) = 1
  GROUP BY m.frame, m.label, m.y, m.x HAVING count(*) = 4),
near AS (
  SELECT k.frame, k.label, k.y, k.x, """ + ", ".join(f"coalesce(max(c.value) FILTER (c.y - k.y = {i - 1} AND c.x - k.x = {j - 1}), 0) AS v{i}{j}" for i in range(3) for j in range(3)) + """
  FROM core k JOIN channel_pixels c ON c.frame = k.frame AND abs(c.y - k.y) <= 1 AND abs(c.x - k.x) <= 1
  GROUP BY k.frame, k.label, k.y, k.x),
bits AS (
  SELECT frame, label, list_transform([v12 - value >= -1e-9, """ + _CORNER.format(0, 2) + ", v01 - value >= -1e-9, " + _CORNER.format(0, 0) + ", v10 - value >= -1e-9, " + _CORNER.format(2, 0) + ", v21 - value >= -1e-9, " + _CORNER.format(2, 2) + """], lambda b: b::INT) AS b
  FROM (SELECT *, v11 AS value FROM near)),
code AS (
  SELECT frame, label, CASE WHEN list_sum(list_transform(range(1, 9), lambda i: abs(b[i] - b[i % 8 + 1]))) <= 2 THEN list_sum(b) ELSE 9 END AS code
  FROM bits),
share AS (SELECT frame, label, code, count(*) / sum(count(*)) OVER (PARTITION BY frame, label) AS p, sum(count(*)) OVER (PARTITION BY frame, label) AS px FROM code GROUP BY frame, label, code),
stat AS (
  SELECT frame, label, coalesce(sum(p) FILTER (code = 0), 0) AS hi, coalesce(sum(p) FILTER (code = 8), 0) AS lo, sum(-p * ln(p + 1e-12)) AS en
  FROM share WHERE px >= 8 GROUP BY frame, label)
SELECT frame, label, round(hi, 6) AS localmax, round(lo, 6) AS localmin, round(en, 6) AS entropy
FROM (SELECT DISTINCT frame, label FROM mask_pixels) LEFT JOIN stat USING (frame, label)"""
#: Pixels of rings inside the image that no other nucleus is within two steps of.
_APART = """
SELECT frame, label, count(*) AS n, sum(y * 96 + x)::BIGINT AS places
FROM {ring} r
WHERE y BETWEEN 0 AND 39 AND x BETWEEN 0 AND 95
  AND NOT EXISTS (SELECT 1 FROM mask_pixels m WHERE m.frame = r.frame AND m.label <> r.label AND abs(m.x - r.x) + abs(m.y - r.y) <= 2)
GROUP BY frame, label"""


def _places(ring, s, d):
    inside = ring.join(fx.frames(s, d), ["movie_id", "frame"]).where(px.inside())
    return inside.groupBy("movie_id", "frame", "label").agg(F.count("*").alias("n"), F.sum(F.col("y") * 96 + F.col("x")).alias("places"))


QUERIES = {
    "g1_centroids": (lambda s, d: rounded(px.centroids(fx.mask_pixels(s, d)), "x", "y"), duck("SELECT frame, label, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM mask_pixels GROUP BY ALL", True)),
    "g2_areas": (lambda s, d: px.areas(fx.mask_pixels(s, d), 0.25), duck("SELECT frame, label, count(*) * 0.25::DOUBLE AS area FROM mask_pixels GROUP BY ALL", True)),
    "g3_correspondence": (lambda s, d: rounded(px.correspondence(_tracks(s, d), fx.mask_pixels(s, d), fx.frames(s, d)), "share"), duck(_T + " SELECT (frame // 100000)::BIGINT AS movie_id, round(avg((coalesce(label, 0) = track_id)::INT::DOUBLE), 6) AS share FROM ob LEFT JOIN mask_pixels USING (frame, y, x) GROUP BY 1", True)),
    "g4_relabelled": (lambda s, d: px.relabelled(fx.mask_pixels(s, d), _tracks(s, d)).groupBy("movie_id", "frame", "label").agg(F.count("*").alias("n")), duck(_T + ", nm AS (SELECT frame, label, max(track_id) AS t FROM ob JOIN mask_pixels USING (frame, y, x) GROUP BY ALL) SELECT m.frame, coalesce(t, m.label) AS label, count(*) AS n FROM mask_pixels m LEFT JOIN nm ON m.frame = nm.frame AND m.label = nm.label GROUP BY ALL", True)),
    "g5_eroded": (lambda s, d: px.eroded(fx.mask_pixels(s, d)).select("movie_id", "frame", "label", "y", "x"), duck(_BOUND + " SELECT frame, label, y, x FROM n4 WHERE k = 4", True)),
    "g6_perimeters": (lambda s, d: rounded(px.perimeters(fx.mask_pixels(s, d)), "perimeter"), duck(_PERIM + " SELECT frame, label, round(perimeter, 6) AS perimeter FROM pe", True)),
    "g7_g9_morphometry": (
        lambda s, d: rounded(px.morphometry(fx.mask_pixels(s, d)).select("movie_id", "frame", "label", *_MORPH), *_MORPH),
        duck(_NII + " SELECT frame, label, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MORPH) + " FROM ni", True),
    ),
    "g8_radius_ratio": (lambda s, d: rounded(px.radius_ratio(fx.mask_pixels(s, d)), "radius_ratio"), duck(_BOUND + _RR + " SELECT frame, label, round(radius_ratio, 6) AS radius_ratio FROM rr", True)),
    "g10_solidity": (lambda s, d: rounded(px.solidity(fx.mask_pixels(s, d)), "solidity"), duck(_SOLID + " SELECT frame, label, round(solidity, 6) AS solidity FROM so", True)),
    "g11_components": (
        lambda s, d: px.split_blobs(fx.mask_pixels(s, d)).select("movie_id", "frame", "label", "part", "n", "keeps"),
        duck(", c(frame, label, y, x, part) AS (SELECT frame, label, y, x, y * 1000000 + x FROM mask_pixels UNION SELECT n.frame, n.label, n.y, n.x, c.part FROM c JOIN mask_pixels n ON c.frame = n.frame AND c.label = n.label AND abs(c.x - n.x) <= 1 AND abs(c.y - n.y) <= 1 WHERE c.part < n.y * 1000000 + n.x), p AS (SELECT frame, label, y, x, min(part) AS part FROM c GROUP BY ALL), z AS (SELECT frame, label, part, count(*) AS n FROM p GROUP BY ALL) SELECT frame, label, part, n, row_number() OVER (PARTITION BY frame, label ORDER BY n DESC, part) = 1 AS keeps FROM z", True, True),
    ),
    "g12_rings": (lambda s, d: px.rings(fx.mask_pixels(s, d)).join(fx.frames(s, d), ["movie_id", "frame"]).where(px.inside()).groupBy("movie_id", "frame", "label").agg(F.count("*").alias("n")), duck(_RING + " SELECT frame, label, count(*) AS n FROM ring2 WHERE y BETWEEN 0 AND 39 AND x BETWEEN 0 AND 95 GROUP BY ALL", True)),
    "g13_ellipse_rings": (lambda s, d: px.ellipse_rings(fx.mask_pixels(s, d)).join(fx.frames(s, d), ["movie_id", "frame"]).where(px.inside()).groupBy("movie_id", "frame", "label").agg(F.count("*").alias("n"), F.sum(F.col("y") * 96 + F.col("x")).alias("places")), duck(_ELLIPSE + " SELECT frame, label, count(*) AS n, sum(y * 96 + x)::BIGINT AS places FROM er GROUP BY ALL", True)),
    "g7_orientation": (
        lambda s, d: rounded(px.orientations(fx.mask_pixels(s, d)), "orientation"),
        duck("""
, mo AS (
  SELECT frame, label, (count(*) * sum(y * y) - sum(y) * sum(y) - count(*) * sum(x * x) + sum(x) * sum(x))::DOUBLE AS away,
         (count(*) * sum(x * y) - sum(x) * sum(y))::DOUBLE AS shared
  FROM mask_pixels GROUP BY frame, label)
SELECT frame, label, round(CASE WHEN away = 0 THEN CASE WHEN shared > 0 THEN pi() / 4 ELSE -pi() / 4 END ELSE atan2(2 * shared, away) / 2 END, 6) AS orientation
FROM mo""", True),
    ),
    "g12_rings_clear": (
        lambda s, d: _places(px.rings(fx.mask_pixels(s, d), neighbor_gap=2), s, d),
        duck(_RING + _APART.format(ring="ring2"), True),
    ),
    "g13_ellipse_rings_clear": (
        lambda s, d: _places(px.ellipse_rings(fx.mask_pixels(s, d), neighbor_gap=2), s, d),
        duck(_ELLIPSE + _APART.format(ring="er"), True),
    ),
    "g14_background": (
        lambda s, d: rounded(it.background(fx.channel_pixels(s, d), fx.mask_pixels(s, d), fx.frames(s, d), "far_from_cells", 6).select("movie_id", "frame", "bg", "free"), "bg", "free"),
        duck(_BG + ", ds AS (SELECT c.frame, c.y, c.x, any_value(c.value) AS value, min(abs(c.x - m.x) + abs(c.y - m.y)) AS d FROM channel_pixels c JOIN mask_pixels m ON c.frame = m.frame GROUP BY ALL), fb AS (SELECT frame, median(value) FILTER (d > 6) AS b, count(*) FILTER (d > 6) / count(*) AS free FROM ds GROUP BY frame) SELECT fb.frame, round(coalesce(b, bg), 6) AS bg, round(free, 6) AS free FROM fb JOIN bg USING (frame)", True),
    ),
    "g15_compartments": (
        lambda s, d: rounded(_stats(s, d).select("movie_id", "frame", "label", "nuc_mean", "nuc_median", "nuc_std", "nuc_p90", "nuc_px", "ring_mean", "ring_median", "ring_px", "cell_sum"), "nuc_mean", "nuc_median", "nuc_std", "nuc_p90", "ring_mean", "ring_median", "cell_sum"),
        duck(_STATS + " SELECT frame, label, round(nuc_mean, 6) AS nuc_mean, round(nuc_median, 6) AS nuc_median, round(nuc_std, 6) AS nuc_std, round(nuc_p90, 6) AS nuc_p90, nuc_px, round(ring_mean, 6) AS ring_mean, round(ring_median, 6) AS ring_median, ring_px, round(cell_sum, 6) AS cell_sum FROM st", True),
    ),
    "g14_region_background": (
        lambda s, d: rounded(it.region_background(fx.channel_pixels(s, d), _drawn(s, d)).select("movie_id", "frame", "bg", F.round("free", 9).alias("free"))),
        duck(""", dn AS (SELECT frame, y, x FROM mask_pixels WHERE label % 5 = 2 AND frame % 3 < 2), tt AS (SELECT frame, count(*) AS n FROM channel_pixels GROUP BY frame),
md AS (SELECT frame, median(value) AS bg, count(*) AS k FROM channel_pixels JOIN dn USING (frame, y, x) GROUP BY frame) SELECT frame, coalesce(bg, 0) AS bg, round(coalesce(k, 0) / n, 9) AS free FROM tt LEFT JOIN md USING (frame)""", True),
    ),
    "g16_g23_ratios": (lambda s, d: rounded(it.readout(_stats(s, d)).select("movie_id", "frame", "track_id", "cn", "nc"), "cn", "nc"), duck(_STATS + f" SELECT frame, label AS track_id, round({_CN}, 6) AS cn, round(1 / ({_CN}), 6) AS nc FROM st", True)),
    "g17_crowded": (lambda s, d: it.crowded(it.background(fx.channel_pixels(s, d), fx.mask_pixels(s, d), fx.frames(s, d)), 0.78).select("movie_id", "frame"), duck(_BG + " SELECT frame FROM bg WHERE n / (40 * 96) < 0.78", True)),
    "g18_ring_sweep": (
        lambda s, d: rounded(it.ring_sweep(fx.channel_pixels(s, d), fx.mask_pixels(s, d), it.background(fx.channel_pixels(s, d), fx.mask_pixels(s, d), fx.frames(s, d))), "cn", "missing"),
        duck(_BOUND + _BG + """, fs AS (SELECT frame, row_number() OVER (PARTITION BY frame // 100000 ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY frame // 100000) AS n FROM bg), sf AS (SELECT frame, i FROM fs WHERE n <= 8 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(8)) AS k) WHERE i = k * (n - 1) // 7)),
off AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-13, 14)) AS i) a CROSS JOIN (SELECT unnest(range(-13, 14)) AS i) b WHERE abs(a.i) + abs(b.i) <= 13),
ds AS (SELECT frame, label, y + dy AS y, x + dx AS x, min(abs(dy) + abs(dx)) AS d FROM bd JOIN sf USING (frame) CROSS JOIN off GROUP BY ALL), ou AS (SELECT * FROM ds ANTI JOIN mask_pixels USING (frame, y, x)),
ws AS (SELECT unnest([2, 3, 4, 6, 8, 10, 12])::BIGINT AS width), cv AS (SELECT frame, y, x, greatest(value - bg, 0) AS v FROM channel_pixels JOIN bg USING (frame) JOIN sf USING (frame)),
rg AS (SELECT frame, label, width, median(v) AS ring, count(*) AS ring_px FROM ou JOIN ws ON d > 1 AND d <= width + 1 JOIN cv USING (frame, y, x) GROUP BY ALL), nu AS (SELECT frame, label, median(v) AS nuc, count(*) AS nuc_px FROM mask_pixels JOIN cv USING (frame, y, x) GROUP BY ALL),
al AS (SELECT frame, width, coalesce(ring_px, 0) AS ring_px, nuc_px, CASE WHEN ring > 0 AND nuc > 0 THEN ring / nuc END AS cn FROM nu CROSS JOIN ws LEFT JOIN rg USING (frame, label, width))
SELECT (frame // 100000)::BIGINT AS movie_id, 'gfp' AS channel, width, round(median(cn), 6) AS cn, median(ring_px)::DOUBLE AS ring_px, median(nuc_px)::DOUBLE AS nuc_px, round(avg((cn IS NULL)::INT::DOUBLE), 6) AS missing, count(*) AS n FROM al GROUP BY 1, width""", True),
    ),
    "g19_quantised": (
        lambda s, d: _levels(s, d).groupBy("movie_id", "frame", "label", F.col("q").cast("long").alias("q")).agg(F.count("*").alias("n")),
        duck(_BG + ", iv AS (SELECT frame, label, greatest(value - bg, 0) AS value FROM channel_pixels JOIN mask_pixels USING (frame, y, x) JOIN bg USING (frame)), e AS (SELECT frame // 100000 AS mv, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM iv GROUP BY 1) SELECT frame, label, (round_even(greatest(0, least(1, (value - lo) / (hi - lo))) * 14, 0) + 1)::BIGINT AS q, count(*) AS n FROM iv JOIN e ON mv = frame // 100000 GROUP BY ALL", True),
    ),
    "g20_haralick": (
        lambda s, d: it.haralick(_levels(s, d)).select("movie_id", "frame", "label", *(F.round(c, 9).alias(c) for c in ("contrast", "energy", "homogeneity", "entropy"))),  # six digits can be a tie
        duck(_BG + _TEXTURE + """
SELECT z.frame, z.label, round(CASE WHEN any_value(px) >= 8 THEN sum(contrast) / 4 END, 9) AS contrast, round(CASE WHEN any_value(px) >= 8 THEN sum(energy) / 4 END, 9) AS energy, round(CASE WHEN any_value(px) >= 8 THEN sum(homogeneity) / 4 END, 9) AS homogeneity, round(CASE WHEN any_value(px) >= 8 THEN sum(entropy) / 4 END, 9) AS entropy FROM z LEFT JOIN s ON s.frame = z.frame AND s.label = z.label GROUP BY ALL""", True),
    ),
    "g21_lbp": (lambda s, d: rounded(it.local_binary_patterns(fx.channel_pixels(s, d), fx.mask_pixels(s, d)).select("movie_id", "frame", "label", "localmax", "localmin", "entropy"), "localmax", "localmin", "entropy"), duck(_PATTERNS, True)),
    "g22_signal_drift": (lambda s, d: rounded(it.signal_drift(fx.channel_pixels(s, d), fx.mask_pixels(s, d)).select("movie_id", "frame", "median", "drift"), "drift"), duck(", p AS (SELECT frame, median(value) AS median FROM channel_pixels JOIN mask_pixels USING (frame, y, x) GROUP BY frame) SELECT frame, median, round(median / b, 6) AS drift FROM p LEFT JOIN (SELECT frame // 100000 AS mv, arg_min(median, frame) AS b FROM p WHERE median > 0 GROUP BY 1) ON mv = frame // 100000", True)),
    "g24_foci": (
        lambda s, d: rounded(it.foci(_stats(s, d), it.haralick(_levels(s, d)), it.signal_drift(fx.channel_pixels(s, d), fx.mask_pixels(s, d))).select("movie_id", "frame", "label", "nuc_median", "cv", "contrast", "drift"), "nuc_median", "cv", "contrast", "drift"),
        duck(_STATS + _TEXTURE + """, tx AS (SELECT z.frame, z.label, CASE WHEN any_value(px) >= 8 THEN sum(contrast) / 4 END AS contrast FROM z LEFT JOIN s USING (frame, label) GROUP BY ALL), dr AS (SELECT frame, median(value) AS median FROM channel_pixels JOIN mask_pixels USING (frame, y, x) GROUP BY frame)
SELECT st.frame, st.label, round(nuc_median, 6) AS nuc_median, round(nuc_std / nullif(nuc_median, 0), 6) AS cv, round(contrast, 6) AS contrast, round(dr.median / b, 6) AS drift FROM st LEFT JOIN tx USING (frame, label) LEFT JOIN dr USING (frame) LEFT JOIN (SELECT frame // 100000 AS mv, arg_min(median, frame) AS b FROM dr WHERE median > 0 GROUP BY 1) ON mv = st.frame // 100000""", True),
    ),
    "g25_clipped_source": (
        lambda s, d: it.clipped_source(_stretched(s, d).unionByName(fx.channel_pixels(s, d))),
        duck(", ch AS (SELECT frame // 100000 AS movie_id, 'stretched' AS channel, greatest(0, least(255, (value - 120) * 3)) AS value FROM channel_pixels UNION ALL SELECT frame // 100000, channel, value FROM channel_pixels) SELECT movie_id, channel, max(value) <= 255 AND avg((value <= 0)::INT) > 0.01 AND avg((value >= 255)::INT) > 0.01 AS clipped FROM ch GROUP BY ALL", True),
    ),
    "g26_alignment": (
        lambda s, d: it.alignment(_drifted(s, d), fx.channel_pixels(s, d)).select("movie_id", "frame", *(F.round(c, 4).alias(c) for c in ("dy", "dx", "offset"))),
        duck(_DRIFTED + _PHASE + ' SELECT frame, round(dy, 4) AS dy, round(dx, 4) AS dx, round(sqrt(dy * dy + dx * dx), 4) AS "offset" FROM sh', True),
    ),
    "g26_source_problems": (
        lambda s, d: it.source_problems(_drifted(s, d).unionByName(fx.channel_pixels(s, d)), fx.channel_pixels(s, d), fx.frames(s, d)),
        duck(_DRIFTED + _PHASE + " SELECT DISTINCT (frame // 100000)::BIGINT AS movie_id, 'drifted' AS channel, 'misaligned' AS problem FROM sh WHERE sqrt(dy * dy + dx * dx) > 2", True),
    ),
    "a6_shape_outliers": (
        lambda s, d: anomaly.area_outliers(px.morphometry(fx.mask_pixels(s, d)).join(px.solidity(fx.mask_pixels(s, d)), px.OBJECT), _STRICT),
        duck(_SOLID + """, mo AS (SELECT frame, label, count(*)::DOUBLE AS area, var_pop(y) AS a, var_pop(x) AS c, covar_pop(x, y) AS b FROM mask_pixels GROUP BY ALL),
l AS (SELECT *, CASE WHEN a + c > 0 THEN sqrt(1 - greatest((a + c) / 2 - sqrt(4 * b * b + power(a - c, 2)) / 2, 0) / ((a + c) / 2 + sqrt(4 * b * b + power(a - c, 2)) / 2)) ELSE 0 END AS ecc FROM mo JOIN so USING (frame, label)),
md AS (SELECT frame, median(area) AS med, stddev_pop(area) AS std FROM l GROUP BY frame), ma AS (SELECT frame, median(abs(area - med)) AS mad FROM l JOIN md USING (frame) GROUP BY frame),
r AS (SELECT frame, label, CASE WHEN mad > 0 THEN (area - med) / (1.4826 * mad) > 0.6 WHEN std > 0 THEN area > med + 0.6 * std ELSE false END AS o, solidity < 0.93 AS s, ecc > 0.75 AS e FROM l JOIN md USING (frame) JOIN ma USING (frame))
SELECT frame, label, concat_ws('; ', CASE WHEN o THEN 'area outlier' END, CASE WHEN s THEN 'low solidity' END, CASE WHEN e THEN 'elongated' END) AS reason FROM r WHERE o OR s OR e""", True),
    ),
    "q18_area_nii_points": (
        lambda s, d: rounded(st.area_nii_points(px.centroids(fx.mask_pixels(s, d)).select("movie_id", "frame", F.col("label").alias("track_id"), F.expr(_OUTCOME).alias("outcome")), px.morphometry(fx.mask_pixels(s, d)), 0.5), "area", "nii"),
        duck(_NII + " SELECT frame, label AS track_id, round(area * 0.25, 6) AS area, round(nii, 6) AS nii, CASE label % 3 WHEN 0 THEN 'Mitosis' WHEN 1 THEN 'none' ELSE 'Exit' END AS final_outcome FROM ni WHERE nii IS NOT NULL", True),
    ),
    "f10_morphology_series": (
        lambda s, d: rounded(px.morphology_series(fx.mask_pixels(s, d)), "perimeter", "circularity"),
        duck(_PERIM + ", ar AS (SELECT frame, label, count(*)::DOUBLE AS area_px FROM mask_pixels GROUP BY ALL) SELECT frame, label AS track_id, area_px, round(coalesce(perimeter, 0), 6) AS perimeter, CASE WHEN perimeter > 0 THEN round(4 * pi() * area_px / power(perimeter, 2), 6) END AS circularity FROM ar LEFT JOIN pe USING (frame, label)", True),
    ),
}
