"""Queries and oracles of the edit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..operators import edits as ed
from ..operators import pixels as px
from . import fixtures as fx
from .fixtures import duck
from .q_trajectory import rounded

_KEYS = ("event_id", "track_id", "parent_id", "outcome")


def _t(s, d) -> DataFrame:
    return fx.tracks(s, d)


def _some(s, d, where: str) -> DataFrame:
    return _t(s, d).where(where).select("movie_id", "track_id").distinct()


def _no_mask(s, d) -> DataFrame:
    return _t(s, d).select("movie_id", "frame", F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x"), F.col("track_id").alias("label"))


def _observed(s, d) -> DataFrame:
    """Centroids without label 5 in odd frames, and a label 99 that no pixel has."""
    c = px.centroids(fx.mask_pixels(s, d)).where("NOT (label = 5 AND frame % 2 = 1)")
    rows = c.select("movie_id", "frame", F.col("label").alias("track_id"), F.lit(-1).cast("long").alias("parent_id"), F.lit(0.0).alias("pos_x"), F.lit(0.0).alias("pos_y"), F.lit("Exit").alias("outcome"))
    return rows.unionByName(rows.withColumn("track_id", F.lit(99).cast("long")).distinct())


def _labelled(s, d) -> DataFrame:
    """Centroids as observations; label 7 belongs to track 107 in even frames."""
    c = px.centroids(fx.mask_pixels(s, d))
    track = F.when((F.col("label") == 7) & (F.col("frame") % 2 == 0), 107).otherwise(F.col("label"))
    return c.select("movie_id", "frame", track.alias("track_id"), F.col("label").alias("continuous_label"), F.lit(-1).cast("long").alias("parent_id"), F.lit("").alias("outcome"), F.col("x").alias("pos_x"), F.col("y").alias("pos_y"))


_DISSOLVE = """, sp AS (SELECT track_id, min(frame) AS f FROM {t} GROUP BY track_id), bad AS (SELECT l.parent_id AS p FROM (SELECT DISTINCT parent_id, track_id FROM {t} WHERE parent_id > 0 AND parent_id <> track_id) l LEFT JOIN sp c ON c.track_id = l.track_id LEFT JOIN sp m ON m.track_id = l.parent_id GROUP BY l.parent_id HAVING bool_or(m.f IS NULL OR c.f <= m.f))"""
_AFTER = " SELECT event_id, track_id, CASE WHEN parent_id = track_id OR parent_id IN (SELECT p FROM bad) THEN -1 ELSE parent_id END AS parent_id, CASE WHEN outcome = 'Mitosis' AND track_id IN (SELECT p FROM bad) THEN '' ELSE outcome END AS outcome FROM {t}"
_MASK_COUNT = lambda m: m.groupBy("frame", "label").agg(F.count("*").alias("n"))
#: Ids in use by movie of the label images, and the free ones in order.
_FREE_LABELS = ", us AS ({used}), fi AS (SELECT mv, id, row_number() OVER (PARTITION BY mv ORDER BY id) AS ord FROM (SELECT DISTINCT mv FROM us) CROSS JOIN (SELECT unnest(range(1, 2000)) AS id) WHERE (mv, id) NOT IN (SELECT mv, id FROM us))"
_FREE = ", used AS (SELECT DISTINCT track_id AS id FROM tracks UNION SELECT parent_id FROM tracks WHERE parent_id > 0), free AS (SELECT id, row_number() OVER (ORDER BY id) AS ord FROM (SELECT unnest(range(1, 100000)) AS id) WHERE id NOT IN (SELECT id FROM used))"

# 6 and 9 go on as 26 and 29, unrelated tracks; 5 is a daughter of 2 and goes on as its mother: the division of 2 was false.
_MERGE = """, hp AS (SELECT track_id AS t, max(parent_id) AS h FROM tracks WHERE track_id IN (26, 29) GROUP BY track_id), gp AS (SELECT coalesce(max(parent_id) FILTER (parent_id > 0), -1) AS g FROM tracks WHERE track_id = 2),
kin AS (SELECT count(*) > 0 AS k FROM tracks WHERE track_id = 5 AND parent_id = 2),
dt AS (SELECT event_id, frame, track_id, outcome, CASE WHEN k AND (parent_id IN (2, 5) OR track_id IN (SELECT track_id FROM tracks WHERE parent_id = 2 AND track_id <> 5)) THEN -1 ELSE parent_id END AS p FROM tracks CROSS JOIN kin),
rn AS (SELECT event_id, frame, CASE WHEN track_id IN (6, 9) THEN track_id + 20 WHEN track_id = 5 THEN 2 ELSE track_id END AS track_id, outcome, CASE WHEN track_id IN (6, 9) THEN coalesce(h, -1) ELSE p END AS p FROM dt LEFT JOIN hp ON t = track_id + 20 AND track_id IN (6, 9)),
mg AS (SELECT event_id, frame, track_id, CASE WHEN track_id = 2 AND k THEN g WHEN p IN (6, 9) THEN CASE WHEN track_id = p + 20 THEN -1 ELSE p + 20 END ELSE p END AS parent_id, CASE WHEN track_id = 2 AND k AND outcome = 'Mitosis' THEN '' ELSE outcome END AS outcome FROM rn CROSS JOIN gp CROSS JOIN kin)"""
# 2 and 3 exchange ids, 4 goes on as a new track.
_SWAP = _FREE + """, sp0 AS (SELECT track_id, min(frame) AS f FROM tracks GROUP BY track_id), nw AS (SELECT min(id) AS id FROM free),
fo AS (SELECT t.*, CASE WHEN {follow} AND parent_id IN (2, 3) THEN 5 - parent_id WHEN {follow} AND parent_id = 4 THEN id ELSE parent_id END AS p, id, track_id IN (2, 3, 4) AND {when} AS mv FROM tracks t JOIN sp0 USING (track_id) CROSS JOIN nw),
mg AS (SELECT event_id, frame, CASE WHEN mv AND track_id = 4 THEN id WHEN mv THEN 5 - track_id ELSE track_id END AS track_id, CASE WHEN mv THEN -1 ELSE p END AS parent_id, CASE WHEN mv THEN '' ELSE outcome END AS outcome FROM fo)"""


_GHOSTS = ", si AS (SELECT parent_id AS track_id, min(frame) AS since FROM tracks WHERE parent_id > 0 GROUP BY parent_id), gh AS (SELECT track_id, row_number() OVER (ORDER BY track_id) AS ord FROM (SELECT DISTINCT track_id FROM tracks JOIN si USING (track_id) WHERE frame >= since)), m AS (SELECT track_id, id AS new_id FROM gh JOIN free USING (ord))"
_ORPHANS = ", o0 AS (SELECT frame, label, avg(x) AS cx, frame // 100000 AS mv FROM mask_pixels WHERE label = 5 AND frame % 2 = 1 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY mv ORDER BY frame, label) AS ord FROM o0)" + _FREE_LABELS.format(used="SELECT DISTINCT frame // 100000 AS mv, label AS id FROM mask_pixels UNION SELECT frame // 100000, 99 FROM mask_pixels")


def _merges(s, d) -> DataFrame:
    to = F.when(F.col("track_id") == 5, 2).otherwise(F.col("track_id") + 20)
    return _some(s, d, "track_id IN (5, 6, 9)").select("movie_id", F.col("track_id").alias("a"), to.cast("long").alias("b"))


def _swaps(s, d) -> DataFrame:
    return _some(s, d, "track_id IN (2, 4)").select("movie_id", F.col("track_id").alias("a"), F.when(F.col("track_id") == 2, 3).otherwise(0).cast("long").alias("b"), F.lit(100).cast("long").alias("frame"))


QUERIES = {
    "e1_flags": (
        lambda s, d: ed.apply_flags(_t(s, d), _some(s, d, "track_id % 4 = 0").withColumn("flag", F.when(F.col("track_id") % 8 == 0, F.lit("Exit")))).select("event_id", "outcome"),
        duck(" SELECT event_id, CASE WHEN track_id % 8 = 0 THEN 'Exit' WHEN track_id % 4 = 0 THEN '' ELSE outcome END AS outcome FROM tracks"),
    ),
    "e2_link": (
        lambda s, d: ed.link(_t(s, d), _some(s, d, "track_id IN (7, 14, 21, 28)").select("movie_id", F.when(F.col("track_id") == 14, 7777).when(F.col("track_id") == 21, 28).otherwise(1).cast("long").alias("mother"), F.col("track_id").alias("daughter")).where("daughter <> 28"), force=True).select(*_KEYS),
        duck(""", sp AS (SELECT track_id, min(frame) AS f FROM tracks GROUP BY track_id), pl AS (SELECT * FROM (VALUES (1, 7), (7777, 14), (28, 21)) t(m, dd)), ok AS (SELECT m, dd FROM pl JOIN sp a ON a.track_id = m JOIN sp b ON b.track_id = dd WHERE m <> dd AND b.f > a.f),
l AS (SELECT DISTINCT parent_id AS m, track_id FROM tracks WHERE parent_id > 0 AND (parent_id, track_id) NOT IN (SELECT m, dd FROM ok)),
k AS (SELECT m, track_id, row_number() OVER (PARTITION BY m ORDER BY f DESC, track_id DESC) AS r, count(*) OVER (PARTITION BY m) AS n FROM l JOIN sp USING (track_id)), ev AS (SELECT track_id FROM k WHERE r = 1 AND n >= 2 AND m IN (SELECT m FROM ok))
SELECT event_id, track_id, coalesce((SELECT max(m) FROM ok WHERE dd = track_id), CASE WHEN track_id IN (SELECT track_id FROM ev) THEN -1 ELSE parent_id END)::BIGINT AS parent_id, CASE WHEN track_id IN (SELECT m FROM ok) THEN 'Mitosis' ELSE outcome END AS outcome FROM tracks"""),
    ),
    "e3_unlink": (
        lambda s, d: ed.unlink(_t(s, d), _some(s, d, "track_id % 2 = 0")).select(*_KEYS),
        duck(", n AS (SELECT *, CASE WHEN track_id % 2 = 0 THEN -1 ELSE parent_id END AS p FROM tracks) SELECT event_id, track_id, p AS parent_id, CASE WHEN outcome = 'Mitosis' AND track_id IN (SELECT parent_id FROM tracks WHERE track_id % 2 = 0 AND parent_id > 0) AND track_id NOT IN (SELECT p FROM n WHERE p > 0) THEN '' ELSE outcome END AS outcome FROM n"),
    ),
    "e4_repoint": (
        lambda s, d: ed.repoint(_t(s, d), _some(s, d, "track_id = 2").select("movie_id", F.col("track_id").alias("old"), F.lit(5).cast("long").alias("new"))).select(*_KEYS),
        duck(" SELECT event_id, track_id, CASE WHEN parent_id = 2 THEN CASE WHEN track_id = 5 THEN -1 ELSE 5 END ELSE parent_id END AS parent_id, outcome FROM tracks"),
    ),
    "e12_harmonised": (
        lambda s, d: ed.harmonised(_labelled(s, d), fx.mask_pixels(s, d))[1].groupBy("movie_id", "frame", "label").agg(F.count("*").alias("n"), F.sum(F.col("y") * 96 + F.col("x")).alias("places")),
        duck(", c(frame, label, y, x, part) AS (SELECT frame, label, y, x, y * 1000000 + x FROM mask_pixels UNION SELECT n.frame, n.label, n.y, n.x, c.part FROM c JOIN mask_pixels n ON c.frame = n.frame AND c.label = n.label AND abs(c.x - n.x) <= 1 AND abs(c.y - n.y) <= 1 WHERE c.part < n.y * 1000000 + n.x), p AS (SELECT frame, label, y, x, min(part) AS part FROM c GROUP BY ALL), z AS (SELECT frame, label, part, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY n DESC, part) AS r FROM z), e AS (SELECT frame, label, part, frame // 100000 AS mv, row_number() OVER (PARTITION BY frame // 100000 ORDER BY frame, label, part) AS ord FROM k WHERE r > 1)"
             + _FREE_LABELS.format(used="SELECT DISTINCT frame // 100000 AS mv, label AS id FROM mask_pixels UNION SELECT frame // 100000, 107 FROM mask_pixels WHERE label = 7 AND frame % 2 = 0")
             + ", m AS (SELECT p.frame, coalesce(id, CASE WHEN p.label = 7 AND p.frame % 2 = 0 THEN 107 END, p.label)::BIGINT AS label, y, x FROM p LEFT JOIN e USING (frame, label, part) LEFT JOIN fi USING (mv, ord)) SELECT frame, label, count(*) AS n, sum(y * 96 + x)::BIGINT AS places FROM m GROUP BY ALL", True, True),
    ),
    "e5_dissolve_invalid": (lambda s, d: ed.dissolve_invalid(_t(s, d)).select(*_KEYS), duck(_DISSOLVE.format(t="tracks") + _AFTER.format(t="tracks"))),
    "e6_merge": (
        lambda s, d: ed.merge(_t(s, d), _no_mask(s, d), _merges(s, d))[0].select(*_KEYS),
        duck(_MERGE + _DISSOLVE.format(t="mg") + _AFTER.format(t="mg")),
    ),
    "e6_merge_pixels": (
        lambda s, d: _MASK_COUNT(ed.merge(_t(s, d), _no_mask(s, d), _merges(s, d))[1]),
        duck(" SELECT frame, CASE WHEN track_id IN (6, 9) THEN track_id + 20 WHEN track_id = 5 THEN 2 ELSE track_id END AS label, count(*) AS n FROM tracks GROUP BY ALL"),
    ),
    "e7_swap_from": (
        lambda s, d: ed.swap_from(_t(s, d), _no_mask(s, d), _swaps(s, d))[0].select(*_KEYS),
        duck(_SWAP.format(when="frame >= 100", follow="f >= 100") + _DISSOLVE.format(t="mg") + _AFTER.format(t="mg")),
    ),
    "e7_swap_pixels": (
        lambda s, d: _MASK_COUNT(ed.swap_from(_t(s, d), _no_mask(s, d), _swaps(s, d))[1]),
        duck(_FREE + " SELECT frame, CASE WHEN frame >= 100 AND track_id IN (2, 3) THEN 5 - track_id WHEN frame >= 100 AND track_id = 4 THEN (SELECT min(id) FROM free) ELSE track_id END::BIGINT AS label, count(*) AS n FROM tracks GROUP BY ALL"),
    ),
    "e8_local_swap": (
        lambda s, d: ed.swap_from(_t(s, d), _no_mask(s, d), _swaps(s, d), True)[0].select(*_KEYS),
        duck(_SWAP.format(when="frame = 100", follow="false") + _DISSOLVE.format(t="mg") + _AFTER.format(t="mg")),
    ),
    "e8_local_swap_pixels": (
        lambda s, d: _MASK_COUNT(ed.swap_from(_t(s, d), _no_mask(s, d), _swaps(s, d), True)[1]),
        duck(_FREE + " SELECT frame, CASE WHEN frame = 100 AND track_id IN (2, 3) THEN 5 - track_id WHEN frame = 100 AND track_id = 4 THEN (SELECT min(id) FROM free) ELSE track_id END::BIGINT AS label, count(*) AS n FROM tracks GROUP BY ALL"),
    ),
    "e9_relabel": (
        lambda s, d: ed.relabel(_t(s, d), _no_mask(s, d), _some(s, d, "track_id IN (2, 6, 9)"))[0].select(*_KEYS),
        duck(_FREE + ", nm AS (SELECT o.track_id AS old, id AS new FROM (SELECT track_id, row_number() OVER (ORDER BY track_id) AS ord FROM (SELECT DISTINCT track_id FROM tracks WHERE track_id IN (2, 6, 9))) o JOIN free USING (ord)), mg AS (SELECT event_id, frame, coalesce(a.new, track_id) AS track_id, CASE WHEN a.new IS NOT NULL THEN -1 ELSE coalesce(b.new, parent_id) END AS parent_id, CASE WHEN a.new IS NOT NULL THEN '' ELSE outcome END AS outcome FROM tracks LEFT JOIN nm a ON a.old = track_id LEFT JOIN nm b ON b.old = parent_id)" + _DISSOLVE.format(t="mg") + _AFTER.format(t="mg")),
    ),
    "e9_e15_relabel": (
        lambda s, d: ed.minted_ids(_t(s, d), _some(s, d, "track_id <= 12").withColumn("ord", F.col("track_id"))).select("movie_id", "track_id", "new_id"),
        duck(_FREE + " SELECT DISTINCT movie_id, track_id, id AS new_id FROM tracks JOIN free ON ord = track_id WHERE track_id <= 12"),
    ),
    "e10_delete": (
        lambda s, d: ed.delete(_t(s, d), _no_mask(s, d), _some(s, d, "track_id IN (3, 4)"))[0].select(*_KEYS),
        duck(", dl AS (SELECT event_id, frame, track_id, CASE WHEN parent_id IN (3, 4) THEN -1 ELSE parent_id END AS parent_id, outcome FROM tracks WHERE track_id NOT IN (3, 4))" + _DISSOLVE.format(t="dl") + _AFTER.format(t="dl")),
    ),
    "e10_delete_pixels": (
        lambda s, d: _MASK_COUNT(ed.delete(_t(s, d), _no_mask(s, d), _t(s, d).where("track_id IN (3, 4) AND frame % 2 = 0"))[1]),
        duck(" SELECT frame, track_id AS label, count(*) AS n FROM tracks WHERE NOT (track_id IN (3, 4) AND frame % 2 = 0) GROUP BY frame, track_id"),
    ),
    "e11_synced": (
        lambda s, d: rounded(ed.synced(_observed(s, d), fx.mask_pixels(s, d)).select("movie_id", "frame", "track_id", "parent_id", "outcome", "pos_x", "pos_y", "done"), "pos_x", "pos_y"),
        duck(" SELECT frame, label AS track_id, -1 AS parent_id, CASE WHEN label = 5 AND frame % 2 = 1 THEN '' ELSE 'Exit' END AS outcome, round(avg(x), 6) AS pos_x, round(avg(y), 6) AS pos_y, CASE WHEN label = 5 AND frame % 2 = 1 THEN 'added' ELSE 'updated' END AS done FROM mask_pixels GROUP BY frame, label", True),
    ),
    "e13_rescued_orphans": (
        lambda s, d: rounded(ed.rescued_orphans(_observed(s, d), fx.mask_pixels(s, d))[0].select("movie_id", "frame", "track_id", "outcome", "pos_x"), "pos_x"),
        duck(_ORPHANS + ", rw AS (SELECT DISTINCT frame, label AS track_id, 'Exit' AS outcome, 0.0 AS pos_x FROM mask_pixels WHERE NOT (label = 5 AND frame % 2 = 1) UNION SELECT DISTINCT frame, 99, 'Exit', 0.0 FROM mask_pixels WHERE NOT (label = 5 AND frame % 2 = 1)) SELECT * FROM rw UNION ALL SELECT frame, id, '', round(cx, 6) FROM o JOIN fi USING (mv, ord)", True),
    ),
    "e13_rescued_pixels": (
        lambda s, d: ed.rescued_orphans(_observed(s, d), fx.mask_pixels(s, d))[1].groupBy("movie_id", "frame", "label").agg(F.count("*").alias("n")),
        duck(_ORPHANS + " SELECT m.frame, coalesce(id, m.label) AS label, count(*) AS n FROM mask_pixels m LEFT JOIN (SELECT frame, label, id FROM o JOIN fi USING (mv, ord)) USING (frame, label) GROUP BY ALL", True),
    ),
    "e14_cut_ghosts": (
        lambda s, d: ed.cut_ghosts(_t(s, d), _no_mask(s, d))[0].select(*_KEYS),
        duck(_FREE + _GHOSTS + " SELECT event_id, CASE WHEN frame >= since THEN new_id ELSE t.track_id END AS track_id, CASE WHEN frame >= since THEN -1 ELSE parent_id END AS parent_id, CASE WHEN frame >= since THEN '' ELSE outcome END AS outcome FROM tracks t LEFT JOIN si USING (track_id) LEFT JOIN m USING (track_id)"),
    ),
    "e14_cut_ghosts_pixels": (
        lambda s, d: _MASK_COUNT(ed.cut_ghosts(_t(s, d), _no_mask(s, d))[1]),
        duck(_FREE + _GHOSTS + " SELECT frame, CASE WHEN frame >= since THEN new_id ELSE t.track_id END AS label, count(*) AS n FROM tracks t LEFT JOIN si USING (track_id) LEFT JOIN m USING (track_id) GROUP BY ALL"),
    ),
    "e16_relink": (
        lambda s, d: ed.relink(_t(s, d), _no_mask(s, d), _some(s, d, "track_id IN (16, 20)").select("movie_id", "track_id", (F.col("track_id") + 1).alias("candidate")))[0].select("event_id", "track_id", "parent_id"),
        duck(", j AS (SELECT event_id, frame, CASE WHEN track_id IN (17, 21) THEN track_id - 1 ELSE track_id END AS t, CASE WHEN parent_id IN (17, 21) THEN parent_id - 1 ELSE parent_id END AS p, (track_id IN (17, 21))::INT AS j FROM tracks), r AS (SELECT *, row_number() OVER (PARTITION BY t, frame ORDER BY j) AS r FROM j) SELECT event_id, t AS track_id, CASE WHEN p = t THEN -1 ELSE p END AS parent_id FROM r WHERE r = 1"),
    ),
    "e16_relink_pixels": (
        lambda s, d: _MASK_COUNT(ed.relink(_t(s, d), _no_mask(s, d), _some(s, d, "track_id IN (16, 20)").select("movie_id", "track_id", (F.col("track_id") + 1).alias("candidate")))[1]),
        duck(" SELECT frame, CASE WHEN track_id IN (17, 21) THEN track_id - 1 ELSE track_id END AS label, count(*) AS n FROM tracks GROUP BY ALL"),
    ),
    "e17_fill_gaps": (
        lambda s, d: ed.fill_gaps(_t(s, d), F.when(F.col("frame") < 200, "control").otherwise("treated")).groupBy("track_id", "interpolated", "parent_id", "outcome", "fase", "continuous_label").agg(F.count("*").alias("n"), F.sum("frame").alias("frames")),
        duck(", pm AS (SELECT track_id, coalesce(max(parent_id) FILTER (parent_id > 0), -1) AS p FROM tracks GROUP BY track_id), g AS (SELECT track_id, frame AS f0, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS f1 FROM tracks), e AS (SELECT track_id, unnest(range(f0 + 1, f1)) AS frame FROM g WHERE f1 - f0 - 1 BETWEEN 1 AND 12) SELECT track_id, false AS interpolated, parent_id, outcome, fase, continuous_label, count(*) AS n, sum(frame)::BIGINT AS frames FROM tracks GROUP BY ALL UNION ALL SELECT track_id, true, p, '', CASE WHEN frame < 200 THEN 'control' ELSE 'treated' END, track_id, count(*), sum(frame)::BIGINT FROM e JOIN pm USING (track_id) GROUP BY ALL"),
    ),
    "a9_gap_paths": (lambda s, d: an.gap_fills(_t(s, d)).groupBy("track_id").agg(F.count("*").alias("n")), duck(", g AS (SELECT track_id, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) - frame - 1 AS k FROM tracks) SELECT track_id, sum(k)::BIGINT AS n FROM g WHERE k BETWEEN 1 AND 12 GROUP BY track_id")),
}
