"""Queries and oracles of the lineage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as ln
from . import fixtures as fx
from .fixtures import duck

_LINKS = ", links AS (SELECT DISTINCT movie_id, parent_id AS parent, track_id AS child FROM tracks WHERE parent_id > 0)"
_PM = ", pm AS (SELECT movie_id, track_id AS child, max(parent_id) AS parent FROM tracks WHERE parent_id > 0 GROUP BY ALL)"
_SPAN = ", span AS (SELECT movie_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame FROM tracks GROUP BY ALL)"
_ROOTS = (
    _PM
    + ", ids AS (SELECT DISTINCT movie_id, track_id FROM tracks UNION SELECT movie_id, parent FROM pm)"
    + ", walk(movie_id, track_id, root_id) AS (SELECT movie_id, track_id, track_id FROM ids UNION ALL SELECT w.movie_id, w.track_id, pm.parent FROM walk w JOIN pm ON pm.child = w.root_id)"
    + ", roots AS (SELECT w.movie_id, w.track_id, w.root_id FROM walk w WHERE w.root_id NOT IN (SELECT child FROM pm))"
)
_CLASS = (
    _LINKS
    + ", flagged AS (SELECT DISTINCT movie_id, track_id FROM tracks WHERE outcome NOT IN ('', 'Unknown'))"
    + ", singles AS (SELECT * FROM flagged WHERE track_id NOT IN (SELECT parent FROM links) AND track_id NOT IN (SELECT child FROM links))"
)
_LROOTS = _CLASS + ", lroots AS (SELECT movie_id, parent AS track_id FROM links WHERE parent NOT IN (SELECT child FROM links) UNION SELECT * FROM singles UNION SELECT movie_id, root_id FROM roots WHERE track_id IN (SELECT parent FROM links))"

_text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


def _proposed(s, d):
    t = fx.tracks(s, d).select("movie_id", "track_id").distinct()
    return t.select("movie_id", F.floor(F.col("track_id") / 3).alias("mother"), F.col("track_id").alias("daughter"))


QUERIES = {
    "l1_classified": (
        lambda s, d: ln.classified(fx.tracks(s, d)).select("movie_id", "track_id", "role", _text("children").alias("children")),
        duck(_CLASS + " SELECT movie_id, parent AS track_id, 'mother' AS role, string_agg(child::VARCHAR, ',' ORDER BY child) AS children FROM links GROUP BY ALL UNION ALL SELECT DISTINCT movie_id, child, 'daughter', '' FROM links UNION ALL SELECT movie_id, track_id, 'single', '' FROM singles"),
    ),
    "l2_parent_map": (lambda s, d: ln.parent_map(fx.tracks(s, d)), duck(_PM + " SELECT movie_id, child, parent FROM pm")),
    "l3_spans": (lambda s, d: ln.spans(fx.tracks(s, d)), duck(_SPAN + " SELECT * FROM span")),
    "l4_roots": (lambda s, d: ln.roots(fx.tracks(s, d)), duck(_ROOTS + " SELECT * FROM roots", recursive=True)),
    "l5_families": (
        lambda s, d: ln.families(fx.tracks(s, d)).select("movie_id", "root_id", _text("members").alias("members"), "size"),
        duck(_ROOTS + " SELECT movie_id, root_id, string_agg(track_id::VARCHAR, ',' ORDER BY track_id) AS members, count(*) AS size FROM roots GROUP BY ALL", recursive=True),
    ),
    "l6_lineage_roots": (lambda s, d: ln.lineage_roots(fx.tracks(s, d)), duck(_ROOTS + _LROOTS + " SELECT movie_id, track_id FROM lroots", recursive=True)),
    "l7_labels": (
        lambda s, d: ln.labels(fx.tracks(s, d)),
        duck(
            _ROOTS + _LROOTS + _SPAN
            + ", sib AS (SELECT pm.movie_id, parent, child, row_number() OVER (PARTITION BY parent ORDER BY coalesce(first_frame, 1000000000), child) AS k FROM pm LEFT JOIN span ON span.track_id = child)"
            + ", lab(movie_id, track_id, label, generation) AS (SELECT r.movie_id, r.track_id, (row_number() OVER (ORDER BY coalesce(first_frame, 1000000000), r.track_id))::VARCHAR, 0::BIGINT FROM lroots r LEFT JOIN span USING (track_id) WHERE r.track_id NOT IN (SELECT child FROM pm) UNION ALL SELECT sib.movie_id, child, label || '.' || k, generation + 1 FROM lab JOIN sib ON sib.parent = lab.track_id) SELECT * FROM lab",
            recursive=True,
        ),
    ),
    "l8_violations": (
        lambda s, d: ln.violations(fx.tracks(s, d)),
        duck(
            _LINKS + _SPAN
            + ", v AS (SELECT l.movie_id, parent AS track_id, count(*) > 2 AS a, coalesce(bool_or(c.first_frame <= p.first_frame), false) AS b, any_value(p.last_frame) >= min(coalesce(c.first_frame, 1000000000)) AS c FROM links l LEFT JOIN span c ON c.track_id = child LEFT JOIN span p ON p.track_id = parent GROUP BY ALL)"
            + " SELECT movie_id, track_id, 'too many daughters' AS kind FROM v WHERE a UNION ALL SELECT movie_id, track_id, 'daughter not after mother' FROM v WHERE b UNION ALL SELECT movie_id, track_id, 'mother outlives division' FROM v WHERE c"
        ),
    ),
    "l9_checked_links": (
        lambda s, d: ln.checked_links(fx.tracks(s, d), _proposed(s, d)),
        duck(
            _LINKS + _PM + _SPAN
            + ", p AS (SELECT DISTINCT movie_id, floor(track_id / 3.0)::BIGINT AS mother, track_id AS daughter FROM tracks), n AS (SELECT parent, count(*) AS n FROM links GROUP BY parent)"
            + " SELECT p.movie_id, mother, daughter, CASE WHEN mother = daughter THEN 'self' WHEN m.track_id IS NULL OR d.track_id IS NULL THEN 'missing' WHEN coalesce(n.n, 0) >= 2 THEN 'two daughters already' WHEN pm.parent <> mother THEN 'other mother' WHEN d.first_frame <= m.first_frame THEN 'not born after mother' END AS reason"
            + " FROM p LEFT JOIN span m ON m.track_id = mother LEFT JOIN span d ON d.track_id = daughter LEFT JOIN n ON n.parent = mother LEFT JOIN pm ON pm.child = daughter"
        ),
    ),
    "l10_ranked_families": (
        lambda s, d: ln.ranked_families(fx.tracks(s, d)),
        duck(
            _ROOTS
            + ", f AS (SELECT movie_id, root_id, count(*) AS size FROM roots GROUP BY ALL HAVING count(*) > 1), r AS (SELECT *, row_number() OVER w AS rank, sum(size) OVER w AS nodes FROM f WINDOW w AS (PARTITION BY movie_id ORDER BY size DESC, root_id))"
            + ", b AS (SELECT *, max((rank > 60 OR nodes > 400)::INT) OVER (PARTITION BY movie_id ORDER BY rank) AS broken FROM r) SELECT movie_id, root_id, size, rank FROM b WHERE rank = 1 OR broken = 0",
            recursive=True,
        ),
    ),
    "l11_generations": (
        lambda s, d: ln.generations(fx.tracks(s, d)),
        duck(
            _ROOTS
            + ", f AS (SELECT movie_id, root_id, count(*) AS size FROM roots GROUP BY ALL HAVING count(*) > 1), r AS (SELECT *, row_number() OVER w AS rank, sum(size) OVER w AS nodes FROM f WINDOW w AS (PARTITION BY movie_id ORDER BY size DESC, root_id))"
            + ", b AS (SELECT *, max((rank > 60 OR nodes > 400)::INT) OVER (PARTITION BY movie_id ORDER BY rank) AS broken FROM r), steps AS (SELECT track_id, count(*) - 1 AS generation FROM walk GROUP BY track_id)"
            + " SELECT roots.movie_id, roots.root_id, roots.track_id, generation, parent FROM roots JOIN b ON b.root_id = roots.root_id AND (rank = 1 OR broken = 0) JOIN steps USING (track_id) LEFT JOIN pm ON pm.child = roots.track_id",
            recursive=True,
        ),
    ),
    "l12_next_unreviewed": (
        lambda s, d: ln.next_unreviewed(fx.tracks(s, d), fx.tracks(s, d).where("track_id < 4").select("movie_id", F.col("track_id").alias("root_id")).distinct()),
        duck(_ROOTS + _SPAN + " SELECT roots.movie_id, arg_min(roots.track_id, first_frame * 1000000000 + roots.track_id) AS track_id FROM roots JOIN span USING (track_id) WHERE root_id >= 4 GROUP BY ALL", recursive=True),
    ),
    "l12b_next_uncurated": (
        lambda s, d: ln.next_uncurated(fx.tracks(s, d), 10),
        duck(_CLASS + " SELECT movie_id, min(frame) AS frame, arg_min(track_id, frame * 1000000000 + track_id) AS track_id FROM tracks WHERE frame > 10 AND track_id NOT IN (SELECT parent FROM links) AND track_id NOT IN (SELECT child FROM links) AND track_id NOT IN (SELECT track_id FROM singles) GROUP BY ALL"),
    ),
}
