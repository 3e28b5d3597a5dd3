"""Queries and oracles of consolidation and of edits that are replayed in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import consolidation as co
from ..operators import pixels as px
from ..operators import replay as rp
from . import fixtures as fx
from .fixtures import duck
from .q_edits import _KEYS, _no_mask, _t


def _mask(s, d) -> DataFrame:
    """The label images; object 9 has the label 60 in every fourth frame."""
    other = (F.col("label") == 9) & (F.col("frame") % 4 == 2)
    return fx.mask_pixels(s, d).withColumn("label", F.when(other, F.lit(60).cast("long")).otherwise(F.col("label")))


def _rows(s, d) -> DataFrame:
    """Centroids as observations.

    Label 12 is torn in frames 3, 7, ...: there, in movie 0, its own row lies on the small piece and track 50 on the large one. In frames 1, 5, ...
    track 60, the mother of 11, lies on label 12; in frames 0, 4, ... track 12 has no row.
    """
    own = px.centroids(_mask(s, d)).withColumnRenamed("label", "track_id")
    own = own.withColumns({"parent_id": F.when(F.col("track_id") == 11, 60).otherwise(-1).cast("long"), "outcome": F.lit("Exit")})
    swapped = (F.col("movie_id") == 0) & (F.col("frame") % 4 == 3)
    large = px.centroids(_mask(s, d).where((F.col("label") == 12) & swapped & (F.col("y") >= 5)))
    large = large.select("movie_id", "frame", F.lit(50).cast("long").alias("track_id"), "x", "y", F.lit(-1).cast("long").alias("parent_id"), F.lit("Exit").alias("outcome"))
    cover = own.where((F.col("track_id") == 12) & (F.col("frame") % 4 == 1)).withColumns({"track_id": F.lit(60).cast("long"), "outcome": F.lit("Mitosis")})
    twelve = F.col("track_id") == 12
    own = own.withColumns({"x": F.when(twelve & swapped, F.lit(90.5)).otherwise(F.col("x")), "y": F.when(twelve & swapped, F.lit(2.5)).otherwise(F.col("y"))})
    rows = own.where(~(twelve & (F.col("frame") % 4 == 0))).unionByName(large).unionByName(cover)
    return rows.select("movie_id", "frame", "track_id", F.col("x").alias("pos_x"), F.col("y").alias("pos_y"), "parent_id", "outcome", F.col("track_id").alias("continuous_label"))


def _consolidated(s, d) -> tuple[DataFrame, DataFrame]:
    mask = _mask(s, d)
    return co.consolidated(_rows(s, d), mask, mask.where("label = 12").select("movie_id", F.col("label").alias("track_id")))


_CONSOLIDATED = """
, mp AS (
  SELECT frame, y, x, CASE WHEN label = 9 AND frame % 100000 % 4 = 2 THEN 60 ELSE label END AS label FROM mask_pixels),
ob AS (SELECT frame, label AS t, avg(x) AS px, avg(y) AS py FROM mp GROUP BY frame, label),
tr AS (
  SELECT frame, t,
         CASE WHEN t = 12 AND frame < 100000 AND frame % 4 = 3 THEN 90.5 ELSE px END AS px,
         CASE WHEN t = 12 AND frame < 100000 AND frame % 4 = 3 THEN 2.5 ELSE py END AS py,
         CASE WHEN t = 11 THEN 60 ELSE -1 END AS par, 'Exit' AS outcome
  FROM ob WHERE NOT (t = 12 AND frame % 100000 % 4 = 0)
  UNION ALL
  SELECT frame, 50, avg(x), avg(y), -1, 'Exit' FROM mp WHERE label = 12 AND y >= 5 AND frame < 100000 AND frame % 4 = 3 GROUP BY frame
  UNION ALL
  SELECT frame, 60, px, py, -1, 'Mitosis' FROM ob WHERE t = 12 AND frame % 100000 % 4 = 1),
c(frame, y, x, part) AS (
  SELECT frame, y, x, y * 1000000 + x FROM mp WHERE label = 12
  UNION
  SELECT n.frame, n.y, n.x, c.part FROM c JOIN mp n ON n.label = 12 AND c.frame = n.frame AND abs(c.x - n.x) <= 1 AND abs(c.y - n.y) <= 1
  WHERE c.part < n.y * 1000000 + n.x),
p AS (SELECT frame, y, x, min(part) AS part FROM c GROUP BY frame, y, x),
z AS (SELECT frame, part, count(*) AS n FROM p GROUP BY frame, part),
lies AS (SELECT p.frame, p.part, t FROM p JOIN tr ON tr.frame = p.frame AND p.x = trunc(px)::BIGINT AND p.y = trunc(py)::BIGINT),
torn AS (
  SELECT z.frame, arg_max(part, n * 1000000000 - part) AS keeps,
         (SELECT max(part) FROM lies l WHERE l.frame = z.frame AND t = 12) AS piece,
         (SELECT arg_max(t, part * 1000 + t) FROM lies l WHERE l.frame = z.frame AND t <> 12) AS owner
  FROM z GROUP BY z.frame HAVING count(*) > 1),
m1 AS (
  SELECT frame, y, x, label FROM mp WHERE label <> 12
  UNION ALL
  SELECT p.frame, y, x, CASE WHEN piece IS NOT NULL AND owner IS NOT NULL AND part = piece THEN owner ELSE 12 END
  FROM p LEFT JOIN torn USING (frame)
  WHERE keeps IS NULL OR (piece IS NOT NULL AND owner IS NOT NULL) OR part = keeps),
r1 AS (
  SELECT tr.frame, px, py, swap AND t IN (12, owner) AS moved,
         CASE WHEN swap AND t = 12 THEN owner WHEN swap AND t = owner THEN 12 ELSE t END AS t, par, outcome
  FROM tr LEFT JOIN (SELECT *, piece IS NOT NULL AND owner IS NOT NULL AS swap FROM torn) USING (frame)),
r2 AS (SELECT frame, px, py, t, CASE WHEN moved THEN -1 ELSE par END AS par, CASE WHEN moved THEN '' ELSE outcome END AS outcome FROM r1),
ab AS (
  SELECT DISTINCT r2.frame // 100000 AS mv, t
  FROM r2 JOIN m1 ON m1.frame = r2.frame AND m1.x = trunc(px)::BIGINT AND m1.y = trunc(py)::BIGINT WHERE m1.label = 12 AND t <> 12),
m2 AS (SELECT frame, y, x, CASE WHEN (frame // 100000, label) IN (SELECT mv, t FROM ab) THEN 12 ELSE label END AS label FROM m1),
r3 AS (
  SELECT frame, px, py, t AS was, (frame // 100000, t) IN (SELECT mv, t FROM ab) AS gone,
         CASE WHEN (frame // 100000, par) IN (SELECT mv, t FROM ab) AND t <> 12 THEN 12 ELSE par END AS par, outcome
  FROM r2),
r4 AS (
  SELECT frame, px, py, CASE WHEN gone THEN 12 ELSE was END AS t, CASE WHEN gone THEN -1 ELSE par END AS par, CASE WHEN gone THEN '' ELSE outcome END AS outcome
  FROM r3 QUALIFY row_number() OVER (PARTITION BY frame, CASE WHEN gone THEN 12 ELSE was END ORDER BY gone, was) = 1),
ct AS (SELECT frame, 12 AS t, avg(x) AS cx, avg(y) AS cy FROM m2 WHERE label = 12 GROUP BY frame),
fin AS (
  SELECT frame, t::BIGINT AS track_id, coalesce(par, -1)::BIGINT AS parent_id, coalesce(outcome, '') AS outcome,
         round(coalesce(cx, px), 6) AS pos_x, round(coalesce(cy, py), 6) AS pos_y, coalesce(par, -1) AS q
  FROM r4 FULL JOIN ct USING (frame, t))
"""

_REPLAYED = [(1, "merge", 6, 26, None), (2, "unlink", 50, None, None), (3, "merge", 26, 29, None), (4, "delete", 40, None, None), (5, "flag", 29, None, "Exit"), (6, "flag", 6, None, "Ambiguous"), (7, "merge", 80, 81, None)]


def _edits(s, d) -> DataFrame:
    """The edits of the query, in every movie of the tracks."""
    rows = s.createDataFrame([(q, k, a, b, f) for q, k, a, b, f in _REPLAYED], "seq long, kind string, a long, b long, flag string").withColumn("frame", F.lit(None).cast("long"))
    return rows.join(_t(s, d).select("movie_id").distinct(), how="cross")


def _dissolved(t: str, n: int) -> str:
    """A step of an oracle: invalid divisions of ``t`` dissolve."""
    return f"""
sp{n} AS (SELECT track_id, min(frame) AS f FROM {t} GROUP BY track_id),
bad{n} AS (
  SELECT l.parent_id AS p
  FROM (SELECT DISTINCT parent_id, track_id FROM {t} WHERE parent_id > 0 AND parent_id <> track_id) l
  LEFT JOIN sp{n} c ON c.track_id = l.track_id LEFT JOIN sp{n} m ON m.track_id = l.parent_id
  GROUP BY l.parent_id HAVING bool_or(m.f IS NULL OR c.f <= m.f)),
d{n} AS (
  SELECT event_id, frame, track_id, CASE WHEN parent_id = track_id OR parent_id IN (SELECT p FROM bad{n}) THEN -1 ELSE parent_id END AS parent_id,
         CASE WHEN outcome = 'Mitosis' AND track_id IN (SELECT p FROM bad{n}) THEN '' ELSE outcome END AS outcome
  FROM {t})"""


def _merged(t: str, n: int, a: int, b: int) -> str:
    """A step of an oracle: ``a`` goes on as ``b``, no relative of it."""
    return f"""
m{n} AS (
  SELECT event_id, frame, CASE WHEN track_id = {a} THEN {b} ELSE track_id END AS track_id, outcome,
         CASE WHEN track_id = {a} THEN (SELECT coalesce(max(parent_id), -1) FROM {t} WHERE track_id = {b}) ELSE parent_id END AS p
  FROM {t}),
n{n} AS (SELECT event_id, frame, track_id, outcome, CASE WHEN p = {a} THEN CASE WHEN track_id = {b} THEN -1 ELSE {b} END ELSE p END AS parent_id FROM m{n}),""" + _dissolved(f"n{n}", n)


_REPLAY = (
    ", t0 AS (SELECT event_id, frame, track_id, parent_id, outcome FROM tracks),"
    + _dissolved("t0", 0) + "," + _merged("d0", 1, 6, 26)
    + """,
u2 AS (
  SELECT event_id, frame, track_id, CASE WHEN track_id = 50 THEN -1 ELSE parent_id END AS parent_id, outcome FROM d1),
d2 AS (
  SELECT event_id, frame, track_id, parent_id,
         CASE WHEN outcome = 'Mitosis' AND track_id IN (SELECT parent_id FROM d1 WHERE track_id = 50 AND parent_id > 0)
                   AND track_id NOT IN (SELECT parent_id FROM u2 WHERE parent_id > 0) THEN '' ELSE outcome END AS outcome
  FROM u2),"""
    + _merged("d2", 3, 26, 29)
    + """,
u4 AS (SELECT event_id, frame, track_id, CASE WHEN parent_id = 40 THEN -1 ELSE parent_id END AS parent_id, outcome FROM d3 WHERE track_id <> 40),"""
    + _dissolved("u4", 4)
    + """,
u5 AS (SELECT event_id, frame, track_id, parent_id, CASE WHEN track_id = 29 THEN 'Exit' ELSE outcome END AS outcome FROM d4),"""
    + _merged("u5", 7, 80, 81)
    + " SELECT event_id, track_id, parent_id::BIGINT AS parent_id, outcome FROM d7"
)

QUERIES = {
    "e18_consolidated": (
        lambda s, d: _consolidated(s, d)[0].select("movie_id", "frame", "track_id", "parent_id", "outcome", F.round("pos_x", 6).alias("pos_x"), F.round("pos_y", 6).alias("pos_y")),
        duck(_CONSOLIDATED + " SELECT frame, track_id, parent_id, outcome, pos_x, pos_y FROM fin", True, True),
    ),
    "e18_consolidated_pixels": (
        lambda s, d: _consolidated(s, d)[1].groupBy("movie_id", "frame", "label").agg(F.count("*").alias("n"), F.sum(F.col("y") * 96 + F.col("x")).alias("places")),
        duck(_CONSOLIDATED + " SELECT frame, label::BIGINT AS label, count(*) AS n, sum(y * 96 + x)::BIGINT AS places FROM m2 GROUP BY ALL", True, True),
    ),
    "e6_replayed": (lambda s, d: rp.replayed(_t(s, d), _no_mask(s, d), _edits(s, d))[0].select(*_KEYS), duck(_REPLAY)),
}
