"""Tracks and label images derived from the driver's ``events``, by the same integer formulas in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LADDER = "CASE WHEN track_id >= 1024 THEN 10 WHEN track_id >= 512 THEN 9 WHEN track_id >= 256 THEN 8 WHEN track_id >= 128 THEN 7 WHEN track_id >= 64 THEN 6 WHEN track_id >= 32 THEN 5 WHEN track_id >= 16 THEN 4 WHEN track_id >= 8 THEN 3 WHEN track_id >= 4 THEN 2 WHEN track_id >= 2 THEN 1 ELSE 0 END"

#: Common table expressions for ``tracks``; ``{events}`` is the events table.
TRACKS = f"""
ev0 AS (
  SELECT event_id, user_id + 1 AS track_id, event_type, value, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i,
         CAST({_LADDER.replace("track_id", "(user_id + 1)")} AS BIGINT) AS g
  FROM {{events}}),
ev1 AS (
  SELECT *, CAST(80 * g + i + CASE WHEN track_id % 5 = 0 THEN 4 * floor(i / 20.0) ELSE 0 END AS BIGINT) AS frame,
         CAST(50 + (track_id * 37) % 200 AS DOUBLE) + sum(CAST(((event_id * 7919) % 21 - 10) * 0.5 + CASE WHEN event_type = 'error' AND value > 150 THEN 60 ELSE 0 END AS DOUBLE)) OVER (PARTITION BY track_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS pos_x,
         CAST(50 + (track_id * 53) % 200 AS DOUBLE) + sum(CAST(((event_id * 6007) % 19 - 9) * 0.5 AS DOUBLE)) OVER (PARTITION BY track_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS pos_y,
         last_value(event_type) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type
  FROM ev0),
tracks AS (
  SELECT CAST(0 AS BIGINT) AS movie_id, CAST(track_id AS BIGINT) AS track_id, frame, pos_x, pos_y,
         CASE WHEN track_id % 6 = 5 THEN '' WHEN last_type = 'signup' THEN 'Mitosis' WHEN last_type = 'purchase' THEN 'Exit'
              WHEN last_type = 'error' THEN 'Death/Senescence' WHEN last_type = 'view' THEN 'Ambiguous' ELSE '' END AS outcome,
         CAST(CASE WHEN track_id % 7 = 0 OR track_id < 2 THEN -1 WHEN track_id % 13 = 0 THEN track_id + 1
              WHEN track_id % 11 = 0 THEN floor(track_id / 2.0) - 1 ELSE floor(track_id / 2.0) END AS BIGINT) AS parent_id,
         CAST(track_id AS BIGINT) AS continuous_label,
         CASE WHEN frame < 200 THEN 'control' WHEN frame > 400 THEN 'washout' ELSE 'treated' END AS fase,
         k < 5 AS at_border, CAST(200 + k AS DOUBLE) AS area_px, event_id, event_type
  FROM ev1)"""

#: Label pixels, dense intensities and frames: one object for each row of ``supplier``, twelve to a frame of 40 x 96
#: pixels, in two movies by nation. Place, size and brightness come from the row's nation and balance.
#: ``{frame}`` names a frame of a movie: its number in Spark, a number over all movies in the oracles.
PIXELS = """
sp0 AS (
  SELECT CAST(s_nationkey % 2 AS BIGINT) AS movie_id, CAST(s_nationkey AS BIGINT) AS nation, CAST(floor(abs(s_acctbal)) AS BIGINT) AS balance,
         CAST(row_number() OVER (PARTITION BY s_nationkey % 2 ORDER BY s_suppkey) - 1 AS BIGINT) AS i
  FROM {supplier}),
sp1 AS (SELECT movie_id, nation, balance, CAST(floor(i / 12.0) AS BIGINT) AS no, i % 12 + 1 AS label FROM sp0),
obj AS (
  SELECT movie_id, {frame} AS frame, no, label, balance, 4 + 14 * ((label - 1) % 6) + nation % 10 AS cx,
         CAST(12 + 14 * floor((label - 1) / 6.0) AS BIGINT) + (label * nation) % 3 AS cy, 4 + balance % 3 AS a, 3 + balance % 4 AS b
  FROM sp1),
fr AS (SELECT DISTINCT movie_id, frame, no FROM obj),
ys AS (SELECT CAST(id AS BIGINT) AS y FROM {ys}),
xs AS (SELECT CAST(id AS BIGINT) AS x FROM {xs}),
grid AS (SELECT movie_id, frame, no, y, x FROM fr CROSS JOIN ys CROSS JOIN xs),
hits AS (
  SELECT g.movie_id, g.frame, g.y, g.x, min(label) AS label
  FROM grid g JOIN obj o ON g.movie_id = o.movie_id AND g.frame = o.frame
  WHERE (g.x - cx) * (g.x - cx) * b * b + (g.y - cy) * (g.y - cy) * a * a <= a * a * b * b GROUP BY g.movie_id, g.frame, g.y, g.x),
dense AS (
  SELECT g.movie_id, g.frame, g.no, g.y, g.x, CASE WHEN g.no % 4 = 3 AND g.y BETWEEN 2 AND 3 AND g.x BETWEEN 90 AND 91 THEN 12 ELSE h.label END AS label
  FROM grid g LEFT JOIN hits h ON g.movie_id = h.movie_id AND g.frame = h.frame AND g.y = h.y AND g.x = h.x),
mask_pixels AS (SELECT movie_id, frame, y, x, CAST(label AS BIGINT) AS label FROM dense WHERE label IS NOT NULL),
channel_pixels AS (
  SELECT d.movie_id, 'gfp' AS channel, d.frame, d.y, d.x,
         CAST(100 + (d.x * 31 + d.y * 17 + d.no * 7) % 64 + CASE WHEN d.label IS NULL THEN 0 ELSE 40 + coalesce(o.balance, 0) % 50 + ((d.x + d.y) % 2) * 10 * (coalesce(o.balance, 0) % 3) END AS DOUBLE) AS value
  FROM dense d LEFT JOIN obj o ON d.movie_id = o.movie_id AND d.frame = o.frame AND d.label = o.label),
frames AS (SELECT movie_id, frame, CAST(40 AS BIGINT) AS height, CAST(96 AS BIGINT) AS width FROM fr)"""

#: Frames of a movie in the oracles: a join or group by ``frame`` there keeps movies apart.
APART = 100_000
DUCK_TRACKS = TRACKS.format(events="events")
DUCK_PIXELS = PIXELS.format(supplier="supplier", frame=f"movie_id * {APART} + no", ys="(SELECT unnest(range(40)) AS id)", xs="(SELECT unnest(range(96)) AS id)")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: one row for each event."""
    return spark.sql(f"WITH {TRACKS} SELECT * FROM tracks", events=_events(spark, sf_dir))


def _pixels(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return spark.sql(f"WITH {PIXELS.replace('{frame}', 'no')} SELECT * FROM {table}", supplier=supplier, ys=spark.range(40), xs=spark.range(96))


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir, "mask_pixels")


def channel_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir, "channel_pixels")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir, "frames")


def duck(body: str, pixels: bool = False, recursive: bool = False) -> str:
    """An oracle over ``tracks`` or, with ``pixels``, over the label images; ``body`` may begin with further tables.

    A result of ``pixels`` with a ``frame`` gets its ``movie_id`` and the frame's number in the movie back.
    """
    body = body if body.lstrip().startswith(",") else " " + body
    if not pixels:
        return f"WITH {'RECURSIVE ' if recursive else ''}{DUCK_TRACKS}{body}"
    query = f"WITH {'RECURSIVE ' if recursive else ''}{DUCK_PIXELS}{body}"
    return query if "movie_id" in body else f"SELECT (frame // {APART})::BIGINT AS movie_id, (frame % {APART})::BIGINT AS frame, * EXCLUDE (frame) FROM ({query})"
