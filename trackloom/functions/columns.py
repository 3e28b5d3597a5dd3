"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import EMPTY, FINAL, QUARANTINE_FROM, QUARANTINE_TO

TRACK = ["movie_id", "track_id"]


def along() -> WindowSpec:
    """Rows of a track in the order of frames. All windows share this one, so one exchange and sort serves them."""
    return Window.partitionBy(*TRACK).orderBy("frame")


def whole() -> WindowSpec:
    return along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    return along().rowsBetween(Window.unboundedPreceding, 0)


def valid() -> Column:
    """Rows with an id, a frame and a position, and a positive id."""
    return F.col("track_id").isNotNull() & F.col("frame").isNotNull() & F.col("pos_x").isNotNull() & F.col("pos_y").isNotNull() & (F.col("track_id") > 0)


def quarantined(track: str = "track_id") -> Column:
    return (F.col(track) >= QUARANTINE_FROM) & (F.col(track) < QUARANTINE_TO)


def normal_id(track: str = "track_id") -> Column:
    return (F.col(track) > 0) & (F.col(track) < QUARANTINE_FROM)


def has_outcome(c: str | Column = "outcome") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~c.isin(EMPTY), F.lit(False))


def is_final(c: str | Column = "outcome") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.isin(FINAL), F.lit(False))


def first_outcome() -> Column:
    """Aggregate: the outcome of the earliest frame that has one; null without any."""
    return F.min_by("outcome", F.when(has_outcome(), F.col("frame")))


def step() -> Column:
    """Distance from the row before, null in the first."""
    return F.hypot(F.col("pos_x") - F.lag("pos_x").over(along()), F.col("pos_y") - F.lag("pos_y").over(along()))
