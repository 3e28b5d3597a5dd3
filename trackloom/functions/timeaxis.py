"""Time axes from file names, and phases (M operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of elapsed time in file names, tried in this order, and what their groups are.
PATTERNS = [
    (r"(\d+)d(\d+)h(\d+)m", ("d", "h", "m")),
    (r"(?<!\d)(\d+)h(\d+)m", ("h", "m")),
    (r"(\d+)d(\d+)h(?!\d)", ("d", "h")),
    (r"(?i)(\d+)\s*min(?![a-z])", ("m",)),
    (r"(?i)(\d+)\s*h(?:r|rs|ours?)?(?![a-z0-9])", ("h",)),
]
_HOURS = {"d": 24.0, "h": 1.0, "m": 1 / 60.0}


def stem(name: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def natural_key(name: Column) -> Column:
    """A key under which names sort by the numbers in them: ``img2`` before ``img10``. Runs of digits are brought to 40 places."""
    padded = F.regexp_replace(name, r"(\d+)", "0" * 40 + "$1")
    return F.regexp_replace(padded, r"\d*(\d{40})(?!\d)", "$1")


def numbered_files(files: DataFrame) -> DataFrame:
    """The files (movie_id, filename) of each movie with ``frame`` from 0 in natural order of their names, folders included."""
    order = Window.partitionBy("movie_id").orderBy(natural_key(F.col("filename")), "filename")
    return files.withColumn("frame", (F.row_number().over(order) - 1).cast("long"))


def _hours(name: Column, pattern: str, kinds: tuple[str, ...]) -> Column:
    part = lambda i: F.regexp_extract(name, pattern, i + 1)
    total = sum((part(i).try_cast("double") * _HOURS[k] for i, k in enumerate(kinds)), F.lit(0.0))
    return F.when(part(0) != "", total)


def parsed_times(files: DataFrame, pattern: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """movie_id, frame, hours by the first pattern that fits all names of the movie and strictly increases; null without one."""
    patterns = [pattern] if pattern else PATTERNS
    w = Window.partitionBy("movie_id").orderBy("frame")
    rows = files.withColumn("stem", stem(F.col("filename"))).withColumns({f"h{i}": _hours(F.col("stem"), *p) for i, p in enumerate(patterns)})
    rows = rows.withColumns({f"s{i}": F.col(f"h{i}") - F.lag(f"h{i}").over(w) for i in range(len(patterns))})
    fits = rows.groupBy("movie_id").agg(*((F.bool_and(F.col(f"h{i}").isNotNull()) & F.coalesce(F.min(f"s{i}") > 0, F.lit(True))).alias(f"ok{i}") for i in range(len(patterns))))
    hours = F.coalesce(*(F.when(F.col(f"ok{i}"), F.col(f"h{i}")) for i in range(len(patterns))))
    return rows.join(fits, "movie_id").select("movie_id", "frame", "filename", hours.alias("hours"))


def time_table(files: DataFrame, interval: float = 0.5, tolerance: float = 1e-6) -> DataFrame:
    """movie_id, frame, tempo_h, dt_h, modal_h, gap and where the time comes from."""
    w = Window.partitionBy("movie_id").orderBy("frame")
    rows = parsed_times(files).withColumn("tempo_h", F.col("hours") - F.first("hours").over(w))
    rows = rows.withColumn("source", F.when(F.col("hours").isNull(), F.lit("interval")).otherwise(F.lit("filename")))
    rows = rows.withColumn("tempo_h", F.coalesce("tempo_h", (F.row_number().over(w) - 1) * F.lit(float(interval)))).withColumn("dt_h", F.col("tempo_h") - F.lag("tempo_h").over(w))
    modal = rows.groupBy("movie_id").agg(F.mode(F.round("dt_h", 6), True).alias("modal_h"))
    rows = rows.join(modal, "movie_id")
    return rows.select("movie_id", "frame", "filename", "tempo_h", "dt_h", "modal_h", F.coalesce(F.col("dt_h") > F.col("modal_h") + tolerance, F.lit(False)).alias("gap"), "source")


def drift_summary(times: DataFrame) -> DataFrame:
    """Real span, the span of a regular movie, and the number of gaps."""
    return times.groupBy("movie_id").agg((F.max("tempo_h") - F.min("tempo_h")).alias("span_h"), ((F.count("*") - 1) * F.first("modal_h")).alias("regular_h"), F.count_if("gap").alias("gaps"))


def phase(frame: Column, start: Column, end: Column, control_only: Column) -> Column:
    """control before the start or throughout a control movie, washout after an end of 0 and more, treated between."""
    return F.when(control_only | (frame < start), "control").when((end >= 0) & (frame > end), "washout").otherwise("treated")
