"""The tables behind each figure (Q operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import along, so_far, TRACK, first_outcome, valid
from ..schema import MITOSIS


def box(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, q1, median and q3 of the values that are there, by group."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.25)).alias("q1"), F.median(value).alias("median"), F.percentile(value, F.lit(0.75)).alias("q3"))


def boxes(df: DataFrame, values: list[str], *by: str) -> DataFrame:
    """``box`` of several columns at once, one row for each group and column ``metric``."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values))).alias("m")).select(*by, "m.*")
    return box(long, "value", *by, "metric")


def area_by_frame(mask: DataFrame) -> DataFrame:
    per = mask.groupBy("movie_id", "frame", "label").agg(F.count("*").alias("area"))
    return per.groupBy("movie_id", "frame").agg(F.avg("area").alias("mean_area"))


def area_by_phase(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Box statistics of the tracks' mean areas by the phase of ``summary``."""
    mean = df.groupBy(*TRACK).agg(F.avg("area_px").alias("mean_area"))
    return box(summary.select(*TRACK, "fase").join(mean, TRACK), "mean_area", "movie_id", "fase")


def outcomes(summary: DataFrame) -> DataFrame:
    return summary.groupBy("movie_id", "final_outcome").agg(F.count("*").alias("n"))


def growth(df: DataFrame) -> DataFrame:
    return df.where("track_id > 0").groupBy("movie_id", "frame").agg(F.count_distinct("track_id").alias("n"))


def divisions(df: DataFrame) -> DataFrame:
    """Daughters by the first frame in which they are linked."""
    born = df.where("parent_id > 0").groupBy(*TRACK).agg(F.min("frame").alias("frame"))
    return born.groupBy("movie_id", "frame").agg(F.count("*").alias("n"))


def ensemble_msd(df: DataFrame, max_lag: int = 20) -> DataFrame:
    """Mean over tracks of each track's mean squared displacement, by lag in rows."""
    rows = df.where(valid()).withColumns({f"d{k}": F.pow(F.lead("pos_x", k).over(along()) - F.col("pos_x"), 2) + F.pow(F.lead("pos_y", k).over(along()) - F.col("pos_y"), 2) for k in range(1, max_lag + 1)})
    per = rows.groupBy(*TRACK).agg(*(F.avg(f"d{k}").alias(f"d{k}") for k in range(1, max_lag + 1)))
    long = per.select("movie_id", F.posexplode(F.array(*(f"d{k}" for k in range(1, max_lag + 1)))).alias("p", "msd")).where("msd is not null")
    return long.groupBy("movie_id", (F.col("p") + 1).cast("long").alias("lag")).agg(F.avg("msd").alias("msd"), F.count("*").alias("n"))


def time_bins(df: DataFrame, value: str, bins: int = 8) -> DataFrame:
    """Box statistics of a column over equal bins of the movie's frames."""
    ends = df.groupBy("movie_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("frame") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).cast("long")
    return box(df.join(ends, "movie_id").withColumn("bin", place), value, "movie_id", "bin")


def gradient(df: DataFrame, value: str, by: str) -> DataFrame:
    """Box statistics of a column over all rows of a movie by ``group``.

    ``by`` is ``outcome`` (the track's final one), ``phase`` (the row's) or ``mitotic`` (mothers and tracks that end in Mitosis).
    """
    if by == "phase":
        rows = df.withColumn("group", F.col("fase"))
    elif by in ("outcome", "mitotic"):
        fate = final_outcomes(df, mothers_divide=by == "mitotic")
        group = F.col("final_outcome") if by == "outcome" else F.when(F.col("final_outcome") == MITOSIS, F.lit("mitotic")).otherwise(F.lit("non-mitotic"))
        rows = df.join(fate, TRACK).withColumn("group", group)
    else:
        raise ValueError(f"no such grouping: {by}")
    return box(rows, value, "movie_id", "group")


def odometer(df: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """The way that each track has come up to each row, as ``way``."""
    gone = F.coalesce(F.hypot(F.col("pos_x") - F.lag("pos_x").over(along()), F.col("pos_y") - F.lag("pos_y").over(along())), F.lit(0.0))
    return df.withColumn("gone", gone * F.lit(float(pixel_size))).withColumn("way", F.sum("gone").over(so_far())).drop("gone")


def aggregated(df: DataFrame, x: str, y: str, how: str = "mean", group: str | None = None) -> DataFrame:
    """Any column of a movie by any other, optionally by group: mean, median, sum or count."""
    agg = {"mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count}[how]
    return df.groupBy("movie_id", *([group] if group else []), x).agg(agg(y).alias("value"))


def moving_average(df: DataFrame, y: str, k: int) -> DataFrame:
    """Sum of the k rows around each over k, so that the ends shrink; shorter tracks stay as they are."""
    lo = (k - 1) // 2
    w = along().rowsBetween(-(k - 1 - lo), lo)
    n = F.count("*").over(Window.partitionBy(*TRACK))
    return df.withColumn("smooth", F.when(n >= k, F.sum(y).over(w) / k).otherwise(F.col(y)))


def cumulative_change(df: DataFrame, y: str) -> DataFrame:
    return df.withColumn("delta", F.coalesce(F.abs(F.col(y) - F.lag(y).over(along())), F.lit(0.0))).withColumn("cumulative", F.sum("delta").over(so_far())).drop("delta")


def spider(df: DataFrame) -> DataFrame:
    """Positions relative to the first of the track."""
    return df.withColumn("dx", F.col("pos_x") - F.first("pos_x").over(so_far())).withColumn("dy", F.col("pos_y") - F.first("pos_y").over(so_far()))


def rolling(df: DataFrame, y: str, size: int) -> DataFrame:
    """Mean, spread, range and slope by row number in centred windows, clamped at the ends, of three rows and more."""
    h = max(1, size // 2)
    w = along().rowsBetween(-h, h)
    rows = df.withColumn("rn", F.row_number().over(along()).cast("double"))
    rows = rows.withColumns({"n": F.count("*").over(w), "mean": F.avg(y).over(w), "std": F.stddev_pop(y).over(w), "lowest": F.min(y).over(w), "highest": F.max(y).over(w), "slope": F.regr_slope(y, "rn").over(w)})
    return rows.where("n >= 3").withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")))


def track_series(df: DataFrame, interval: float = 1.0) -> DataFrame:
    """speed (null first), cum_distance, displacement and directionality along every track."""
    step = F.hypot(F.col("pos_x") - F.lag("pos_x").over(along()), F.col("pos_y") - F.lag("pos_y").over(along()))
    rows = spider(df.withColumn("step", step)).withColumn("cum_distance", F.sum(F.coalesce("step", F.lit(0.0))).over(so_far())).withColumn("displacement", F.hypot("dx", "dy"))
    return rows.withColumn("speed", F.col("step") / interval).withColumn("directionality", F.when(F.col("cum_distance") > 0, F.col("displacement") / F.col("cum_distance")))


def whole_windows(df: DataFrame, size: int) -> DataFrame:
    """net, path, persistence and area_slope over windows of exactly ``size`` rows that lie in the track, by their first row."""
    w, inner = along().rowsBetween(0, size - 1), along().rowsBetween(1, size - 1)
    step = F.hypot(F.col("pos_x") - F.lag("pos_x").over(along()), F.col("pos_y") - F.lag("pos_y").over(along()))
    rows = df.withColumn("step", step).withColumns({"n": F.count("*").over(w), "path": F.sum("step").over(inner), "x1": F.last("pos_x").over(w), "y1": F.last("pos_y").over(w), "area_slope": F.regr_slope("area_px", "frame").over(w)})
    out = rows.where(F.col("n") == size).withColumn("net", F.hypot(F.col("x1") - F.col("pos_x"), F.col("y1") - F.col("pos_y")))
    return out.withColumn("persistence", F.when(F.col("path") > 0, F.col("net") / F.col("path"))).select(*TRACK, "frame", "net", "path", "persistence", "area_slope")


def compared(df: DataFrame, summary: DataFrame, metrics: list[str], track: Column) -> DataFrame:
    """Robust z of the chosen tracks of ``summary`` against all, mitotic, other and each phase's tracks, by metric, for groups of three and more.

    The phase of a track is that of its first row in ``df`` that has one.
    """
    begun = df.groupBy(*TRACK).agg(F.min_by("fase", F.when(F.col("fase").isNotNull(), F.col("frame"))).alias("fase"))
    summary = summary.drop("fase").join(begun, TRACK, "left")
    groups = F.array(F.lit("all"), F.when(F.col("is_mitotic"), F.lit("mitotic")).otherwise(F.lit("non-mitotic")), F.col("fase"))
    long = summary.select(*TRACK, F.explode(groups).alias("group"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select(*TRACK, "group", "m.*").where("value is not null AND group is not null")
    first = long.groupBy("movie_id", "group", "metric").agg(F.median("value").alias("med"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    mads = long.join(first, ["movie_id", "group", "metric"]).groupBy("movie_id", "group", "metric").agg((1.4826 * F.median(F.abs(F.col("value") - F.col("med")))).alias("scale"))
    stats = first.join(mads, ["movie_id", "group", "metric"])
    mine = summary.where(track).select(*TRACK, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select(*TRACK, "m.*")
    z = F.when(F.col("n") < 3, F.lit(None)).when(F.col("scale") > 0, (F.col("value") - F.col("med")) / F.col("scale")).when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std"))
    return mine.join(stats, ["movie_id", "metric"]).where("n >= 2").withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") >= 3, F.lit(False))).select(*TRACK, "group", "metric", "value", "n", "z", "outlier")


def longest(df: DataFrame, n: int, min_frames: int = 1) -> DataFrame:
    """The n tracks of each movie with most rows, ties to the smaller id."""
    per = df.groupBy(*TRACK).agg(F.count("*").alias("n")).where(F.col("n") >= min_frames)
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("movie_id").orderBy(F.col("n").desc(), "track_id")).cast("long")).where(F.col("rank") <= n)


def final_outcomes(df: DataFrame, mothers_divide: bool = False) -> DataFrame:
    """First outcome of every track or ``none``; mothers may count as Mitosis."""
    per = df.groupBy(*TRACK).agg(F.coalesce(first_outcome(), F.lit("none")).alias("final_outcome"))
    if not mothers_divide:
        return per
    mothers = df.where("parent_id > 0").select("movie_id", F.col("parent_id").alias("track_id")).distinct().withColumn("m", F.lit(True))
    return per.join(mothers, TRACK, "left").select(*TRACK, F.when(F.col("m"), F.lit(MITOSIS)).otherwise(F.col("final_outcome")).alias("final_outcome"))


def area_nii_points(df: DataFrame, morphometry: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """A point for each object and frame whose irregularity index is known: its area, the index and the fate of its track."""
    fate = final_outcomes(df)
    rows = morphometry.where("nii IS NOT NULL AND area IS NOT NULL").withColumnRenamed("label", "track_id").join(fate, TRACK, "left")
    return rows.select("movie_id", "frame", "track_id", (F.col("area") * float(pixel_size) ** 2).alias("area"), "nii", F.coalesce("final_outcome", F.lit("none")).alias("final_outcome"))
