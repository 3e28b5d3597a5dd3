"""Cleaning and derived columns of the observation table (P operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import along, TRACK, whole, has_outcome, step, valid
from ..schema import EXIT, MITOSIS, NON_FLAG, START_MARKERS, TRANSLATIONS, Thresholds
from .quantiles import quantiles


def translated_outcome(label: Column) -> Column:
    """Labels of other trackers in our vocabulary; start markers and empty ones become ''; others stay."""
    key = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in TRANSLATIONS.items() for x in pair])
    return F.when(key.isin("", "nan", "none", *START_MARKERS), F.lit("")).otherwise(F.coalesce(known[key], label))


def standard_links(df: DataFrame) -> DataFrame:
    """Parent as an id or -1, label value by default the track, phase from the legacy column ``treatment``."""
    out = df.withColumn("parent_id", F.coalesce(F.expr("try_cast(parent_id AS BIGINT)"), F.lit(-1)))
    label = F.col("track_id") if "continuous_label" not in df.columns else F.coalesce("continuous_label", "track_id")
    out = out.withColumn("continuous_label", label.cast("long"))
    if "fase" not in out.columns and "treatment" in out.columns:
        out = out.withColumnRenamed("treatment", "fase")
    return out


def flag_mothers(df: DataFrame) -> DataFrame:
    """Tracks that are somebody's parent and have no outcome become Mitosis."""
    mothers = df.where("parent_id > 0").select("movie_id", F.col("parent_id").alias("track_id")).distinct().withColumn("mother", F.lit(True))
    return df.join(mothers, TRACK, "left").withColumn("outcome", F.when(F.col("mother") & ~has_outcome(), F.lit(MITOSIS)).otherwise(F.col("outcome"))).drop("mother")


def with_area(tracks: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels of each track's label in each frame; null where it has none."""
    area = mask.groupBy("movie_id", "frame", F.col("label").alias("track_id")).agg(F.count("*").cast("double").alias("area_px"))
    return tracks.drop("area_px").join(area, ["movie_id", "frame", "track_id"], "left")


def with_border(tracks: DataFrame, mask: DataFrame, frames: DataFrame, margin: int = 0) -> DataFrame:
    """Whether each track's label has a pixel within ``margin`` of an edge."""
    sized = mask.join(frames.select("movie_id", "height", "width").distinct(), "movie_id")
    edge = (F.col("y") <= margin) | (F.col("x") <= margin) | (F.col("y") >= F.col("height") - 1 - margin) | (F.col("x") >= F.col("width") - 1 - margin)
    touching = sized.where(edge).select("movie_id", "frame", F.col("label").alias("track_id")).distinct().withColumn("at_border", F.lit(True))
    return tracks.drop("at_border").join(touching, ["movie_id", "frame", "track_id"], "left").fillna(False, ["at_border"])


def border_exits(df: DataFrame, tail: int = 5, min_tail: int = 3, shrink: float = 0.6) -> DataFrame:
    """(movie_id, track_id) of the tracks that leave the field: no outcome, gone before the movie ends, at the border and shrunk at the end."""
    back = F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.col("frame").desc()))
    rows = df.where("track_id > 0 AND frame IS NOT NULL").withColumn("back", back)
    per = rows.groupBy(*TRACK).agg(
        F.bool_or(has_outcome()).alias("has"),
        F.max("frame").alias("last"),
        F.count("*").alias("n"),
        F.bool_or((F.col("back") <= min_tail) & F.coalesce("at_border", F.lit(False))).alias("edge"),
        F.median(F.when(F.col("back") <= min_tail, F.col("area_px"))).alias("end_area"),
        F.max(F.when(F.col("back") <= tail, F.col("area_px"))).alias("peak"),
    )
    ends = rows.groupBy("movie_id").agg(F.max("frame").alias("movie_end"))
    return per.join(ends, "movie_id").where((~F.col("has")) & (F.col("last") < F.col("movie_end")) & (F.col("n") >= min_tail) & F.col("edge") & (F.col("peak") > 0) & (F.col("end_area") <= shrink * F.col("peak"))).select(*TRACK)


def flag_border_exits(df: DataFrame, **how) -> DataFrame:
    leaving = border_exits(df, **how).withColumn("leaves", F.lit(True))
    return df.join(leaving, TRACK, "left").withColumn("outcome", F.when(F.col("leaves") & ~has_outcome(), F.lit(EXIT)).otherwise(F.col("outcome"))).drop("leaves")


def propagate_outcome(df: DataFrame) -> DataFrame:
    """Every row gets the last outcome of its track, '' without any."""
    return df.withColumn("outcome", F.coalesce(F.last(F.when(has_outcome(), F.col("outcome")), ignorenulls=True).over(whole()), F.lit("")))


def adaptive_thresholds(df: DataFrame) -> DataFrame:
    """movie_id, max_jump_px and min_valid_frames from each movie's own steps and span."""
    base = Thresholds()
    steps = df.where(valid()).withColumn("step", step())
    per = steps.groupBy("movie_id").agg((F.max("frame") - F.min("frame") + 1).alias("span"))
    per = per.join(quantiles(steps, ["movie_id"], "step", [0.995]), "movie_id", "left")
    return per.select(
        "movie_id",
        F.when(F.col("n") >= 20, F.col("p")[0] * 1.5).otherwise(F.lit(base.max_jump_px)).alias("max_jump_px"),
        F.greatest(F.lit(3), F.bround(F.col("span") * 0.05)).cast("long").alias("min_valid_frames"),
    )


def frame_coherence(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Movies whose image and mask stacks differ in number or size of frames, with the reason."""
    side = lambda df, k: df.groupBy("movie_id").agg(F.count("*").alias(f"n_{k}"), F.max("height").alias(f"h_{k}"), F.max("width").alias(f"w_{k}"))
    both = side(images, "image").join(side(masks, "mask"), "movie_id", "full")
    reasons = F.array_compact(F.array(F.when(~F.col("n_image").eqNullSafe(F.col("n_mask")), F.lit("frame count")), F.when(~(F.col("h_image").eqNullSafe(F.col("h_mask")) & F.col("w_image").eqNullSafe(F.col("w_mask"))), F.lit("frame size"))))
    return both.select("movie_id", F.explode(reasons).alias("reason"))


def without_border_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("at_border", F.lit(False)))


def without_interpolated(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("interpolated", F.lit(False))) if "interpolated" in df.columns else df


def with_fate(df: DataFrame, fate: str) -> DataFrame:
    """All rows of the tracks that have the fate in some row, in any letter case."""
    ids = df.where(F.lower("outcome") == fate.lower()).select(*TRACK).distinct()
    return df.join(ids, TRACK, "left_semi")


def duplicate_observations(df: DataFrame) -> DataFrame:
    """movie_id, track_id, frame and how often, where more than once."""
    return df.groupBy(*TRACK, "frame").agg(F.count("*").alias("n")).where("n > 1")


def curation_progress(df: DataFrame) -> DataFrame:
    """Per movie: tracks, curated ones (flagged, mothers or daughters), and their percentage."""
    ids = df.where("track_id > 0").select(*TRACK).distinct()
    flagged = df.where(F.coalesce(~F.col("outcome").isin(NON_FLAG), F.lit(False))).select(*TRACK)
    links = df.where("parent_id > 0")
    curated = flagged.union(links.select("movie_id", "parent_id")).union(links.select(*TRACK)).distinct().withColumn("done", F.lit(1))
    return ids.join(curated, TRACK, "left").groupBy("movie_id").agg(F.count("*").alias("total"), F.count("done").alias("curated")).withColumn("percent", F.round(100.0 * F.col("curated") / F.col("total"), 6))


def repair_failures(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(movie_id, track_id) of short, broken or jumping tracks, whatever their outcome."""
    rows = df.where(valid()).withColumn("step", step()).withColumn("hop", F.col("frame") - F.lag("frame").over(along()))
    bad = (F.count("*") < t.min_valid_frames) | F.coalesce(F.max("hop") > t.gap_tolerance, F.lit(False)) | F.coalesce(F.max("step") > t.max_jump_px, F.lit(False))
    return rows.groupBy(*TRACK).agg(bad.alias("bad")).where("bad").select(*TRACK)


def quality_filter(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Rows of the tracks that do not fail; pixels are filtered alike with ``left_anti`` on the label."""
    return df.join(repair_failures(df, t), TRACK, "left_anti")


