"""Confidence scores, review queues and validation (T operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import along, TRACK, first_outcome, is_final, quarantined, step, valid
from ..schema import DEATH, EXIT, PENALTIES, Thresholds
from ..sources.work import stored
from .anomaly import track_flags
from .quantiles import medians

TRAITS = ["area", "mobility", "lifetime"]
FREE_Z, TOLERANCE, LEAST_TRACKS = 1.0, 1.25, 5
REVIEW_BELOW, OUTLIER_BELOW, FAR_BELOW = 0.85, 0.5, 0.75


def track_metrics(df: DataFrame) -> DataFrame:
    """lifetime (frames), mobility (mean step) and area (mean) of every track."""
    rows = df.where(valid() & ~quarantined()).withColumn("step", step())
    return rows.groupBy(*TRACK).agg(F.count_distinct("frame").cast("double").alias("lifetime"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("mobility"), F.avg("area_px").alias("area"))


def coverage(df: DataFrame) -> DataFrame:
    """Per movie, the share of tracks with a final outcome."""
    per = df.where(valid() & ~quarantined()).groupBy(*TRACK).agg(F.bool_or(is_final()).cast("double").alias("f"))
    return per.groupBy("movie_id").agg(F.avg("f").alias("coverage"))


def population(metrics: DataFrame, robust: bool = True) -> DataFrame:
    """movie_id, trait, center, scale; null for fewer than five tracks or without spread."""
    by = ["movie_id", "trait"]
    long = metrics.unpivot(["movie_id", "track_id"], TRAITS, "trait", "value").where("value is not null")
    long = stored(long, "traits") if robust else long
    out = long.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("center"), F.stddev_pop("value").alias("std"))
    if robust:
        middle = medians(long, by, "value", "center")
        away = long.join(middle, by).withColumn("away", F.abs(F.col("value") - F.col("center")))
        out = out.drop("center").join(middle, by).join(medians(away, by, "away", "mad"), by).withColumn("mad", 1.4826 * F.col("mad"))
    scale = F.when(F.col("mad") > 1e-9, F.col("mad")).otherwise(F.col("std")) if robust else F.col("std")
    out = out.withColumn("scale", scale)
    fine = (F.col("n") >= LEAST_TRACKS) & (F.col("scale") > 1e-9)
    return out.select("movie_id", "trait", F.when(fine, F.col("center")).alias("center"), F.when(fine, F.col("scale")).alias("scale"))


def deviation(value: Column, center: Column, scale: Column) -> Column:
    z = F.abs(value - center) / scale
    return F.when(value.isNull() | scale.isNull() | (z <= FREE_Z), F.lit(1.0)).otherwise(F.exp(-0.5 * F.pow((z - FREE_Z) / TOLERANCE, 2)))


def _traces(df: DataFrame) -> DataFrame:
    """What the end and the areas of every track say about its outcome."""
    back = F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.col("frame").desc()))
    before = F.lag("area_px").over(along())
    rows = df.where(valid() & ~quarantined()).withColumn("back", back).withColumn("turn", F.abs(F.col("area_px") - before) / F.greatest(before, F.lit(1.0)))
    ends = df.where(valid()).groupBy("movie_id").agg(F.max("frame").alias("movie_end"))
    per = rows.groupBy(*TRACK).agg(
        F.count("*").alias("rows"), F.count_distinct("frame").alias("frames"), F.max("frame").alias("last"), F.coalesce(first_outcome(), F.lit("")).alias("outcome"),
        F.bool_or((F.col("back") <= 3) & F.coalesce("at_border", F.lit(False))).alias("edge"),
        F.median(F.when(F.col("back") <= 3, F.col("area_px"))).alias("end_area"), F.max("area_px").alias("peak"), F.max("turn").alias("turn"),
    )
    return per.join(ends, "movie_id").withColumn("vanished", F.col("last") < F.col("movie_end"))


def incoherent() -> Column:
    """Over ``_traces``: an exit that neither touches the border nor vanishes, or a death that neither shrinks nor vanishes."""
    leaves = (F.col("outcome") == EXIT) & ~F.col("edge") & ~F.col("vanished")
    dies = (F.col("outcome") == DEATH) & (F.col("rows") >= 4) & (F.col("end_area") > 0.8 * F.col("peak")) & ~F.col("vanished")
    return F.coalesce(leaves | dies, F.lit(False))


def scores(df: DataFrame, t: Thresholds = Thresholds(), weights: dict[str, float] | None = None, blend: bool = False) -> DataFrame:
    """One row for each track: sub-scores by trait, their sum of losses as ``score``, ``deviation``, reasons and the weakest trait.

    With ``blend`` the sub-score of a trait is its score for errors times that for deviation, and traits far from the movie's are reasons.
    """
    w = PENALTIES | (weights or {})
    flags = track_flags(df, t).join(_traces(df), TRACK).join(track_metrics(df), TRACK).join(coverage(df), "movie_id")
    lost = lambda flag, k: F.when(flag, F.lit(w[k])).otherwise(0.0)
    wrong, jumps = incoherent(), F.coalesce((F.col("rows") >= 3) & (F.col("turn") > 1), F.lit(False))
    keep = lambda loss: F.greatest(F.lit(0.0), F.bround(1 - loss, 3))
    once = F.col("frames") <= 1
    rows = flags.withColumns({
        "s_area": keep(lost(jumps, "area_jump")),
        "s_mobility": F.when(once, 0.0).otherwise(keep(lost(F.col("jump"), "jump"))),
        "s_lifetime": F.when(once, 0.0).otherwise(keep(lost(F.col("gap"), "gap"))),
        "s_outcome": keep(F.when(F.col("no_outcome"), F.lit(w["no_outcome"]) * F.col("coverage")).otherwise(0.0) + F.when(wrong, F.lit(0.25)).otherwise(0.0)),
        "reasons": F.array_compact(F.array(F.when(F.col("no_outcome"), F.lit("no final outcome")), F.when(F.col("jump"), F.lit("impossible jump")), F.when(F.col("gap"), F.lit("temporal gap")), F.when(jumps, F.lit("sudden area change")), F.when(wrong, F.lit("outcome incoherent")), F.when(once, F.lit("single frame")))),
    })
    wide = population(track_metrics(df)).groupBy("movie_id").pivot("trait", TRAITS).agg(F.first("center").alias("center"), F.first("scale").alias("scale"))
    rows = rows.join(wide, "movie_id", "left").withColumns({f"d_{k}": deviation(F.col(k), F.col(f"{k}_center"), F.col(f"{k}_scale")) for k in TRAITS})
    far = F.array_compact(F.array(*(F.when(F.col(f"d_{k}") < FAR_BELOW, F.lit(f"{k} far from the movie's")) for k in TRAITS)))
    rows = rows.withColumn("far", far).withColumns({f"d_{k}": F.bround(f"d_{k}", 3) for k in TRAITS})
    if blend:
        rows = rows.withColumns({f"s_{k}": F.bround(F.col(f"s_{k}") * F.col(f"d_{k}"), 3) for k in TRAITS} | {"reasons": F.concat("reasons", "far")})
    total = lambda names: F.bround(F.greatest(F.lit(0.0), 1 - sum(((1 - F.col(n)) for n in names), F.lit(0.0))), 6)
    subs = [("s_area", "area"), ("s_mobility", "mobility"), ("s_lifetime", "lifetime"), ("s_outcome", "outcome")]
    weakest = F.array_sort(F.array(*(F.struct(F.col(c).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("trait")) for i, (c, n) in enumerate(subs))))[0]["trait"]
    return rows.select(*TRACK, "first_frame", "last_frame", "outcome", *(c for c, _ in subs), total([c for c, _ in subs]).alias("score"), total([f"d_{k}" for k in TRAITS]).alias("deviation"), "reasons", weakest.alias("weakest"))


def queue(scored: DataFrame) -> DataFrame:
    """The bucket of every track: review, outlier (rare but not in review) or accept."""
    bucket = F.when(F.col("score") < REVIEW_BELOW, "review").when(F.col("deviation") < OUTLIER_BELOW, "outlier").otherwise("accept")
    return scored.withColumn("bucket", bucket)


def validation_sample(accepted: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """The n tracks of each movie with the smallest seeded hashes: the same ones in every run."""
    order = Window.partitionBy("movie_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), *TRACK)), "track_id")
    return accepted.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n).drop("draw")


# Actions that do not mean that the automatic annotation was wrong.
NON_ERROR = ["validation_sample", "bulk_accept", "set_treatment", "shuffle", "harmonize"]


def edit_log(sample: DataFrame, audit: DataFrame) -> DataFrame:
    """movie_id, track_id, ts, action, detail: what was done to sampled tracks, from the log (movie_id, ts, action, ids, detail)."""
    done = audit.where(~F.col("action").isin(NON_ERROR)).select("movie_id", "ts", "action", "detail", F.explode("ids").alias("track_id"))
    return done.join(sample.select(*TRACK).distinct(), TRACK, "left_semi").select(*TRACK, "ts", "action", "detail")


def tally(sample: DataFrame, audit: DataFrame, checked: DataFrame) -> DataFrame:
    """Each sampled track with its number of edits, the latest of them, and whether it is pending, correct, modified or fixed."""
    edits = edit_log(sample, audit).groupBy(*TRACK).agg(F.count("*").alias("edits"), F.max("ts").alias("last_edit"))
    rows = sample.select(*TRACK).distinct().join(edits, TRACK, "left").join(checked.select(*TRACK).distinct().withColumn("checked", F.lit(True)), TRACK, "left")
    seen, wrong = F.coalesce("checked", F.lit(False)), F.col("edits").isNotNull()
    status = F.when(wrong & seen, "fixed").when(wrong, "modified").when(seen, "correct").otherwise("pending")
    return rows.select(*TRACK, F.coalesce("edits", F.lit(0)).alias("edits"), "last_edit", status.alias("status"))


def wilson(errors: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Point estimate and upper 95 % bound of an error rate, (0, 1) without a sample."""
    p = errors / n
    high = (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, F.round(p, 4)).otherwise(0.0), F.when(n > 0, F.round(F.least(F.lit(1.0), high), 4)).otherwise(1.0)


def calibration(scored: DataFrame, errors: DataFrame, bins: int = 5) -> DataFrame:
    """Error rate and number of tracks by score, in equal bins from just under the lowest score to 1."""
    rows = scored.join(errors.select(*TRACK).distinct().withColumn("wrong", F.lit(1.0)), TRACK, "left").withColumn("wrong", F.coalesce("wrong", F.lit(0.0)))
    low = scored.groupBy("movie_id").agg((F.floor(F.least(F.lit(REVIEW_BELOW), F.min("score")) * 20) / 20).alias("low"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("low")) * bins / (1 - F.col("low")))).cast("long")
    return rows.join(low, "movie_id").groupBy("movie_id", place.alias("bin")).agg(F.avg("wrong").alias("error_rate"), F.count("*").alias("n"))


def reliability(scored: DataFrame, errors: DataFrame) -> DataFrame:
    """Error rates of the tracks with a low and with a high sub-score, by trait."""
    rows = scored.join(errors.select(*TRACK).distinct().withColumn("wrong", F.lit(1.0)), TRACK, "left").withColumn("wrong", F.coalesce("wrong", F.lit(0.0)))
    long = rows.unpivot(["movie_id", "wrong"], ["s_area", "s_mobility", "s_lifetime", "s_outcome"], "trait", "s")
    return long.groupBy("movie_id", F.substring("trait", 3, 20).alias("trait"), (F.col("s") < REVIEW_BELOW).alias("low")).agg(F.avg("wrong").alias("error_rate"), F.count("*").alias("n"))


def validated(df: DataFrame, roots: DataFrame, reviewed: DataFrame, cells: DataFrame) -> DataFrame:
    """Tracks whose root was reviewed or that were validated one by one, among those that exist."""
    ids = df.select(*TRACK).distinct()
    by_root = roots.join(reviewed, ["movie_id", "root_id"], "left_semi").select(*TRACK)
    return ids.join(by_root.union(cells.select(*TRACK)).distinct(), TRACK, "left_semi")
