"""Tracking errors and repair suggestions (A operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import along, TRACK, first_outcome, is_final, quarantined, step, valid
from ..schema import DEATH, EXIT, MITOSIS, Thresholds
from ..sources.work import stored
from . import lineage
from .quantiles import medians, quantiles


def track_flags(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One pass over valid, non-quarantined rows: short, gap, jump and no_outcome of every track, its life and whether it ends in Mitosis."""
    rows = df.where(valid() & ~quarantined()).withColumn("step", step()).withColumn("hop", F.col("frame") - F.lag("frame").over(along()))
    per = rows.groupBy(*TRACK).agg(
        F.count("*").alias("n"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.bool_or(is_final()).alias("final"),
        F.max("hop").alias("hop"),
        F.max("step").alias("step"),
        F.max_by("outcome", "frame").alias("last_outcome"),
    )
    over = lambda c, limit: F.coalesce(F.col(c) > limit, F.lit(False))
    return per.select(
        *TRACK, "first_frame", "last_frame", "n",
        ((F.col("n") < t.min_valid_frames) & ~F.col("final")).alias("short"),
        (over("hop", t.gap_tolerance) & ~F.col("final")).alias("gap"),
        over("step", t.max_jump_px).alias("jump"),
        (~F.col("final")).alias("no_outcome"),
        (F.col("last_outcome") == MITOSIS).alias("divides"),
    )


def division_life_outliers(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Dividing tracks whose life is far from the movie's median of four and more such tracks, by the robust scale."""
    lives = track_flags(df, t).where("divides").withColumn("life", (F.col("last_frame") - F.col("first_frame") + 1).cast("double"))
    lives = stored(lives.select(*TRACK, "life"), "lives")
    centre = quantiles(lives, ["movie_id"], "life", [0.5]).select("movie_id", F.col("p")[0].alias("med"), F.col("n").alias("k"))
    away = lives.join(centre, "movie_id").withColumn("away", F.abs(F.col("life") - F.col("med")))
    rows = away.join(medians(away, ["movie_id"], "away", "mad"), "movie_id").where("k >= 4 AND mad > 0")
    return rows.where(F.col("away") / (1.4826 * F.col("mad")) > t.mitosis_life_mad_k).select(*TRACK, "life")


def area_outliers(morphometry: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Objects far larger than their frame's median by the robust scale, of low solidity or elongated, with the reasons.

    Small areas are no outliers. ``morphometry`` has area and eccentricity, and solidity if that is to be judged.
    """
    per = morphometry.groupBy("movie_id", "frame").agg(F.median("area").alias("med"), F.stddev_pop("area").alias("std"))
    rows = morphometry.join(per, ["movie_id", "frame"])
    mads = rows.groupBy("movie_id", "frame").agg(F.median(F.abs(F.col("area") - F.col("med"))).alias("mad"))
    above = F.col("area") - F.col("med")
    far = F.when(F.col("mad") > 0, above / (1.4826 * F.col("mad")) > t.area_mad_k).when(F.col("std") > 0, above > t.area_mad_k * F.col("std"))
    kinds = [F.when(far, F.lit("area outlier"))]
    kinds += [F.when(F.col("solidity") < t.min_solidity, F.lit("low solidity"))] if "solidity" in morphometry.columns else []
    kinds += [F.when(F.col("eccentricity") > t.max_eccentricity, F.lit("elongated"))]
    rows = rows.join(mads, ["movie_id", "frame"])
    return rows.select("movie_id", "frame", "label", F.concat_ws("; ", F.array_compact(F.array(*kinds))).alias("reason")).where("reason <> ''")


def _nearest(asked: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """For each asked (movie_id, track_id, frame, x, y) the nearest of ``others`` (the same columns) in its frame that is another track, up to ``radius``.

    Gives the asked columns with distance, other, ox and oy; ties go to the smaller id. Only the two smallest ids of a place can be anybody's
    nearest. The search begins with a reach at which a cell of the densest frame holds few places, and goes on four times as far with
    those that found nobody, so that pairs grow with the rows, however crowded a frame is. Rows of equal size compress
    to small files, which Spark would broadcast whole: joins of stored rows merge.
    """
    place = ["movie_id", "frame", "x", "y"]
    first = Window.partitionBy(*place).orderBy("track_id")
    spots = others.select(*place, "track_id").distinct().withColumn("r", F.row_number().over(first)).where("r <= 2")
    spots = stored(spots.select("movie_id", "frame", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("track_id").alias("other")), "places")
    area = (F.max("ox") - F.min("ox") + 1) * (F.max("oy") - F.min("oy") + 1)
    crowd = spots.groupBy("movie_id", "frame").agg((F.count("*") / area).alias("d")).agg(F.max("d")).first()[0] or 0.0
    reach = float(radius)
    while crowd * reach * reach > 4 and reach > radius / 2**20:
        reach /= 4
    left, found = stored(asked.select("movie_id", "track_id", "frame", "x", "y").distinct(), "asked"), None
    while True:
        cell = lambda c, by=0.0, wide=2 * reach: F.floor((F.col(c) + F.lit(by)) / F.lit(wide))
        around = left.withColumn("cx", F.explode(F.sequence(cell("x", -reach), cell("x", reach)))).withColumn("cy", F.explode(F.sequence(cell("y", -reach), cell("y", reach))))
        pairs = around.join(spots.withColumns({"cx": cell("ox"), "cy": cell("oy")}).hint("merge"), ["movie_id", "frame", "cx", "cy"])
        pairs = pairs.where("other <> track_id").withColumn("distance", F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"))).where(F.col("distance") <= reach)
        best = pairs.groupBy("movie_id", "track_id", "frame", "x", "y").agg(F.min(F.struct("distance", "other", "ox", "oy")).alias("best"))
        best = stored(best.select("movie_id", "track_id", "frame", "x", "y", "best.*"), "nearest")
        found = best if found is None else found.unionByName(best)
        if reach >= radius:
            return found
        left, reach = stored(left.hint("merge").join(best, ["movie_id", "track_id", "frame", "x", "y"], "left_anti"), "asked"), min(float(radius), 4 * reach)


def identity_swaps(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Neighbours whose steps from a frame to the next are shorter with their identities exchanged."""
    rows = df.where(valid() & ~quarantined()).select(*TRACK, "frame", "pos_x", "pos_y", "area_px")
    after = rows.select(*TRACK, (F.col("frame") - 1).alias("frame"), F.col("pos_x").alias("x1"), F.col("pos_y").alias("y1"), F.col("area_px").alias("a1"))
    both = stored(rows.join(after, [*TRACK, "frame"]), "steps")
    at = both.select(*TRACK, "frame", F.col("pos_x").alias("x"), F.col("pos_y").alias("y"))
    near = _nearest(at, at, t.swap_radius_px).withColumnRenamed("distance", "separation").alias("n")
    a, b = both.alias("a"), both.alias("b")
    here = lambda k, track, x, y: (F.col("n.movie_id") == F.col(f"{k}.movie_id")) & (F.col("n.frame") == F.col(f"{k}.frame")) & (F.col(f"n.{track}") == F.col(f"{k}.track_id")) & (F.col(f"n.{x}") == F.col(f"{k}.pos_x")) & (F.col(f"n.{y}") == F.col(f"{k}.pos_y"))
    d = lambda p, q: F.hypot(F.col(f"{p}.x1") - F.col(f"{q}.pos_x"), F.col(f"{p}.y1") - F.col(f"{q}.pos_y"))
    turn = lambda p, q: F.abs(F.col(f"{p}.a1") - F.col(f"{q}.area_px"))
    pairs = near.join(a.hint("merge"), here("a", "track_id", "x", "y")).join(b.hint("merge"), here("b", "other", "ox", "oy")).select(
        F.col("a.movie_id").alias("movie_id"), F.col("a.frame").alias("frame"), F.col("a.track_id").alias("ta"), F.col("b.track_id").alias("tb"), "separation",
        d("a", "a").alias("d_ii"), d("b", "b").alias("d_jj"), d("a", "b").alias("d_ij"), d("b", "a").alias("d_ji"),
        F.coalesce(turn("a", "b") + turn("b", "a") < turn("a", "a") + turn("b", "b"), F.lit(False)).alias("area_corroborates"),
    )
    nearest = Window.partitionBy("movie_id", "frame", "ta").orderBy("separation", "tb")  # a track with several rows in a frame
    pairs = pairs.withColumn("r", F.row_number().over(nearest)).where("r = 1")
    gain = (F.col("d_ii") + F.col("d_jj")) - (F.col("d_ij") + F.col("d_ji"))
    found = pairs.where((F.col("d_ij") < F.col("d_ii")) & (F.col("d_ji") < F.col("d_jj")) & (gain >= F.greatest(t.swap_margin * (F.col("d_ii") + F.col("d_jj")), F.lit(t.swap_min_improvement_px))))
    return found.select("movie_id", "frame", F.least("ta", "tb").alias("track_a"), F.greatest("ta", "tb").alias("track_b"), F.round("separation", 2).alias("separation"), F.round(gain, 2).alias("cost_improvement"), "area_corroborates").dropDuplicates(["movie_id", "frame", "track_a", "track_b"])


def mass_balance(df: DataFrame, entries: DataFrame | None = None, threshold: int = 1) -> DataFrame:
    """Changes of the count between consecutive frames that divisions, border entries and exits do not explain.

    ``entries`` (movie_id, track_id, frame) are the label pixels' border contacts; without them no entry is credited.
    """
    rows = df.where("track_id > 0 AND frame IS NOT NULL").where(~quarantined()).select(*TRACK, "frame", "outcome", "parent_id")
    per = rows.groupBy(*TRACK).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.bool_or(F.col("parent_id") > 0).alias("born"), first_outcome().alias("fate"))
    here = rows.select(*TRACK, "frame").distinct()
    count = here.groupBy("movie_id", "frame").agg(F.count("*").alias("n"))
    came = here.join(here.withColumn("frame", F.col("frame") + 1), [*TRACK, "frame"], "left_anti").join(per, TRACK)
    went = here.join(here.withColumn("frame", F.col("frame") - 1), [*TRACK, "frame"], "left_anti").join(per, TRACK)
    if entries is not None:
        came = came.join(entries.select(*TRACK, "frame").distinct().withColumn("edge", F.lit(True)), [*TRACK, "frame"], "left")
    edge = F.coalesce(F.col("edge"), F.lit(False)) if entries is not None else F.lit(False)
    born = F.coalesce(F.col("born"), F.lit(False)) & (F.col("first") == F.col("frame"))
    enters = edge & (F.col("first") == F.col("frame"))
    exits = F.coalesce(F.col("fate").isin(EXIT, DEATH), F.lit(False)) & (F.col("last") == F.col("frame"))
    ids = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("track_id"))))
    came = came.groupBy("movie_id", (F.col("frame") - 1).alias("frame")).agg(F.count_if(born).alias("n_born"), F.count_if(enters).alias("n_enter"), ids(~born & ~enters).alias("appeared"))
    went = went.groupBy("movie_id", "frame").agg(F.count_if(exits).alias("n_exit"), ids(~exits).alias("disappeared"))
    after = count.select("movie_id", (F.col("frame") - 1).alias("frame"), F.col("n").alias("n_curr"))
    out = count.withColumnRenamed("n", "n_prev").join(after, ["movie_id", "frame"]).join(came, ["movie_id", "frame"], "left").join(went, ["movie_id", "frame"], "left")
    zero, none = F.lit(0), F.array().cast("array<bigint>")
    out = out.withColumns({"observed_delta": F.col("n_curr") - F.col("n_prev"), "expected_delta": F.coalesce("n_born", zero) + F.coalesce("n_enter", zero) - F.coalesce("n_exit", zero), "appeared": F.coalesce("appeared", none), "disappeared": F.coalesce("disappeared", none)})
    out = out.withColumn("residual", F.col("observed_delta") - F.col("expected_delta"))
    return out.where((F.abs("residual") >= threshold) | (F.size("appeared") > 0) | (F.size("disappeared") > 0)).select("movie_id", "frame", "n_prev", "n_curr", "observed_delta", "expected_delta", "residual", "appeared", "disappeared")


def relink_suggestions(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """For each gap, the other track nearest to where the broken one should be in the first missing frame."""
    rows = df.where(valid()).select(*TRACK, "frame", "pos_x", "pos_y")
    prev = lambda c: F.col(c) - F.lag(c).over(along())
    gaps = rows.withColumns({"next": F.lead("frame").over(along()), "vx": F.coalesce(prev("pos_x"), F.lit(0.0)), "vy": F.coalesce(prev("pos_y"), F.lit(0.0))}).where(F.col("next") > F.col("frame") + 1).where(~quarantined())
    gaps = gaps.select(*TRACK, (F.col("frame") + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"), (F.col("pos_x") + F.col("vx")).alias("expected_x"), (F.col("pos_y") + F.col("vy")).alias("expected_y"))
    gaps = stored(gaps.distinct(), "gaps")
    asked = gaps.select(*TRACK, F.col("gap_start").alias("frame"), F.col("expected_x").alias("x"), F.col("expected_y").alias("y"))
    starts = gaps.select("movie_id", F.col("gap_start").alias("frame")).distinct()
    others = rows.select(*TRACK, "frame", F.col("pos_x").alias("x"), F.col("pos_y").alias("y")).join(starts, ["movie_id", "frame"], "left_semi")
    near = _nearest(asked, others, t.relink_radius_px)
    best = gaps.join(near.select(*TRACK, F.col("frame").alias("gap_start"), F.col("x").alias("expected_x"), F.col("y").alias("expected_y"), F.struct("distance", F.col("other").alias("candidate"), F.col("ox").alias("pos_x"), F.col("oy").alias("pos_y")).alias("best")), [*TRACK, "gap_start", "expected_x", "expected_y"])
    return best.select(*TRACK, "gap_start", "gap_end", (F.col("gap_end") - F.col("gap_start") + 1).alias("missing"), "expected_x", "expected_y", "best.candidate", "best.pos_x", "best.pos_y", "best.distance")


def gap_fills(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Missing frames of gaps of at most ``max_gap_fill`` frames, with the linearly interpolated position."""
    lead = lambda c: F.lead(c).over(along())
    rows = df.where(valid()).select(*TRACK, "frame", "pos_x", "pos_y").withColumns({"next": lead("frame"), "x1": lead("pos_x"), "y1": lead("pos_y")})
    gaps = rows.where((F.col("next") > F.col("frame") + 1) & (F.col("next") - F.col("frame") - 1 <= t.max_gap_fill))
    part = (F.col("at") - F.col("frame")) / (F.col("next") - F.col("frame"))
    filled = gaps.withColumn("at", F.explode(F.sequence(F.col("frame") + 1, F.col("next") - 1)))
    return filled.select(*TRACK, F.col("at").alias("frame"), (F.col("pos_x") + part * (F.col("x1") - F.col("pos_x"))).alias("pos_x"), (F.col("pos_y") + part * (F.col("y1") - F.col("pos_y"))).alias("pos_y"))


def predicted_paths(df: DataFrame, asked: DataFrame) -> DataFrame:
    """Positions of tracks in the asked (movie_id, track_id, frame): linear between the rows around a frame, flat before the first and after the last.

    A track without any row has no prediction. Rows and asked frames of a track meet in one window, each asked frame once.
    """
    known = df.where(valid()).select(*TRACK, "frame", F.struct(F.col("frame").alias("f"), F.col("pos_x").alias("x"), F.col("pos_y").alias("y")).alias("at"))
    both = known.withColumn("ask", F.lit(0)).unionByName(asked.select(*TRACK, "frame").distinct().withColumn("ask", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*TRACK).orderBy("frame", "ask")
    rows = both.withColumns({"a": F.last("at", ignorenulls=True).over(order), "b": F.first("at", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.where("ask = 1 AND (a IS NOT NULL OR b IS NOT NULL)")
    part = (F.col("frame") - F.col("a.f")) / (F.col("b.f") - F.col("a.f"))
    between = lambda c: F.when(F.col("a").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull() | (F.col("a.f") == F.col("frame")), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + part * (F.col(f"b.{c}") - F.col(f"a.{c}")))
    return rows.select(*TRACK, "frame", between("x").alias("pos_x"), between("y").alias("pos_y"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0) and count over the range of each movie's values; the maximum lies in the last bin."""
    ends = df.groupBy("movie_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))).otherwise(0)
    return df.where(F.col(value).isNotNull()).join(ends, "movie_id").groupBy("movie_id", place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def flagged_cells(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """movie_id, track_id, kind, first_frame of short, broken and jumping tracks and of lineage violations."""
    flags = track_flags(df, t)
    kinds = F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in ("short", "gap", "jump"))))
    lines = lineage.violations(df).join(lineage.spans(df).select(*TRACK, "first_frame"), TRACK, "left")
    return flags.select(*TRACK, F.explode(kinds).alias("kind"), "first_frame").unionByName(lines.select(*TRACK, "kind", "first_frame"))
