"""Feature, window and summary tables of trajectories (F operators).

Rows of a track are ordered by frame. Every window is over (movie_id, track_id) by frame, so one exchange and sort serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import along, so_far, TRACK, first_outcome, quarantined, step, valid
from ..schema import MITOSIS

E_INVERSE = 0.36787944117144233


def step_features(df: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """step_disp (0 in the first row), cum_path, and net_disp from the first row, for valid, non-quarantined rows."""
    px = F.lit(float(pixel_size))
    rows = df.where(valid() & ~quarantined()).withColumn("step_disp", F.coalesce(step(), F.lit(0.0)) * px)
    net = F.hypot(F.col("pos_x") - F.first("pos_x").over(so_far()), F.col("pos_y") - F.first("pos_y").over(so_far())) * px
    return rows.withColumn("cum_path", F.sum("step_disp").over(so_far())).withColumn("net_disp", net)


def speed(df: DataFrame, interval: float = 0.5, times: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """dt, speed and gap_antes by the clock of ``times`` (movie_id, frame, tempo_h, modal_h), or else by the frame interval."""
    if times is not None:
        df = df.join(times.select("movie_id", "frame", "tempo_h", "modal_h"), ["movie_id", "frame"], "left")
        dt, modal = F.col("tempo_h") - F.lag("tempo_h").over(along()), F.col("modal_h")
    else:
        dt, modal = (F.col("frame") - F.lag("frame").over(along())) * F.lit(float(interval)), F.lit(float(interval))
    out = df.withColumn("dt", dt).withColumn("speed", F.when(F.col("dt") > 0, F.col("step_disp") / F.col("dt")))
    return out.withColumn("gap_antes", F.coalesce(F.col("dt") > modal + tolerance, F.lit(False)))


def joined_features(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left joins on (movie_id, track_id, frame); columns that are there already are dropped from the joined table."""
    for t in tables:
        new = [c for c in t.columns if c in (*TRACK, "frame") or c not in df.columns]
        df = df.join(t.select(*new), [*TRACK, "frame"], "left")
    return df


def middle_lifetime(df: DataFrame, interval: float = 0.5, times: DataFrame | None = None) -> DataFrame:
    """lifetime_h on the middle row of each track, null elsewhere: of its frames, or with ``times`` (see ``time_table``) by the clock.

    By the clock it is the time from the first to the last row that has one, and a usual interval.
    """
    whole = Window.partitionBy(*TRACK)
    place, n = F.row_number().over(along()) - 1, F.count("*").over(whole)
    if times is None:
        life = (F.max("frame").over(whole) - F.min("frame").over(whole) + 1) * F.lit(float(interval))
        return df.withColumn("lifetime_h", F.when(place == F.floor(n / 2), life))
    clock = times.select("movie_id", "frame", F.col("tempo_h").alias("clock_h"), F.col("modal_h").alias("usual_h"))
    life = F.max("clock_h").over(whole) - F.min("clock_h").over(whole) + F.coalesce(F.max("usual_h").over(whole), F.lit(0.0))
    return df.join(clock, ["movie_id", "frame"], "left").withColumn("lifetime_h", F.when(place == F.floor(n / 2), life)).select(*df.columns, "lifetime_h")


def sliding_windows(features: DataFrame, size: int = 5, measures: tuple[str, ...] = ("area_px",)) -> DataFrame:
    """Centred windows of rows, clamped at the ends of a track, of two rows and more; needs ``step_disp``."""
    h = max(1, size // 2)
    w, inner = along().rowsBetween(-h, h), along().rowsBetween(-h + 1, h)
    at = lambda f, c: f(c).over(w)
    rows = features.withColumn("n_rows", F.count("*").over(w))
    path = F.sum("step_disp").over(inner)  # without the step into the window's first row; a track's first step is 0
    net = F.hypot(at(F.last, "pos_x") - at(F.first, "pos_x"), at(F.last, "pos_y") - at(F.first, "pos_y"))
    span = at(F.last, "frame") - at(F.first, "frame")
    out = rows.select(
        *TRACK,
        F.col("frame").alias("frame_center"),
        "n_rows",
        net.alias("displacement"),
        path.alias("delta_path"),
        span.alias("span"),
        (at(F.stddev_pop, "area_px") / at(F.avg, "area_px")).alias("area_cv"),
        F.regr_slope("area_px", "frame").over(w).alias("area_slope"),
        *(at(F.avg, m).alias(f"mean_{m}") for m in measures),
        *((F.last(m, ignorenulls=True).over(w) - F.first(m, ignorenulls=True).over(w)).alias(f"delta_{m}") for m in measures),
    ).where("n_rows >= 2")
    return out.withColumn("persistence", F.when(F.col("delta_path") > 0, F.col("displacement") / F.col("delta_path"))).withColumn("speed_mean", F.when(F.col("span") > 0, F.col("delta_path") / F.col("span")))


def confinement(net: Column, total: Column, n: Column) -> Column:
    return F.when(n < 2, F.lit(None)).when(total > 0, net / total).otherwise(0.0)


def motility(df: DataFrame, interval: float = 1.0, max_lag: int = 10) -> DataFrame:
    """Per track: confinement_ratio, mean_turning_angle, diffusion_coeff, anomalous_exponent, persistence_time. Lags count rows."""
    rows = df.where(valid())
    dx, dy = F.col("pos_x") - F.lag("pos_x").over(along()), F.col("pos_y") - F.lag("pos_y").over(along())
    rows = rows.select(*TRACK, "frame", "pos_x", "pos_y", dx.alias("dx"), dy.alias("dy"), F.row_number().over(along()).alias("rn"))
    rows = rows.withColumns({"len": F.hypot("dx", "dy"), "dx0": F.lag("dx").over(along()), "dy0": F.lag("dy").over(along())}).withColumn("len0", F.lag("len").over(along()))
    cos = (F.col("dx") * F.col("dx0") + F.col("dy") * F.col("dy0")) / (F.col("len") * F.col("len0"))
    angle = F.when((F.col("len") > 0) & (F.col("len0") > 0), F.abs(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    base = rows.withColumn("angle", angle).groupBy(*TRACK).agg(
        F.count("*").alias("n"),
        F.sum("len").alias("total"),
        F.hypot(F.max_by("pos_x", "rn") - F.min_by("pos_x", "rn"), F.max_by("pos_y", "rn") - F.min_by("pos_y", "rn")).alias("net"),
        F.avg("angle").alias("mean_turning_angle"),
    )
    lags = rows.withColumns({f"d{k}": F.pow(F.lead("pos_x", k).over(along()) - F.col("pos_x"), 2) + F.pow(F.lead("pos_y", k).over(along()) - F.col("pos_y"), 2) for k in range(1, max_lag + 1)})
    msd = lags.groupBy(*TRACK).agg(*(F.avg(f"d{k}").alias(f"d{k}") for k in range(1, max_lag + 1)))
    long = msd.select(*TRACK, F.posexplode(F.array(*(F.col(f"d{k}") for k in range(1, max_lag + 1)))).alias("p", "msd")).where("msd is not null").withColumn("lag", (F.col("p") + 1) * F.lit(float(interval)))
    ln = lambda c: F.when(F.col("msd") > 0, F.ln(c))
    fit = long.groupBy(*TRACK).agg(
        F.when(F.count("*") >= 2, F.regr_slope("msd", "lag") / 4).alias("diffusion_coeff"),
        F.when(F.count_if(F.col("msd") > 0) >= 2, F.regr_slope(ln("msd"), ln("lag"))).alias("anomalous_exponent"),
    )
    moving = rows.where("len > 0").select(*TRACK, "frame", (F.col("dx") / F.col("len")).alias("ux"), (F.col("dy") / F.col("len")).alias("uy"))
    corr = moving.withColumns({f"c{k}": F.lead("ux", k).over(along()) * F.col("ux") + F.lead("uy", k).over(along()) * F.col("uy") for k in range(1, max_lag + 1)})
    ac = corr.groupBy(*TRACK).agg(F.count("*").alias("m"), *(F.avg(f"c{k}").alias(f"c{k}") for k in range(1, max_lag + 1)))
    first_below = F.coalesce(*(F.when(F.col(f"c{k}") < E_INVERSE, F.lit(float(k))) for k in range(1, max_lag + 1)))
    ac = ac.where("m >= 3").select(*TRACK, (first_below * F.lit(float(interval))).alias("persistence"))
    out = base.join(fit, TRACK, "left").join(ac, TRACK, "left")
    return out.select(
        *TRACK,
        confinement(F.col("net"), F.col("total"), F.col("n")).alias("confinement_ratio"),
        "mean_turning_angle",
        "diffusion_coeff",
        "anomalous_exponent",
        F.when(F.col("n") >= 4, F.col("persistence")).alias("persistence_time"),
    )


def track_summary(df: DataFrame, interval: float = 0.5, pixel_size: float = 1.0) -> DataFrame:
    """One row for each track of valid rows."""
    rows = df.where(valid()).withColumn("step", step() * F.lit(float(pixel_size)))
    mothers = df.where("parent_id > 0").select("movie_id", F.col("parent_id").alias("track_id")).distinct().withColumn("is_parent", F.lit(True))
    net = F.hypot(F.max_by("pos_x", "frame") - F.min_by("pos_x", "frame"), F.max_by("pos_y", "frame") - F.min_by("pos_y", "frame")) * F.lit(float(pixel_size))
    per = rows.groupBy(*TRACK).agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count("*").alias("n_frames"),
        F.mode("fase", True).alias("fase"),
        F.coalesce(first_outcome(), F.lit("none")).alias("final_outcome"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_path"),
        net.alias("net_displacement"),
        F.avg("area_px").alias("mean_area"),
        F.max("area_px").alias("max_area"),
    )
    life = (F.col("last_frame") - F.col("first_frame") + 1) * F.lit(float(interval))
    out = per.join(mothers, TRACK, "left").withColumn("lifetime_h", life)
    return out.select(
        *TRACK, "first_frame", "last_frame", "n_frames", "lifetime_h", "fase", "final_outcome",
        ((F.col("final_outcome") == MITOSIS) | F.coalesce("is_parent", F.lit(False))).alias("is_mitotic"),
        "total_path", "net_displacement",
        F.when(F.col("last_frame") > F.col("first_frame"), F.col("total_path") / ((F.col("last_frame") - F.col("first_frame")) * float(interval))).otherwise(0.0).alias("mean_speed"),
        F.when(F.col("total_path") > 0, F.col("net_displacement") / F.col("total_path")).otherwise(0.0).alias("directionality"),
        (F.col("mean_area") * float(pixel_size) ** 2).alias("mean_area"),
        (F.col("max_area") * float(pixel_size) ** 2).alias("max_area"),
    )
