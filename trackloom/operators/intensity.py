"""Intensities inside and around objects (G operators on channel tables)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored
from .pixels import OBJECT, around, city_distance, ellipse_rings, eroded, rings
from .quantiles import quantiles

PIXEL = ["movie_id", "frame", "y", "x"]


def background(channel: DataFrame, mask: DataFrame, frames: DataFrame, how: str = "non_cell", far: int = 30) -> DataFrame:
    """bg and free (share of pixels that serve) per movie, channel and frame: median outside objects, median far from them, or the minimum."""
    key = ["movie_id", "channel", "frame"]
    if how == "minimum":
        return channel.groupBy(*key).agg(F.min("value").alias("bg"), F.lit(1.0).alias("free"))
    outside = channel.join(mask.select(*PIXEL), PIXEL, "left_anti").groupBy(*key).agg(F.median("value").alias("bg"), F.count("*").alias("n"))
    total = channel.groupBy(*key).agg(F.count("*").alias("all"))
    if how == "far_from_cells":
        away = channel.join(city_distance(mask, frames), PIXEL).where(F.col("distance").isNull() | (F.col("distance") > far))
        distant = away.groupBy(*key).agg(F.median("value").alias("far_bg"), F.count("*").alias("far_n"))
        return total.join(outside, key, "left").join(distant, key, "left").select(*key, F.coalesce("far_bg", "bg", F.lit(0.0)).alias("bg"), (F.coalesce("far_n", F.lit(0)) / F.col("all")).alias("free"))
    return total.join(outside, key, "left").select(*key, F.coalesce("bg", F.lit(0.0)).alias("bg"), (F.coalesce("n", F.lit(0)) / F.col("all")).alias("free"))


def region_background(channel: DataFrame, region: DataFrame) -> DataFrame:
    """bg and free as ``background`` gives them, from drawn pixels: ``region`` has movie_id, y, x and, if it changes, frame; 0 where it holds no pixel."""
    key = ["movie_id", "channel", "frame"]
    at = [c for c in PIXEL if c in region.columns]
    drawn = channel.join(region.select(*at), at, "left_semi").groupBy(*key).agg(F.median("value").alias("bg"), F.count("*").alias("n"))
    total = channel.groupBy(*key).agg(F.count("*").alias("all"))
    return total.join(drawn, key, "left").select(*key, F.coalesce("bg", F.lit(0.0)).alias("bg"), (F.coalesce("n", F.lit(0)) / F.col("all")).alias("free"))


def compartment_stats(channel: DataFrame, mask: DataFrame, bg: DataFrame, gap: int = 1, width: int = 3, ellipse: bool = False, neighbor_gap: int = 0) -> DataFrame:
    """Statistics of background-corrected values in nucleus, ring (of the contour or of an ellipse) and both, one row for each object, and their ratios."""
    ring = (ellipse_rings if ellipse else rings)(mask, gap, width, neighbor_gap)
    parts = mask.select(*OBJECT, "y", "x", F.array(F.lit("nuc"), F.lit("cell")).alias("p")).unionByName(ring.select(*OBJECT, "y", "x", F.array(F.lit("ring"), F.lit("cell")).alias("p")))
    values = channel.join(bg.select("movie_id", "channel", "frame", "bg"), ["movie_id", "channel", "frame"]).withColumn("v", F.greatest(F.col("value") - F.col("bg"), F.lit(0.0)))
    rows = parts.join(values, PIXEL).select("channel", *OBJECT, F.explode("p").alias("part"), "v")
    wide = rows.groupBy("channel", *OBJECT).pivot("part", ["nuc", "ring", "cell"]).agg(
        F.avg("v").alias("mean"), F.median("v").alias("median"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"), F.percentile("v", F.lit(0.9)).alias("p90"), F.count("v").alias("px"),
    )
    ratio = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a) / F.col(b))
    wide = wide.withColumns({f"{p}_px": F.coalesce(f"{p}_px", F.lit(0)) for p in ("nuc", "ring", "cell")})
    return wide.withColumns({"cn": ratio("ring_median", "nuc_median"), "cn_mean": ratio("ring_mean", "nuc_mean"), "nc": ratio("nuc_median", "ring_median"), "nc_mean": ratio("nuc_mean", "ring_mean")})


def crowded(bg: DataFrame, least: float = 0.02) -> DataFrame:
    return bg.where(F.col("free") < least)


def spaced_frames(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` evenly spaced frames of each movie, the first and the last among them."""
    order = Window.partitionBy("movie_id").orderBy("frame")
    ids = rows.select("movie_id", "frame").distinct().withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("movie_id"))})
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("n") - 1) / max(1, n - 1)))
    return ids.where((F.col("n") <= n) | F.array_contains(places, F.col("i").cast("long"))).select("movie_id", "frame")


def ring_sweep(channel: DataFrame, mask: DataFrame, bg: DataFrame, widths: tuple[int, ...] = (2, 3, 4, 6, 8, 10, 12), gap: int = 1, frames: int = 8) -> DataFrame:
    """Median ratio, sizes and share of missing ratios by ring width on evenly spaced frames of each movie; distances are found once."""
    some = spaced_frames(bg, frames)
    mask = mask.join(some, ["movie_id", "frame"], "left_semi")
    values = channel.join(some, ["movie_id", "frame"], "left_semi").join(bg.select("movie_id", "channel", "frame", "bg"), ["movie_id", "channel", "frame"])
    values = values.select("channel", *PIXEL, F.greatest(F.col("value") - F.col("bg"), F.lit(0.0)).alias("v"))
    key = ["channel", *OBJECT]
    every = F.array(*(F.lit(int(w)).cast("long") for w in widths))
    near = around(mask, gap + max(widths)).where(F.col("distance") > gap).join(values, PIXEL)
    ring = near.select(*key, "v", F.explode(F.filter(every, lambda w: F.col("distance") <= w + gap)).alias("width"))
    ring = ring.groupBy(*key, "width").agg(F.median("v").alias("ring"), F.count("*").alias("ring_px"))
    nuc = mask.join(values, PIXEL).groupBy(*key).agg(F.median("v").alias("nuc"), F.count("*").alias("nuc_px")).withColumn("width", F.explode(every))
    cn = F.when((F.col("ring") > 0) & (F.col("nuc") > 0), F.col("ring") / F.col("nuc"))
    rows = nuc.join(ring, [*key, "width"], "left").withColumns({"cn": cn, "ring_px": F.coalesce("ring_px", F.lit(0))})
    return rows.groupBy("movie_id", "channel", "width").agg(F.median("cn").alias("cn"), F.median("ring_px").alias("ring_px"), F.median("nuc_px").alias("nuc_px"), F.avg(F.col("cn").isNull().cast("double")).alias("missing"), F.count("*").alias("n"))


def quantised(channel: DataFrame, mask: DataFrame, bg: DataFrame | None = None, levels: int = 16) -> DataFrame:
    """In-mask pixels with their level from 1 to ``levels - 1`` between the 1st and 99th percentile of each movie and channel.

    With ``bg`` (see ``background``) it is taken from the values first, frame by frame, and what falls below it is 0.
    """
    rows = channel.join(mask, PIXEL)
    if bg is not None:
        rows = rows.join(bg.select("movie_id", "channel", "frame", "bg"), ["movie_id", "channel", "frame"]).withColumn("value", F.greatest(F.col("value") - F.col("bg"), F.lit(0.0)))
    ends = quantiles(rows, ["movie_id", "channel"], "value", [0.01, 0.99])
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0])))
    level = F.when(F.col("p")[1] > F.col("p")[0], F.rint(share * (levels - 2)) + 1).otherwise(1).cast("int")
    return rows.join(ends, ["movie_id", "channel"]).select("channel", *OBJECT, "y", "x", level.alias("q"))


def haralick(levelled: DataFrame) -> DataFrame:
    """Contrast, correlation, energy and homogeneity of the symmetric co-occurrences in four directions, averaged; entropy summed over 4.

    Joins merge: the levels compress to files so small that Spark would broadcast them, and the driver would hold every pixel.
    """
    key = ["channel", *OBJECT]
    levelled = stored(levelled, "levels")
    away = F.array(*(F.struct(F.lit(k).alias("angle"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)])))
    asked = levelled.select(*key, F.col("q").alias("q2"), F.explode(away).alias("o"), "y", "x").select(*key, "o.angle", "q2", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"))
    both = F.array(F.struct(F.col("q").alias("i"), F.col("q2").alias("j")), F.struct(F.col("q2").alias("i"), F.col("q").alias("j")))
    pair = asked.join(levelled.hint("merge"), [*key, "y", "x"]).select(*key, "angle", F.explode(both).alias("p"))
    out = pair.groupBy(*key, "angle", "p.i", "p.j").agg(F.count("*").alias("n"))
    total = out.groupBy(*key, "angle").agg(F.sum("n").alias("t"))
    p = out.join(total.hint("merge"), [*key, "angle"]).withColumn("p", F.col("n") / F.col("t"))
    d = F.col("i") - F.col("j")
    per = p.groupBy(*key, "angle").agg(
        F.sum(F.col("p") * d * d).alias("contrast"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"),
        F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.sum(F.col("p") * F.col("i")).alias("m"), F.sum(F.col("p") * F.col("i") * F.col("i")).alias("m2"), F.sum(F.col("p") * F.col("i") * F.col("j")).alias("mij"),
    )
    var = F.col("m2") - F.col("m") * F.col("m")
    per = per.withColumn("correlation", F.when(var > 1e-15, (F.col("mij") - F.col("m") * F.col("m")) / var).otherwise(1.0))
    sizes = levelled.groupBy(*key).agg(F.count("*").alias("px"))
    # an angle without pairs counts as contrast 0, energy 0, homogeneity 0, correlation 1
    mean = per.groupBy(*key).agg(*((F.sum(c) / 4).alias(c) for c in ("contrast", "energy", "homogeneity", "entropy")), ((F.sum("correlation") + 4 - F.count("*")) / 4).alias("correlation"))
    shown = sizes.join(mean.hint("merge"), key, "left")
    return shown.select(*key, *(F.when(F.col("px") >= 8, F.col(c)).alias(c) for c in ("contrast", "correlation", "energy", "homogeneity", "entropy")))


def local_binary_patterns(channel: DataFrame, mask: DataFrame) -> DataFrame:
    """Shares of local minima and maxima and the entropy of uniform patterns of eight neighbours at radius 1, in eroded objects."""
    key = ["channel", *OBJECT]
    core = eroded(mask).join(channel, PIXEL)
    near = channel.select("movie_id", "channel", "frame", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("value").alias("nv"))
    away = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    asked = core.select(*key, "y", "x", "value", F.explode(away).alias("d")).withColumns({"ny": F.col("y") + F.col("d.dy"), "nx": F.col("x") + F.col("d.dx")})
    at = lambda dy, dx: F.first(F.when((F.col("d.dy") == dy) & (F.col("d.dx") == dx), F.col("nv")), ignorenulls=True)
    got = asked.join(near, ["movie_id", "channel", "frame", "ny", "nx"], "left").groupBy(*key, "y", "x", "value").agg(*(at(dy, dx).alias(f"v{dy + 1}{dx + 1}") for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    s = 0.5**0.5
    v = lambda dy, dx: F.coalesce(f"v{dy + 1}{dx + 1}", F.lit(0.0))
    corner = lambda dy, dx: (1 - s) * (1 - s) * v(0, 0) + (1 - s) * s * (v(dy, 0) + v(0, dx)) + s * s * v(dy, dx)
    around = [v(0, 1), corner(-1, 1), v(-1, 0), corner(-1, -1), v(0, -1), corner(1, -1), v(1, 0), corner(1, 1)]
    bits = got.withColumns({f"b{i}": (a - F.col("value") >= -1e-9).cast("int") for i, a in enumerate(around)})
    ones = sum((F.col(f"b{i}") for i in range(8)), F.lit(0))
    turns = sum((F.abs(F.col(f"b{i}") - F.col(f"b{(i + 1) % 8}")) for i in range(8)), F.lit(0))
    codes = bits.withColumn("code", F.when(turns <= 2, ones).otherwise(9)).groupBy(*key, "code").agg(F.count("*").alias("n"))
    total = codes.groupBy(*key).agg(F.sum("n").alias("t"))
    p = codes.join(total, key).withColumn("p", F.col("n") / F.col("t"))
    stats = p.groupBy(*key).agg(F.first("t").alias("px"), F.coalesce(F.sum(F.when(F.col("code") == 0, F.col("p"))), F.lit(0.0)).alias("localmax"), F.coalesce(F.sum(F.when(F.col("code") == 8, F.col("p"))), F.lit(0.0)).alias("localmin"), F.sum(-F.col("p") * F.ln(F.col("p") + 1e-12)).alias("entropy"))
    objects = mask.select(*OBJECT).distinct().join(channel.select("movie_id", "channel").distinct(), "movie_id")
    return objects.join(stats, key, "left").select(*key, *(F.when(F.col("px") >= 8, F.col(c)).alias(c) for c in ("localmax", "localmin", "entropy")))


def signal_drift(channel: DataFrame, mask: DataFrame) -> DataFrame:
    """Median inside objects per frame, relative to the first positive one."""
    per = channel.join(mask.select(*PIXEL), PIXEL, "left_semi").groupBy("movie_id", "channel", "frame").agg(F.median("value").alias("median"))
    first = per.where("median > 0").groupBy("movie_id", "channel").agg(F.min_by("median", "frame").alias("base"))
    return per.join(first, ["movie_id", "channel"], "left").select("movie_id", "channel", "frame", "median", (F.col("median") / F.col("base")).alias("drift"))


def readout(stats: DataFrame) -> DataFrame:
    """The four ratios of every object as (movie_id, track_id, frame)."""
    return stats.select("movie_id", F.col("label").alias("track_id"), "frame", "channel", "cn", "nc", "cn_mean", "nc_mean")


def foci(stats: DataFrame, texture: DataFrame, drift: DataFrame) -> DataFrame:
    """Median, spread and relative spread in the nucleus with its texture and the frame's drift."""
    rows = stats.select("channel", *OBJECT, "nuc_median", "nuc_std", F.when(F.col("nuc_median") != 0, F.col("nuc_std") / F.col("nuc_median")).alias("cv"))
    return rows.join(texture, ["channel", *OBJECT], "left").join(drift.select("movie_id", "channel", "frame", "drift"), ["movie_id", "channel", "frame"], "left")


def clipped_source(channel: DataFrame) -> DataFrame:
    """Channels of 8-bit values with over 1 % at both ends: a sign of a processed export."""
    per = channel.groupBy("movie_id", "channel").agg(F.max("value").alias("top"), F.avg((F.col("value") <= 0).cast("double")).alias("zero"), F.avg((F.col("value") >= 255).cast("double")).alias("full"))
    return per.select("movie_id", "channel", ((F.col("top") <= 255) & (F.col("zero") > 0.01) & (F.col("full") > 0.01)).alias("clipped"))


def _image(rows: pd.DataFrame, height: int, width: int) -> np.ndarray:
    """Pixels as an array; those that are missing, null or not finite are 0, those outside are left out."""
    image = np.zeros((height, width))
    inside = rows[rows.y.between(0, height - 1) & rows.x.between(0, width - 1)]
    image[inside.y.to_numpy(), inside.x.to_numpy()] = np.nan_to_num(inside.value.to_numpy(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    return image


def phase_shift(was: np.ndarray, now: np.ndarray) -> tuple[float, float]:
    """The shift (dy, dx) that takes the first image to the second: the centroid of 5 x 5 values around the peak of their phase correlation."""
    cross = np.fft.fft2(now) * np.conj(np.fft.fft2(was))
    size = np.abs(cross)
    top = size.max(initial=0.0)
    phase = np.divide(cross, size, out=np.zeros_like(cross), where=size > 1e-9 * top)
    peak = np.round(np.fft.ifft2(phase).real, 9)
    y, x = np.unravel_index(np.argmax(peak), peak.shape)
    near = np.arange(-2, 3)
    w = peak[np.ix_((y + near) % peak.shape[0], (x + near) % peak.shape[1])]
    wrapped = lambda at, n: at - n if 2 * at > n else at
    dy, dx = ((w.sum(1) @ near, w.sum(0) @ near) / w.sum()) if w.sum() else (0.0, 0.0)
    return float(wrapped(int(y), peak.shape[0]) + dy), float(wrapped(int(x), peak.shape[1]) + dx)


def _shifts(reference: pd.DataFrame, channel: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(reference):
        height, width = int(reference.y.max()) + 1, int(reference.x.max()) + 1
        was = _image(reference, height, width)
        for name, part in channel.groupby("channel", dropna=False):
            dy, dx = phase_shift(was, _image(part, height, width))
            rows.append((part.movie_id.iloc[0], name, part.frame.iloc[0], dy, dx, float(np.hypot(dy, dx))))
    return pd.DataFrame(rows, columns=["movie_id", "channel", "frame", "dy", "dx", "offset"])


def alignment(channel: DataFrame, reference: DataFrame, probes: int = 5) -> DataFrame:
    """The shift (dy, dx) of a channel against the movie's reference on some frames, and its length, by phase correlation of whole frames.

    Shifts of any length are found, up to half of the frame, and parts of a pixel. A frame is one task's work, as an image
    is bounded; its pixels meet by movie and frame. Terms under 1e-9 of the strongest have no phase.
    """
    some = spaced_frames(reference, probes)
    probed = lambda df: df.join(some, ["movie_id", "frame"], "left_semi").groupBy("movie_id", "frame")
    named = channel.select(*(F.col(c).alias(c) for c in ("channel", *PIXEL, "value")))  # columns of its own, also where it is the reference
    pairs = probed(reference.select(*PIXEL, "value")).cogroup(probed(named))
    return pairs.applyInPandas(_shifts, "movie_id long, channel string, frame long, dy double, dx double, offset double")


def source_problems(channel: DataFrame, reference: DataFrame, frames: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """What speaks against measuring a channel, as (movie_id, channel, problem): another number of frames or another size than the mask's, or a shift."""
    per = channel.groupBy("movie_id", "channel").agg(F.countDistinct("frame").alias("n"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    want = frames.groupBy("movie_id").agg(F.countDistinct("frame").alias("frames"), F.max("height").alias("height"), F.max("width").alias("width"))
    off = alignment(channel, reference).groupBy("movie_id", "channel").agg(F.max("offset").alias("offset"))
    same_size = (F.col("h") == F.col("height")) & (F.col("w") == F.col("width"))
    rows = per.join(want, "movie_id").join(off, ["movie_id", "channel"], "left")
    kinds = F.array_compact(F.array(
        F.when(F.col("n") != F.col("frames"), F.lit("number of frames")),
        F.when(~same_size, F.lit("frame size")),
        F.when(same_size & (F.col("n") == F.col("frames")) & (F.col("offset") > tolerance), F.lit("misaligned")),
    ))
    return rows.select("movie_id", "channel", F.explode(kinds).alias("problem"))
