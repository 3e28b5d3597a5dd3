"""Geometry of label images as tables of labelled pixels (G operators): group-bys, shifted equi-joins and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored

OBJECT = ["movie_id", "frame", "label"]
CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
DIAGONAL = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
# Weights of the perimeter by 1 + 2 * side neighbours + 10 * diagonal neighbours on the boundary.
ONE, ROOT_TWO, HALF = [5, 7, 15, 17, 25, 27], [21, 33], [13, 23]


def centroids(mask: DataFrame) -> DataFrame:
    return mask.groupBy(*OBJECT).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def areas(mask: DataFrame, px_area: float = 1.0) -> DataFrame:
    return mask.groupBy(*OBJECT).agg((F.count("*") * F.lit(float(px_area))).alias("area"))


def correspondence(tracks: DataFrame, mask: DataFrame, frames: DataFrame) -> DataFrame:
    """Per movie, the share of in-bounds rows on whose own label they lie; 1 without such rows."""
    rows = tracks.select("movie_id", "frame", "track_id", F.rint("pos_x").cast("long").alias("x"), F.rint("pos_y").cast("long").alias("y")).join(frames, ["movie_id", "frame"])
    rows = rows.where("x >= 0 AND y >= 0 AND x < width AND y < height").join(mask, ["movie_id", "frame", "y", "x"], "left")
    hit = rows.groupBy("movie_id").agg(F.avg((F.coalesce("label", F.lit(0)) == F.col("track_id")).cast("double")).alias("share"))
    return tracks.select("movie_id").distinct().join(hit, "movie_id", "left").select("movie_id", F.coalesce("share", F.lit(1.0)).alias("share"))


def relabelled(mask: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each label under a row's position takes the row's id (the largest of several); others keep theirs."""
    at = tracks.select("movie_id", "frame", "track_id", F.rint("pos_x").cast("long").alias("x"), F.rint("pos_y").cast("long").alias("y"))
    named = at.join(mask, ["movie_id", "frame", "y", "x"]).groupBy(*OBJECT).agg(F.max("track_id").alias("to"))
    return mask.join(named, OBJECT, "left").select("movie_id", "frame", "y", "x", F.coalesce("to", "label").alias("label"))


def _near(pixels: DataFrame, offsets: list[tuple[int, int]], kind: str) -> DataFrame:
    """Number of pixels of the same label at the offsets, as column ``kind``."""
    away = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    seen = pixels.select(*OBJECT, "y", "x", F.explode(away).alias("d")).select(*OBJECT, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    count = seen.groupBy(*OBJECT, "y", "x").agg(F.count("*").alias(kind))
    return pixels.join(count, [*OBJECT, "y", "x"], "left").withColumn(kind, F.coalesce(kind, F.lit(0)))


def eroded(mask: DataFrame) -> DataFrame:
    """Pixels all of whose side neighbours share their label."""
    return _near(mask.select(*OBJECT, "y", "x"), CROSS, "n4").where("n4 = 4").drop("n4")


def boundary(mask: DataFrame) -> DataFrame:
    return _near(mask.select(*OBJECT, "y", "x"), CROSS, "n4").where("n4 < 4").drop("n4")


def perimeters(mask: DataFrame) -> DataFrame:
    edge = _near(_near(boundary(mask), CROSS, "side"), DIAGONAL, "diagonal")
    code = 1 + 2 * F.col("side") + 10 * F.col("diagonal")
    weight = F.when(code.isin(ONE), 1.0).when(code.isin(ROOT_TWO), 2**0.5).when(code.isin(HALF), (1 + 2**0.5) / 2).otherwise(0.0)
    return edge.groupBy(*OBJECT).agg(F.sum(weight).alias("perimeter"))


def radius_ratio(mask: DataFrame) -> DataFrame:
    """Longest over shortest distance from the centroid to the boundary, for four pixels and more."""
    size = mask.groupBy(*OBJECT).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    rows = boundary(mask).join(size, OBJECT).withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).where("d > 0")
    ratio = F.when((F.first("n") >= 4) & (F.count("*") >= 2), F.max("d") / F.min("d"))
    return rows.groupBy(*OBJECT).agg(ratio.alias("radius_ratio"))


def morphometry(mask: DataFrame) -> DataFrame:
    """Shape of every label in every frame, from moments, boundary and bounding box; ``nii`` joins four of them.

    Axes are four times the roots of the eigenvalues of the plain central moments of pixel centres, as image libraries for
    Python define them (no 1/12 for the extent of a pixel), and as in ``ellipse_rings``.
    """
    m = mask.groupBy(*OBJECT).agg(
        F.count("*").cast("double").alias("area"),
        F.var_pop("y").alias("a"), F.var_pop("x").alias("c"), F.covar_pop("x", "y").alias("b"),
        ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).cast("double").alias("box"),
    )
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(4 * F.col("b") * F.col("b") + F.pow(F.col("a") - F.col("c"), 2)) / 2
    m = m.withColumns({"l1": half + root, "l2": F.greatest(half - root, F.lit(0.0))})
    m = m.withColumns({"major": 4 * F.sqrt("l1"), "minor": 4 * F.sqrt("l2"), "eccentricity": F.when(F.col("l1") > 0, F.sqrt(1 - F.col("l2") / F.col("l1"))).otherwise(0.0)})
    m = m.join(perimeters(mask), OBJECT, "left").join(radius_ratio(mask), OBJECT, "left")
    m = m.withColumns({
        "circularity": F.when(F.col("perimeter") > 0, 4 * np.pi * F.col("area") / F.pow("perimeter", 2)),
        "aspect": F.when(F.col("minor") > 0, F.col("major") / F.col("minor")),
        "area_box": F.col("area") / F.col("box"),
        "roundness": F.when(F.col("area") > 0, F.pow("perimeter", 2) / (4 * np.pi * F.col("area"))),
    })
    return m.withColumn("nii", F.col("aspect") - F.col("area_box") + F.col("radius_ratio") + F.col("roundness")).drop("a", "b", "c", "l1", "l2", "box")


def orientations(mask: DataFrame) -> DataFrame:
    """Angle of every label's major axis against the rows' axis, from -pi/2 to pi/2, from exact whole-number moments.

    Without a longer axis along either, it is pi/4 where the covariance is positive, else -pi/4.
    """
    total = {k: F.sum(e) for k, e in {"n": F.lit(1), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}.items()}
    m = mask.groupBy(*OBJECT).agg(*(e.cast("long").alias(f"s_{k}") for k, e in total.items()))
    away = F.expr("(s_n * s_yy - s_y * s_y) - (s_n * s_xx - s_x * s_x)")
    shared = F.expr("s_n * s_xy - s_x * s_y")
    angle = F.when(away == 0, F.when(shared > 0, F.lit(np.pi / 4)).otherwise(F.lit(-np.pi / 4))).otherwise(F.atan2(2.0 * shared, away.cast("double")) / 2)
    return m.select(*OBJECT, angle.alias("orientation"))


def morphology_series(mask: DataFrame) -> DataFrame:
    """Area, perimeter and circularity of every label by frame; a perimeter of 0 has no circularity."""
    rows = mask.groupBy(*OBJECT).agg(F.count("*").cast("double").alias("area_px")).join(perimeters(mask), OBJECT, "left").withColumn("perimeter", F.coalesce("perimeter", F.lit(0.0)))
    circularity = F.when(F.col("perimeter") > 0, 4 * np.pi * F.col("area_px") / F.pow("perimeter", 2))
    return rows.select("movie_id", "frame", F.col("label").alias("track_id"), "area_px", "perimeter", circularity.alias("circularity"))


def _envelope(y: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Object and smallest whole x at or right of the left side of its convex hull, for every y from its first to its last row.

    Row i of ``y`` and ``x`` holds the ``n[i]`` rows of object i from the top, padded; all objects take a step of the chain together.
    """
    every = np.arange(len(n))
    chain, top = np.zeros(y.shape, np.int64), np.zeros(len(n), np.int64)
    for t in range(y.shape[1]):
        live = n > t
        while True:
            b, a = chain[every, np.maximum(top - 1, 0)], chain[every, np.maximum(top - 2, 0)]
            turn = (x[every, b] - x[every, a]) * (y[:, t] - y[every, b]) >= (x[:, t] - x[every, b]) * (y[every, b] - y[every, a])
            back = live & (top >= 2) & turn
            if not back.any():
                break
            top -= back
        chain[every[live], top[live]] = t
        top += live
    of, k = np.nonzero(np.arange(y.shape[1]) < top[:, None])
    last = k == top[of] - 1
    a, b = chain[of, k], chain[of, np.minimum(k + 1, top[of] - 1)]
    ya, xa, yb, xb = y[of, a], x[of, a], y[of, b], x[of, b]
    steps = np.where(last, 1, yb - ya)
    at = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    rise, run = np.repeat(xb - xa, steps), np.repeat(np.maximum(yb - ya, 1), steps)
    return np.repeat(of, steps), np.repeat(xa, steps) - (-(rise * at) // run)


def _hull_sizes(tops: np.ndarray, lows: np.ndarray, highs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pixels in the convex hull of each object, from the first and last pixel of each of its rows."""
    place = np.arange(n.max(initial=0)) < n[:, None]
    padded = np.zeros((3, *place.shape), np.int64)
    for k, flat in enumerate((tops, lows, highs)):
        padded[k][place] = flat
    of, left = _envelope(padded[0], padded[1], n)
    _, right = _envelope(padded[0], -padded[2], n)
    return np.bincount(of, np.maximum(-right - left + 1, 0), len(n)).astype(np.int64)


def solidity(mask: DataFrame) -> DataFrame:
    """Pixels over pixels of the convex hull.

    Only the first and the last pixel of a row can be corners of the hull; an Arrow batch of these rows gives the hulls of many objects at once.
    """

    def hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ends = batch.column("ends")
                y, lo, hi = (pc.struct_field(ends.flatten(), k).to_numpy() for k in ("y", "lo", "hi"))
                size = _hull_sizes(y, lo, hi, ends.value_lengths().to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*OBJECT, "area"]), pa.array(size)], [*OBJECT, "area", "hull_px"])

    rows = mask.groupBy(*OBJECT, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    ends = F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("y", "lo", "hi")))))
    objects = rows.groupBy(*(F.col(k).cast("long").alias(k) for k in OBJECT)).agg(F.sum("n").cast("double").alias("area"), ends.alias("ends"))
    found = objects.mapInArrow(hulls, "movie_id long, frame long, label long, area double, hull_px long")
    return found.select(*OBJECT, (F.col("area") / F.col("hull_px")).alias("solidity"))


def components(mask: DataFrame) -> DataFrame:
    """Eight-connected components inside a label: each pixel with the first (y, x) of its component as ``part``.

    All joins merge: stored pixels compress to files so small that Spark would broadcast them, and the driver would hold every pixel.
    """
    code = F.col("y") * 1_000_000 + F.col("x")
    pixels = stored(mask.select(*OBJECT, "y", "x", code.alias("part")), "parts")
    away = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in [(0, 0), *CROSS, *DIAGONAL]))
    while True:
        told = pixels.select(*OBJECT, "part", "y", "x", F.explode(away).alias("d")).select(*OBJECT, "part", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
        least = told.groupBy(*OBJECT, "y", "x").agg(F.min("part").alias("least"))
        jump = pixels.select(*OBJECT, (F.col("y") * 1_000_000 + F.col("x")).alias("least"), F.col("part").alias("far"))
        new = pixels.hint("merge").join(least, [*OBJECT, "y", "x"]).join(jump.hint("merge"), [*OBJECT, "least"])
        new = stored(new.select(*OBJECT, "y", "x", F.least("least", "far").alias("part"), (F.least("least", "far") < F.col("part")).alias("moved")), "parts")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        pixels = new.drop("moved")


def split_blobs(mask: DataFrame) -> DataFrame:
    """movie_id, frame, label, part, n, keeps: the largest component keeps the label, of equal ones the first."""
    sized = components(mask).groupBy(*OBJECT, "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*OBJECT).orderBy(F.col("n").desc(), "part")
    return sized.withColumn("keeps", F.row_number().over(order) == 1)


def city_distance(seeds: DataFrame, frames: DataFrame) -> DataFrame:
    """L1 distance of every pixel of the frame to the nearest seed: a running minimum along rows, then along columns, both ways."""
    grid = frames.select("movie_id", "frame", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("y")).select("movie_id", "frame", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("x"))
    far = F.lit(1 << 30)
    rows = grid.join(seeds.select("movie_id", "frame", "y", "x").distinct().withColumn("seed", F.lit(True)), ["movie_id", "frame", "y", "x"], "left").withColumn("d", F.when(F.col("seed"), F.lit(0)).otherwise(far))

    def swept(df: DataFrame, across: str, along: str) -> DataFrame:
        w = Window.partitionBy("movie_id", "frame", across).orderBy(along)
        up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        return df.withColumn("d", F.least(F.min(F.col("d") - F.col(along)).over(up) + F.col(along), F.min(F.col("d") + F.col(along)).over(down) - F.col(along)))

    return swept(swept(rows, "y", "x"), "x", "y").select("movie_id", "frame", "y", "x", F.when(F.col("d") < (1 << 29), F.col("d")).alias("distance"))


def ball(pixels: DataFrame, radius: int, *keep: str) -> DataFrame:
    """Pixels within L1 distance ``radius`` of the given ones, with the kept columns, each once."""
    away = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius + abs(dy), radius - abs(dy) + 1)))
    return pixels.select("movie_id", "frame", *keep, "y", "x", F.explode(away).alias("d")).select("movie_id", "frame", *keep, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()


def nearest_two(mask: DataFrame, radius: int) -> DataFrame:
    """movie_id, frame, y, x, nearest, second: the labels of the two nearest nuclei within L1 distance ``radius`` of a pixel, ties to the smaller label.

    A pixel of a nucleus is its own nearest. ``second`` is null where only one nucleus is that near.
    """
    away = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(abs(dy) + abs(dx)).alias("d")) for dy in range(-radius, radius + 1) for dx in range(-radius + abs(dy), radius - abs(dy) + 1)))
    seen = boundary(mask).select(*OBJECT, "y", "x", F.explode(away).alias("o")).select(*OBJECT, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.d").alias("d"))
    seen = seen.unionByName(mask.select(*OBJECT, "y", "x", F.lit(0).alias("d")))
    near = seen.groupBy("movie_id", "frame", "y", "x", "label").agg(F.min("d").alias("d"))
    order = Window.partitionBy("movie_id", "frame", "y", "x").orderBy("d", "label")  # the few nuclei around a pixel
    two = near.withColumn("r", F.row_number().over(order)).where("r <= 2")
    return two.groupBy("movie_id", "frame", "y", "x").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("nearest"), F.max(F.when(F.col("r") == 2, F.col("label"))).alias("second"))


def _clear(ring: DataFrame, mask: DataFrame, neighbor_gap: int) -> DataFrame:
    """Pixels (OBJECT, y, x) around a nucleus that lie outside all nuclei and farther than ``neighbor_gap`` from every other one."""
    at = ["movie_id", "frame", "y", "x"]
    out = ring.join(mask.select(*at), at, "left_anti")
    if neighbor_gap > 0:
        out = out.join(nearest_two(mask, neighbor_gap), at, "left").where("nearest IS NULL OR (nearest = label AND second IS NULL)")
    return out.select(*OBJECT, "y", "x")


def rings(mask: DataFrame, gap: int = 1, width: int = 3, neighbor_gap: int = 0) -> DataFrame:
    """Pixels around each nucleus, ``gap`` away and ``width`` wide, outside all nuclei and more than ``neighbor_gap`` from every other one."""
    edge = boundary(mask)  # the ball around an object is the object and the ball around its boundary
    out = ball(edge, gap + width, "label").join(ball(edge, gap, "label"), [*OBJECT, "y", "x"], "left_anti") if gap else ball(edge, width, "label")
    return _clear(out, mask, neighbor_gap)


def around(mask: DataFrame, radius: int) -> DataFrame:
    """Pixels outside all nuclei up to L1 distance ``radius`` from a nucleus, with the distance to it."""
    away = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(abs(dy) + abs(dx)).alias("d")) for dy in range(-radius, radius + 1) for dx in range(-radius + abs(dy), radius - abs(dy) + 1)))
    seen = boundary(mask).select(*OBJECT, "y", "x", F.explode(away).alias("o")).select(*OBJECT, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.d").alias("d"))
    near = seen.groupBy(*OBJECT, "y", "x").agg(F.min("d").alias("distance"))
    return near.join(mask.select("movie_id", "frame", "y", "x"), ["movie_id", "frame", "y", "x"], "left_anti")


def ellipse_rings(mask: DataFrame, gap: int = 1, width: int = 3, neighbor_gap: int = 0) -> DataFrame:
    """Pixels between two ellipses around each nucleus: the ellipse of its moments grown by ``gap`` and by ``gap + width``.

    They lie outside all nuclei and more than ``neighbor_gap`` from every other nucleus.
    A nucleus without extent along one axis (a line or a single pixel) has the ring of its contour instead.
    """
    vx, vy, cov = F.col("vx"), F.col("vy"), F.col("cov")
    root = F.sqrt(F.pow(vy - vx, 2) + 4 * cov * cov)
    shape = mask.groupBy(*OBJECT).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cov"))
    shape = shape.withColumns({"root": root, "l2": F.greatest((vx + vy - root) / 2, F.lit(0.0))})
    flat = F.col("l2") <= 1e-9
    # the axes enter by the double angle's sine and cosine, so that no angle is computed
    turn = lambda v: F.when(F.col("root") > 0, v / F.col("root")).otherwise(0.0)
    sized = shape.where(~flat).select(*OBJECT, "cx", "cy", (2 * F.sqrt((vx + vy + F.col("root")) / 2)).alias("a"), (2 * F.sqrt("l2")).alias("b"), turn(vy - vx).alias("c2"), turn(2 * cov).alias("s2"))
    side = lambda c: F.sequence(F.ceil(F.col(c) - F.col("a") - (gap + width)), F.floor(F.col(c) + F.col("a") + (gap + width)))
    box = sized.withColumn("y", F.explode(side("cy"))).withColumn("x", F.explode(side("cx")))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    box = box.withColumn("major", (dx * dx * (1 - F.col("c2")) + dy * dy * (1 + F.col("c2"))) / 2 + dx * dy * F.col("s2")).withColumn("minor", dx * dx + dy * dy - F.col("major"))
    within = lambda k: F.col("major") / F.pow(F.col("a") + k, 2) + F.col("minor") / F.pow(F.col("b") + k, 2) <= 1
    found = box.where(within(gap + width))
    found = found.where(~within(gap)) if gap else found
    thin = rings(mask.join(shape.where(flat).select(*OBJECT), OBJECT, "left_semi"), gap, width)
    return _clear(found.select(*OBJECT, "y", "x").unionByName(thin), mask, neighbor_gap)


def inside() -> Column:
    """Over pixels joined to ``frames``: within the image."""
    return (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
