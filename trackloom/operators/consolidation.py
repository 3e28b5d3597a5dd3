"""Consolidating tracks over a whole movie: torn labels mended, covered tracks absorbed, gaps closed (E18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TRACK
from ..sources.work import stored
from . import pixels
from .edits import _new_rows, renamed, repoint
from .groups import clusters


def _positions(df: DataFrame) -> DataFrame:
    """movie_id, frame, track_id and the pixel of each row: positions are truncated; rows without one, or without an id, are left out."""
    whole = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    at = df.select("movie_id", "frame", "track_id", whole("pos_y").alias("y"), whole("pos_x").alias("x"))
    return at.where("track_id > 0 AND y IS NOT NULL AND x IS NOT NULL")


def _exchanged(rows: DataFrame, moved: Column, to: Column) -> DataFrame:
    """Moved rows take another id and lose parent and outcome."""
    change = {"outcome": F.when(moved, F.lit("")).otherwise(F.col("outcome")), "parent_id": F.when(moved, F.lit(-1)).otherwise(F.col("parent_id")), "track_id": to}
    if "continuous_label" in rows.columns:
        change["continuous_label"] = F.when(moved, to).otherwise(F.col("continuous_label"))
    return rows.withColumns(change)


def torn(df: DataFrame, mask: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of targets' labels in frames where they lie in several pieces, and the pieces.

    First table: movie_id, frame, label, ``keeps`` (the piece that stays alone), ``piece`` and ``owner`` (the piece that is the
    other track's). If the target's own position and another track's lie on pieces, the two are taken for swapped: the piece
    under the target's position is the other track's. Of several such tracks the one on the last piece counts, there the one with the largest id.
    Otherwise only the largest piece stays, of equal ones the first. Second table: movie_id, frame, label, y, x, part.
    """
    own = pixels.components(mask.join(targets.select("movie_id", F.col("track_id").alias("label")).distinct(), ["movie_id", "label"], "left_semi"))
    own = stored(own, "pieces")
    piece = own.groupBy(*pixels.OBJECT, "part").agg(F.count("*").alias("n"))
    split = piece.groupBy(*pixels.OBJECT).agg(F.count("*").alias("pieces"), F.max_by("part", F.struct("n", -F.col("part"))).alias("keeps")).where("pieces > 1")
    under = _positions(df).join(own, ["movie_id", "frame", "y", "x"])
    mine, other = F.col("track_id") == F.col("label"), F.col("track_id") != F.col("label")
    owners = under.groupBy(*pixels.OBJECT).agg(F.max(F.when(mine, F.col("part"))).alias("piece"), F.max(F.when(other, F.struct("part", "track_id"))).alias("other"))
    found = split.join(owners, pixels.OBJECT, "left")
    swapped = F.col("piece").isNotNull() & F.col("other").isNotNull()
    return found.select(*pixels.OBJECT, F.when(~swapped, F.col("keeps")).alias("keeps"), F.when(swapped, F.col("piece")).alias("piece"), F.when(swapped, F.col("other.track_id")).alias("owner")), own


def consolidated(df: DataFrame, mask: DataFrame, targets: DataFrame, fase: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with the tracks of ``targets`` (movie_id, track_id) consolidated over all frames.

    Frame by frame, a torn label is mended as ``torn`` says; rows that exchange ids lose parent and outcome. Then every
    other track whose position lies on a target's pixels in any frame is absorbed by it over the whole movie: its pixels and daughters become
    the target's, its rows lose parent and outcome, and where both have a row, the target's own stays (of several
    absorbed ones the smallest id's). At last each frame with pixels of the target has one row at their centroid; new rows have no parent
    and no outcome, and ``fase`` as an expression over ``frame``. If targets absorb each other or the same track, all go on as the
    smallest of these targets. Rows of a target in frames without its pixels stay as they are.
    """
    targets = stored(targets.select(*TRACK).distinct(), "targets")
    found, own = torn(df, mask, targets)
    found = stored(found, "torn")
    # the pixels of each frame after the repair
    seen = own.join(found, pixels.OBJECT, "left").where("keeps IS NULL OR part = keeps")
    mended = seen.select("movie_id", "frame", "y", "x", F.when(F.col("part") == F.col("piece"), F.col("owner")).otherwise(F.col("label")).alias("label"))
    rest = mask.join(targets.select("movie_id", F.col("track_id").alias("label")), ["movie_id", "label"], "left_anti")
    pix = stored(rest.select("movie_id", "frame", "y", "x", "label").unionByName(mended), "mended")
    # the rows of each frame after the repair
    swaps = found.where("owner IS NOT NULL")
    both = swaps.select("movie_id", "frame", F.col("label").alias("track_id"), F.col("owner").alias("to")).union(swaps.select("movie_id", "frame", "owner", "label"))
    rows = df.join(both, [*TRACK, "frame"], "left").withColumn("former", F.coalesce("to", "track_id"))
    moved = F.col("to").isNotNull()
    rows = stored(_exchanged(rows, moved, F.col("former")).select(*df.columns), "exchanged")
    # absorbed tracks and who takes them
    lies = _positions(rows).join(pix, ["movie_id", "frame", "y", "x"]).join(targets.select("movie_id", F.col("track_id").alias("label")), ["movie_id", "label"], "left_semi")
    edges = lies.where("track_id <> label").select("movie_id", F.col("label").alias("a"), F.col("track_id").alias("b")).distinct()
    joined = clusters(edges)
    heads = joined.join(targets.withColumnRenamed("track_id", "id"), ["movie_id", "id"]).groupBy("movie_id", "root").agg(F.min("id").alias("new"))
    moves = stored(joined.join(heads, ["movie_id", "root"]).where("id <> new").select("movie_id", F.col("id").alias("old"), "new"), "absorbed")
    pix = renamed(pix, moves, "label")
    rows = repoint(rows, moves).join(moves.withColumnRenamed("old", "track_id"), TRACK, "left").withColumn("former", F.col("track_id"))
    moved = F.col("new").isNotNull()
    rows = _exchanged(rows, moved, F.coalesce("new", "track_id"))
    first = Window.partitionBy(*TRACK, "frame").orderBy(F.col("new").isNotNull(), "former")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1").select(*df.columns)
    # one row at the centroid of each frame with pixels
    left = targets.join(moves.select("movie_id", F.col("old").alias("track_id")), TRACK, "left_anti")
    c = pixels.centroids(pix.join(left.withColumnRenamed("track_id", "label"), ["movie_id", "label"], "left_semi"))
    c = stored(c.select("movie_id", "frame", F.col("label").alias("track_id"), F.col("x").alias("mx"), F.col("y").alias("my")), "centroids")
    here = [*TRACK, "frame"]
    kept = rows.join(c, here, "left").withColumns({"pos_x": F.coalesce("mx", "pos_x"), "pos_y": F.coalesce("my", "pos_y")}).select(*df.columns)
    added = _new_rows(c.join(rows.select(*here), here, "left_anti").select(*here, F.col("mx").alias("pos_x"), F.col("my").alias("pos_y")), fase)
    out = kept.unionByName(added.select(*(x for x in added.columns if x in df.columns)), allowMissingColumns=True)
    return out, pix.select(*mask.columns)
