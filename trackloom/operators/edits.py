"""Corrections as batches (E operators): each takes the observations, some also the pixels, and a table of edits.

Edits of one batch must not overlap (no track twice on the same side); ``replay`` applies overlapping ones in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TRACK
from ..schema import MITOSIS, QUARANTINE_FROM, UNKNOWN
from ..sources.work import stored
from . import anomaly, lineage, pixels


def apply_flags(df: DataFrame, flags: DataFrame) -> DataFrame:
    """All rows of a track in ``flags`` (movie_id, track_id, flag) take the flag; null clears."""
    rows = df.join(flags.withColumn("set_flag", F.lit(True)), TRACK, "left")
    return rows.withColumn("outcome", F.when(F.col("set_flag"), F.coalesce("flag", F.lit(""))).otherwise(F.col("outcome"))).drop("flag", "set_flag")


def repoint(df: DataFrame, moves: DataFrame) -> DataFrame:
    """Children of ``old`` become children of ``new`` (movie_id, old, new), never of themselves."""
    rows = df.join(moves.select("movie_id", F.col("old").alias("parent_id"), "new"), ["movie_id", "parent_id"], "left")
    parent = F.when(F.col("new").isNull(), F.col("parent_id")).when(F.col("new") == F.col("track_id"), F.lit(-1)).otherwise(F.col("new"))
    return rows.withColumn("parent_id", parent).drop("new").select(*df.columns)


def _clear_childless(df: DataFrame, mothers: DataFrame) -> DataFrame:
    """Mitosis of these mothers goes if no daughter is left."""
    still = lineage.links(df).select("movie_id", F.col("parent").alias("track_id")).distinct()
    bare = mothers.select(*TRACK).distinct().join(still, TRACK, "left_anti").withColumn("bare", F.lit(True))
    return df.join(bare, TRACK, "left").withColumn("outcome", F.when(F.col("bare") & (F.col("outcome") == MITOSIS), F.lit("")).otherwise(F.col("outcome"))).drop("bare")


def unlink(df: DataFrame, daughters: DataFrame) -> DataFrame:
    """The daughters (movie_id, track_id) lose their mother; a mother without daughters left loses her Mitosis."""
    cut = daughters.select(*TRACK).distinct().withColumn("cut", F.lit(True))
    rows = df.join(cut, TRACK, "left")
    mothers = rows.where("cut AND parent_id > 0").select("movie_id", F.col("parent_id").alias("track_id"))
    out = rows.withColumn("parent_id", F.when(F.col("cut"), F.lit(-1)).otherwise(F.col("parent_id"))).drop("cut")
    return _clear_childless(out, mothers)


def link(df: DataFrame, proposed: DataFrame, force: bool = False) -> DataFrame:
    """Links (movie_id, mother, daughter) that nothing speaks against.

    With ``force`` another mother or two other daughters are no obstacle: the latest-born of these daughters makes room.
    A link to oneself, to a missing track or to a daughter born no later than the mother is never made.
    """
    checked = lineage.checked_links(df, proposed)
    first = lineage.spans(df).select("movie_id", "track_id", "first_frame")
    good = checked.where(F.lit(force) | F.col("reason").isNull()).select("movie_id", "mother", "daughter")
    for side in ("mother", "daughter"):
        good = good.join(first.select("movie_id", F.col("track_id").alias(side), F.col("first_frame").alias(f"born_{side}")), ["movie_id", side])
    good = good.where("mother <> daughter AND born_daughter > born_mother").select("movie_id", "mother", "daughter")
    if force:
        old = lineage.links(df).join(first.withColumnRenamed("track_id", "child"), ["movie_id", "child"], "left")
        old = old.join(good.select("movie_id", F.col("daughter").alias("child"), F.col("mother").alias("parent")), ["movie_id", "child", "parent"], "left_anti")
        order = Window.partitionBy("movie_id", "parent").orderBy(F.col("first_frame").desc(), F.col("child").desc())
        full = old.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("movie_id", "parent")))
        evicted = full.where("r = 1 AND n >= 2").join(good.select("movie_id", F.col("mother").alias("parent")), ["movie_id", "parent"], "left_semi")
        evicted = evicted.select("movie_id", F.col("child").alias("track_id"), F.lit(True).alias("out")).distinct()
        df = df.join(evicted, TRACK, "left").withColumn("parent_id", F.when(F.col("out"), F.lit(-1)).otherwise(F.col("parent_id"))).drop("out")
    new = good.select("movie_id", F.col("daughter").alias("track_id"), F.col("mother").alias("new"))
    rows = df.join(new, TRACK, "left").withColumn("parent_id", F.coalesce("new", "parent_id")).drop("new")
    mothers = good.select("movie_id", F.col("mother").alias("track_id"), F.lit(True).alias("divides")).distinct()
    return rows.join(mothers, TRACK, "left").withColumn("outcome", F.when(F.col("divides"), F.lit(MITOSIS)).otherwise(F.col("outcome"))).drop("divides")


def dissolve_invalid(df: DataFrame) -> DataFrame:
    """Self-links go; a mother that is missing, or has a daughter born no later than herself, loses all daughters and her Mitosis."""
    span = lineage.spans(df).select("movie_id", "track_id", "first_frame")
    edges = lineage.links(df)
    first = lambda k: span.select("movie_id", F.col("track_id").alias(k), F.col("first_frame").alias(f"first_{k}"))
    both = edges.join(first("child"), ["movie_id", "child"], "left").join(first("parent"), ["movie_id", "parent"], "left")
    bad = both.where("parent <> child").groupBy("movie_id", "parent").agg(F.bool_or(F.col("first_parent").isNull() | (F.col("first_child") <= F.col("first_parent"))).alias("bad")).where("bad")
    bad = bad.select("movie_id", F.col("parent").alias("parent_id"), F.lit(True).alias("gone"))
    # tracks without a mother are many: each has a key of its own that no mother has, so that they do not meet in one task
    key = F.when(F.col("parent_id") > 0, F.col("parent_id")).otherwise(-F.abs("track_id"))
    rows = df.withColumn("mother_key", key).join(bad.withColumnRenamed("parent_id", "mother_key"), ["movie_id", "mother_key"], "left").drop("mother_key")
    rows = rows.withColumn("parent_id", F.when(F.col("gone") | (F.col("parent_id") == F.col("track_id")), F.lit(-1)).otherwise(F.col("parent_id"))).drop("gone")
    mothers = bad.select("movie_id", F.col("parent_id").alias("track_id"), F.lit(True).alias("cleared"))
    rows = rows.join(mothers, TRACK, "left").withColumn("outcome", F.when(F.col("cleared") & (F.col("outcome") == MITOSIS), F.lit("")).otherwise(F.col("outcome")))
    return rows.drop("cleared").select(*df.columns)


def renamed(df: DataFrame, mapping: DataFrame, track: str = "track_id") -> DataFrame:
    """Ids of ``mapping`` (movie_id, old, new) take the new one."""
    rows = df.join(mapping.select("movie_id", F.col("old").alias(track), "new"), ["movie_id", track], "left")
    return rows.withColumn(track, F.coalesce("new", track)).select(*df.columns)


def _labelled(df: DataFrame) -> DataFrame:
    """Renamed rows with their new id as mask label, if the table keeps labels."""
    return df.withColumn("continuous_label", F.col("track_id")) if "continuous_label" in df.columns else df


def _marked(df: DataFrame, keys: DataFrame, name: str, *on: str) -> DataFrame:
    """``df`` with a flag whether a row's columns ``on`` are among ``keys``."""
    marks = keys.select("movie_id", *on).distinct().withColumn(name, F.lit(True))
    return df.join(marks, ["movie_id", *on], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def merge(df: DataFrame, mask: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Track a (movie_id, a, b) goes on as b: rows, pixels and daughters; a's rows take b's parent.

    Where one was the other's mother, the division was false: all its daughters are detached, and b takes the
    mother's own parent and loses Mitosis. Divisions that are invalid afterwards dissolve.
    """
    parent = lineage.parent_map(df)
    of = lambda k, n: parent.select("movie_id", F.col("child").alias(k), F.col("parent").alias(n))
    highest = df.groupBy("movie_id", F.col("track_id").alias("b")).agg(F.max("parent_id").alias("heir"))
    plan = merges.select("movie_id", "a", "b").join(of("a", "pa"), ["movie_id", "a"], "left").join(of("b", "pb"), ["movie_id", "b"], "left").join(highest, ["movie_id", "b"], "left")
    none = F.lit(-1).cast("long")
    plan = plan.withColumn("mother", F.when(F.col("pb") == F.col("a"), F.col("a")).when(F.col("pa") == F.col("b"), F.col("b")))
    grand = F.coalesce(F.when(F.col("mother") == F.col("a"), F.col("pa")).otherwise(F.col("pb")), none)
    plan = stored(plan.select("movie_id", "a", "b", "mother", F.coalesce("heir", none).alias("heir"), F.when(grand == F.col("b"), none).otherwise(grand).alias("grand")), "merges")
    false, true = plan.where("mother IS NOT NULL"), plan.where("mother IS NULL")
    # the false divisions: nobody stays a daughter of the mother or of a
    sisters = lineage.links(df).join(false.select("movie_id", F.col("mother").alias("parent"), "a"), ["movie_id", "parent"]).where("child <> a").select("movie_id", F.col("child").alias("track_id"))
    rows = _marked(df, sisters, "detached", "track_id")
    lost = false.select("movie_id", F.explode(F.array("mother", "a")).alias("parent_id"))
    rows = _marked(rows, lost, "orphan", "parent_id").withColumn("parent_id", F.when(F.col("detached") | F.col("orphan"), none).otherwise(F.col("parent_id"))).select(*df.columns)
    # a's rows take b's parent and name; its daughters follow
    moved = plan.select("movie_id", F.col("a").alias("track_id"), F.col("b").alias("new"), F.when(F.col("mother").isNull(), F.col("heir")).alias("heir"))
    rows = rows.join(moved, TRACK, "left").withColumns({"parent_id": F.coalesce("heir", "parent_id"), "track_id": F.coalesce("new", "track_id")}).select(*df.columns)
    rows = repoint(rows, true.select("movie_id", F.col("a").alias("old"), F.col("b").alias("new")))
    heirs = false.select("movie_id", F.col("b").alias("track_id"), "grand")
    rows = rows.join(heirs, TRACK, "left").withColumns({"parent_id": F.coalesce("grand", "parent_id"), "outcome": F.when(F.col("grand").isNotNull() & (F.col("outcome") == MITOSIS), F.lit("")).otherwise(F.col("outcome"))})
    return _labelled(dissolve_invalid(rows.select(*df.columns))), renamed(mask, plan.select("movie_id", F.col("a").alias("old"), F.col("b").alias("new")), "label")


def _taken(df: DataFrame, mask: DataFrame) -> DataFrame:
    """movie_id, track_id, parent_id of all ids that tracks, parents or labels have."""
    return df.select("movie_id", "track_id", "parent_id").union(mask.select("movie_id", "label", F.lit(-1).cast("long")).distinct())


def with_partners(df: DataFrame, mask: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits (movie_id, a, b, ...); a ``b`` of 0 or null becomes a new id."""
    bare = edits.where(F.coalesce("b", F.lit(0)) == 0).select("movie_id", "a").distinct()
    wanted = bare.withColumn("ord", F.row_number().over(Window.partitionBy("movie_id").orderBy("a")).cast("long"))
    new = minted_ids(_taken(df, mask), wanted).select("movie_id", "a", "new_id")
    return stored(edits.join(new, ["movie_id", "a"], "left").withColumn("b", F.when(F.coalesce("b", F.lit(0)) == 0, F.col("new_id")).otherwise(F.col("b"))).select(*edits.columns), "edits")


def swap_from(df: DataFrame, mask: DataFrame, swaps: DataFrame, only_there: bool = False) -> tuple[DataFrame, DataFrame]:
    """From a frame on, or only in it, two tracks (movie_id, a, b, frame) exchange ids; a ``b`` of 0 or null is a new track.

    The exchanged rows lose parent and outcome; from a frame on, daughters born since then follow. Divisions that
    are invalid afterwards dissolve.
    """
    swaps = with_partners(df, mask, swaps)
    side = lambda x, y: swaps.select("movie_id", F.col(x).alias("old"), F.col(y).alias("new"), F.col("frame").alias("since"))
    both = side("a", "b").unionByName(side("b", "a")).withColumn("until", F.col("since") if only_there else F.lit(2**62))

    def exchanged(rows: DataFrame, c: str) -> DataFrame:
        rows = rows.join(both.withColumnRenamed("old", c), ["movie_id", c], "left")
        moved = F.coalesce((F.col("frame") >= F.col("since")) & (F.col("frame") <= F.col("until")), F.lit(False))
        return rows.withColumn("moved", moved).withColumn(c, F.when(F.col("moved"), F.col("new")).otherwise(F.col(c))).drop("new", "since", "until")

    rows = df
    if not only_there:
        born = lineage.spans(df).select(*TRACK, F.col("first_frame").alias("born"))
        rows = rows.join(born, TRACK, "left").join(both.select("movie_id", F.col("old").alias("parent_id"), "new", "since"), ["movie_id", "parent_id"], "left")
        rows = rows.withColumn("parent_id", F.when(F.col("born") >= F.col("since"), F.col("new")).otherwise(F.col("parent_id"))).select(*df.columns)
    rows = exchanged(rows, "track_id")
    rows = rows.withColumns({"outcome": F.when(F.col("moved"), F.lit("")).otherwise(F.col("outcome")), "parent_id": F.when(F.col("moved"), F.lit(-1)).otherwise(F.col("parent_id"))})
    if "continuous_label" in df.columns:
        rows = rows.withColumn("continuous_label", F.when(F.col("moved"), F.col("track_id")).otherwise(F.col("continuous_label")))
    return dissolve_invalid(rows.select(*df.columns)), exchanged(mask, "label").select(*mask.columns)


def relabel(df: DataFrame, mask: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks (movie_id, track_id) get new ids without parent and outcome; their daughters and pixels follow."""
    wanted = tracks.select(*TRACK).distinct().withColumn("ord", F.row_number().over(Window.partitionBy("movie_id").orderBy("track_id")).cast("long"))
    mapping = stored(minted_ids(_taken(df, mask), wanted).select("movie_id", F.col("track_id").alias("old"), F.col("new_id").alias("new")), "ids")
    rows = df.join(mapping.withColumnRenamed("old", "track_id"), TRACK, "left")
    moved = F.col("new").isNotNull()
    change = {"outcome": F.when(moved, F.lit("")).otherwise(F.col("outcome")), "parent_id": F.when(moved, F.lit(-1)).otherwise(F.col("parent_id")), "track_id": F.coalesce("new", "track_id")}
    change |= {"continuous_label": F.coalesce("new", "continuous_label")} if "continuous_label" in df.columns else {}
    rows = repoint(rows.withColumns(change).select(*df.columns), mapping)
    return dissolve_invalid(rows), renamed(mask, mapping, "label")


def minted_ids(df: DataFrame, wanted: DataFrame, quarantine: bool = False) -> DataFrame:
    """``wanted`` (movie_id, ord from 1) with ``new_id``: the smallest positive ids, or the smallest of the quarantine, that no track or parent has."""
    base = QUARANTINE_FROM if quarantine else 1
    used = df.select("movie_id", F.col("track_id").alias("id")).union(df.select("movie_id", "parent_id")).where(F.col("id") >= base).distinct()
    start = df.select("movie_id").distinct().select("movie_id", F.lit(base - 1).cast("long").alias("id"))
    w = Window.partitionBy("movie_id").orderBy("id")
    need = wanted.groupBy("movie_id").agg(F.max("ord").alias("need"))
    gaps = used.union(start).withColumn("next", F.lead("id").over(w)).join(need, "movie_id")
    free = F.coalesce(F.col("next") - F.col("id") - 1, F.col("need"))
    gaps = gaps.withColumn("free", F.least(free, F.col("need"))).where("free > 0").withColumn("before", F.coalesce(F.sum("free").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before < need")
    ids = gaps.select("movie_id", "before", F.posexplode(F.sequence(F.col("id") + 1, F.col("id") + F.col("free"))).alias("p", "new_id")).select("movie_id", (F.col("before") + F.col("p") + 1).alias("ord"), "new_id")
    return wanted.join(ids, ["movie_id", "ord"])


def delete(df: DataFrame, mask: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks (movie_id, track_id), or with a frame column only these observations, go from both tables; children of vanished tracks lose their parent."""
    key = [*TRACK, "frame"] if "frame" in gone.columns else TRACK
    left = df.join(gone.select(*key).distinct(), key, "left_anti")
    pix = mask.join(gone.select(*key).distinct().withColumnRenamed("track_id", "label"), ["label" if k == "track_id" else k for k in key], "left_anti")
    lost = df.select(*TRACK).distinct().join(left.select(*TRACK).distinct(), TRACK, "left_anti").select("movie_id", F.col("track_id").alias("parent_id"), F.lit(True).alias("lost"))
    rows = left.join(lost, ["movie_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("lost"), F.lit(-1)).otherwise(F.col("parent_id"))).select(*df.columns)
    return dissolve_invalid(rows), pix


def _new_rows(rows: DataFrame, fase: Column | None) -> DataFrame:
    """Rows of (movie_id, frame, track_id, ...) as new observations without parent and outcome."""
    fixed = {"continuous_label": F.col("track_id"), "outcome": F.lit(""), "parent_id": F.lit(-1).cast("long")}
    return rows.withColumns(fixed | ({"fase": fase} if fase is not None else {}))


def synced(df: DataFrame, mask: DataFrame, frames: DataFrame | None = None, fase: Column | None = None) -> DataFrame:
    """The observations with the mask's positions; labels without a row get one, rows without a label go.

    ``frames`` (movie_id, frame) restricts this to some frames; ``fase`` is the phase of new rows as an expression over ``frame``.
    ``done`` says what happened to a row, null in other frames.
    """
    here = [*TRACK, "frame"]
    c = pixels.centroids(mask).select("movie_id", "frame", F.col("label").alias("track_id"), F.col("x").alias("mx"), F.col("y").alias("my"))
    rest = None
    if frames is not None:
        keys = frames.select("movie_id", "frame").distinct()
        rest = df.join(keys, ["movie_id", "frame"], "left_anti").withColumn("done", F.lit(None).cast("string"))
        df, c = df.join(keys, ["movie_id", "frame"], "left_semi").select(*df.columns), c.join(keys, ["movie_id", "frame"], "left_semi")
    kept = df.join(c, here).withColumns({"pos_x": F.col("mx"), "pos_y": F.col("my")}).select(*df.columns, F.lit("updated").alias("done"))
    added = _new_rows(c.join(df.select(*here), here, "left_anti").select(*here, F.col("mx").alias("pos_x"), F.col("my").alias("pos_y")), fase)
    added = added.select(*(x for x in added.columns if x in df.columns), F.lit("added").alias("done"))
    out = kept.unionByName(added, allowMissingColumns=True)
    return out if rest is None else out.unionByName(rest)


def rescued_orphans(df: DataFrame, mask: DataFrame, fase: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with a new id, and a row, for every (frame, label) of the mask without a row."""
    orphans = pixels.centroids(mask).join(df.select("movie_id", "frame", F.col("track_id").alias("label")), pixels.OBJECT, "left_anti")
    orphans = orphans.withColumn("ord", F.row_number().over(Window.partitionBy("movie_id").orderBy("frame", "label")).cast("long"))
    new = stored(minted_ids(_taken(df, mask), orphans.select("movie_id", "ord")).join(orphans, ["movie_id", "ord"]).select(*pixels.OBJECT, "x", "y", "new_id"), "orphans")
    rows = _new_rows(new.select("movie_id", "frame", F.col("new_id").alias("track_id"), F.col("x").alias("pos_x"), F.col("y").alias("pos_y")), fase)
    pix = mask.join(new.select(*pixels.OBJECT, "new_id"), pixels.OBJECT, "left").withColumn("label", F.coalesce("new_id", "label")).select(*mask.columns)
    return df.unionByName(rows.select(*(x for x in rows.columns if x in df.columns)), allowMissingColumns=True), pix


def harmonised(df: DataFrame, mask: DataFrame, fase: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Every label one blob with the id of its track: smaller blobs get new ids and rows of unknown outcome without a position.

    Then pixels with the ``continuous_label`` of a row take its track_id, all at once (of several rows the largest id); the two
    columns agree afterwards. ``fase`` is the phase of the new rows as an expression over ``frame``.
    """
    parted = pixels.components(mask)
    blob = [*pixels.OBJECT, "part"]
    order = Window.partitionBy(*pixels.OBJECT).orderBy(F.col("n").desc(), "part")
    small = parted.groupBy(*blob).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where("r > 1")
    small = small.select(*blob, F.row_number().over(Window.partitionBy("movie_id").orderBy("frame", "label", "part")).cast("long").alias("ord"))
    new = stored(minted_ids(_taken(df, mask), small.select("movie_id", "ord")).join(small, ["movie_id", "ord"]).select(*blob, "new_id"), "blobs")
    named = df.where("continuous_label <> track_id").groupBy("movie_id", "frame", F.col("continuous_label").alias("label")).agg(F.max("track_id").alias("to"))
    pix = parted.join(new, blob, "left").join(named, pixels.OBJECT, "left").select("movie_id", "frame", "y", "x", F.coalesce("new_id", "to", "label").alias("label"))
    rows = new.select("movie_id", "frame", F.col("new_id").alias("track_id"), F.lit(-1).cast("long").alias("parent_id"), F.lit(UNKNOWN).alias("outcome"), *([fase.alias("fase")] if fase is not None else []))
    both = df.unionByName(rows, allowMissingColumns=True)
    return both.withColumn("continuous_label", F.col("track_id")).select(*df.columns), pix


def cut_ghosts(df: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and pixels of a mother from the first linked frame of her daughters on go to a new id, without parent and outcome."""
    since = df.where("parent_id > 0").groupBy("movie_id", F.col("parent_id").alias("track_id")).agg(F.min("frame").alias("since"))
    ghosts = df.join(since, TRACK).where("frame >= since").select(*TRACK, "since").distinct()
    wanted = ghosts.withColumn("ord", F.row_number().over(Window.partitionBy("movie_id").orderBy("track_id")).cast("long"))
    ids = stored(minted_ids(_taken(df, mask), wanted).select(*TRACK, "since", "new_id"), "ghosts")
    ghost = F.coalesce(F.col("frame") >= F.col("since"), F.lit(False))
    rows = df.join(ids, TRACK, "left").withColumn("ghost", ghost)
    change = {"track_id": F.col("new_id"), "parent_id": F.lit(-1), "outcome": F.lit("")} | ({"continuous_label": F.col("new_id")} if "continuous_label" in df.columns else {})
    rows = rows.withColumns({k: F.when(F.col("ghost"), v).otherwise(F.col(k)) for k, v in change.items()}).select(*df.columns)
    at = df.join(ids, TRACK).where("frame >= since").select("movie_id", "frame", F.col("track_id").alias("label"), "new_id").distinct()
    return rows, mask.join(at, pixels.OBJECT, "left").withColumn("label", F.coalesce("new_id", "label")).select(*mask.columns)


def relink(df: DataFrame, mask: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (movie_id, track_id, candidate) join their track on all frames, with their pixels; where both have a row the track's own stays."""
    mapping = chosen.select("movie_id", F.col("candidate").alias("old"), F.col("track_id").alias("new"))
    rows = df.join(mapping.withColumnRenamed("old", "track_id"), TRACK, "left").withColumn("joins", F.col("new").isNotNull().cast("int"))
    rows = rows.withColumn("track_id", F.coalesce("new", "track_id"))
    rows = rows.withColumn("continuous_label", F.coalesce("new", "continuous_label")) if "continuous_label" in df.columns else rows
    rows = repoint(rows.drop("new"), mapping)
    first = Window.partitionBy(*TRACK, "frame").orderBy("joins")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select(*df.columns), renamed(mask, mapping, "label")


def fill_gaps(df: DataFrame, fase: Column | None = None) -> DataFrame:
    """The observations and an interpolated row for each frame of the short gaps: the track's parent, no outcome, ``fase`` by frame."""
    flag = F.coalesce("interpolated", F.lit(False)) if "interpolated" in df.columns else F.lit(False)
    new = anomaly.gap_fills(df).join(df.select(*TRACK, "frame"), [*TRACK, "frame"], "left_anti").join(lineage.parent_map(df).withColumnRenamed("child", "track_id"), TRACK, "left")
    new = _new_rows(new, fase).withColumns({"parent_id": F.coalesce("parent", F.lit(-1)), "interpolated": F.lit(True)}).drop("parent")
    return df.withColumn("interpolated", flag).unionByName(new.select(*(x for x in new.columns if x in df.columns or x == "interpolated")), allowMissingColumns=True)
