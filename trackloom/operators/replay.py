"""Mixed corrections in the order of their numbers: as many at once as do not touch each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TRACK
from ..sources.work import stored
from . import edits as ed
from . import lineage
from .groups import clusters

#: Kinds of edits and what their columns mean: ``a`` is the track, or the mother of a link.
KINDS = ("flag", "unlink", "link", "force_link", "merge", "swap", "swap_there", "delete", "delete_there")


def touched(df: DataFrame, edits: DataFrame) -> DataFrame:
    """movie_id, seq, group: the groups of tracks that an edit may read or change.

    Tracks that any edit names together are one group, since from then on one may stand in for the other. An edit touches the
    groups of its tracks and of the mothers and daughters of anybody in these groups.
    """
    pairs = edits.select("movie_id", "a", F.coalesce("b", "a").alias("b"))
    named = edits.select("movie_id", "seq", F.explode(F.array("a", F.coalesce("b", "a"))).alias("id"))
    roots = stored(clusters(pairs), "aliases")
    group = lambda rows, c: rows.join(roots.select("movie_id", F.col("id").alias(c), "root"), ["movie_id", c], "left").withColumn("group", F.coalesce("root", c)).drop("root")
    kin = lineage.links(df).select("movie_id", "parent", "child")
    kin = group(group(kin, "parent").withColumnRenamed("group", "mothers"), "child").withColumnRenamed("group", "daughters").select("movie_id", "mothers", "daughters").distinct()
    own = group(named, "id").select("movie_id", "seq", "group").distinct()
    up = own.join(kin.select("movie_id", F.col("daughters").alias("group"), "mothers"), ["movie_id", "group"]).select("movie_id", "seq", F.col("mothers").alias("group"))
    down = own.join(kin.select("movie_id", F.col("mothers").alias("group"), "daughters"), ["movie_id", "group"]).select("movie_id", "seq", F.col("daughters").alias("group"))
    return own.union(up).union(down).distinct()


def levels(df: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits with ``level``: edits of a level touch nothing in common, and of two that do, the later one has the higher level."""
    left = stored(touched(df, edits), "touched")
    found, level = None, 1
    while True:
        turn = left.withColumn("turn", F.row_number().over(Window.partitionBy("movie_id", "group").orderBy("seq")))
        ready = stored(turn.groupBy("movie_id", "seq").agg(F.max("turn").alias("turn")).where("turn = 1").select("movie_id", "seq", F.lit(level).alias("level")), "ready")
        if ready.isEmpty():
            return edits.withColumn("level", F.lit(None).cast("int")) if found is None else edits.join(found, ["movie_id", "seq"])
        found = ready if found is None else found.unionByName(ready)
        left, level = stored(left.join(ready, ["movie_id", "seq"], "left_anti"), "touched"), level + 1


def _applied(df: DataFrame, mask: DataFrame, kind: str, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after edits of one kind that do not touch each other."""
    track = batch.select("movie_id", F.col("a").alias("track_id"), "frame", "flag")
    if kind == "flag":
        return ed.apply_flags(df, track.select("movie_id", "track_id", "flag")), mask
    if kind == "unlink":
        return ed.unlink(df, track), mask
    if kind in ("link", "force_link"):
        return ed.link(df, batch.select("movie_id", F.col("a").alias("mother"), F.col("b").alias("daughter")), force=kind == "force_link"), mask
    if kind == "merge":
        known = df.select("movie_id", F.col("track_id").alias("a")).distinct()
        return ed.merge(df, mask, batch.join(known, ["movie_id", "a"], "left_semi").where("a <> b").select("movie_id", "a", "b"))
    if kind in ("swap", "swap_there"):
        return ed.swap_from(df, mask, batch.where("a <> b").select("movie_id", "a", "b", "frame"), only_there=kind == "swap_there")
    if kind not in ("delete", "delete_there"):
        raise ValueError(f"no such edit: {kind}")
    return ed.delete(df, mask, track.select("movie_id", "track_id") if kind == "delete" else track.select("movie_id", "track_id", "frame"))


def involved(pairs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """movie_id, id: the tracks that edits name; and movie_id, id, only_read: all whose rows the edits may change or must see.

    ``pairs`` (movie_id, track_id, parent_id) are those of the observations. Beside its own tracks an edit changes their mothers and daughters,
    and all daughters of a mother whose divisions dissolve. The other mothers of all these are seen only: they tell whether a division is valid.
    """
    down = lambda ids: pairs.join(ids.withColumnRenamed("id", "parent_id"), ["movie_id", "parent_id"], "left_semi").select("movie_id", F.col("track_id").alias("id"))
    up = lambda ids: pairs.where("parent_id > 0").join(ids.withColumnRenamed("id", "track_id"), TRACK, "left_semi").select("movie_id", F.col("parent_id").alias("id"))
    named = stored(edits.select("movie_id", F.explode(F.array("a", "b")).alias("id")).where("id IS NOT NULL").distinct(), "named")
    kin = stored(named.union(up(named)).union(down(named)).distinct(), "kin")
    own = stored(kin.union(down(kin)).distinct(), "own")
    seen = up(own).distinct().join(own, ["movie_id", "id"], "left_anti")
    return named, stored(own.withColumn("only_read", F.lit(False)).unionByName(seen.withColumn("only_read", F.lit(True))), "involved")


def _with_ids(rows: DataFrame, ids: DataFrame, how: str, c: str) -> DataFrame:
    """A join of rows whose column ``c`` is among ``ids`` (movie_id, id, ...); a null id stands for rows without one."""
    ids = ids.withColumnsRenamed({"movie_id": "of_movie", "id": "of_id"})
    return rows.join(ids, (F.col("movie_id") == F.col("of_movie")) & F.col(c).eqNullSafe(F.col("of_id")), how)


def replayed(df: DataFrame, mask: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after all ``edits`` (movie_id, seq, kind, a, b, frame, flag), as if these were made one by one by ``seq``.

    ``seq`` is a number of its own for each edit of a movie; ``kind`` is one of ``KINDS``; columns that a kind has no use for are null. Divisions that are invalid beforehand dissolve first.
    A swap without ``b`` gets a new id before all edits, so the ids of later ones do not depend on the order. Merges chain: after 1 into 2 and 2 into 3 all is
    track 3. A merge of a track that is no longer there does nothing. Edits run level by level; the number of levels is the
    longest chain of edits that touch each other, however many edits and movies there are. Levels read and write only the rows of ``involved`` tracks;
    all others pass by once.
    """
    df, mask = stored(df, "observations"), stored(mask, "pixels")  # both are read several times
    bare = F.col("kind").isin("swap", "swap_there") & (F.coalesce("b", F.lit(0)) == 0)
    edits = stored(edits, "edits")
    if not edits.where(bare).isEmpty():
        edits = edits.where(~bare).unionByName(ed.with_partners(df, mask, edits.where(bare)))
    df = stored(ed.dissolve_invalid(df), "observations")
    pairs = stored(df.select(*TRACK, "parent_id").distinct(), "pairs")
    edits = stored(levels(pairs, edits), "levels")
    named, ids = involved(pairs, edits)
    part = _with_ids(df, ids, "inner", "track_id").withColumn("parent_id", F.when(F.col("only_read"), F.lit(-1)).otherwise(F.col("parent_id")))
    part, pix = stored(part.select(*df.columns, "only_read"), "part"), stored(_with_ids(mask, named, "left_semi", "label"), "part_pixels")
    for level, kind in sorted(map(tuple, edits.select("level", "kind").distinct().collect())):  # levels times kinds
        out, changed = _applied(part, pix, kind, edits.where((F.col("level") == level) & (F.col("kind") == kind)))
        part, pix = stored(out, "part"), pix if changed is pix else stored(changed, "part_pixels")
    rest = _with_ids(df, ids.where("NOT only_read"), "left_anti", "track_id")
    return rest.unionByName(part.where("NOT only_read").select(*df.columns)), _with_ids(mask, named, "left_anti", "label").unionByName(pix.select(*mask.columns))
