"""Division lineages (L operators): links, roots, families, labels and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TRACK
from ..schema import NON_FLAG
from ..sources.work import stored


def links(df: DataFrame) -> DataFrame:
    """Distinct (movie_id, parent, child)."""
    return df.where("parent_id > 0 AND track_id > 0").select("movie_id", F.col("parent_id").alias("parent"), F.col("track_id").alias("child")).distinct()


def parent_map(df: DataFrame) -> DataFrame:
    """One parent for each child: that of its latest linked row, the larger id if several."""
    rows = df.where("parent_id > 0 AND track_id > 0")
    return rows.groupBy("movie_id", F.col("track_id").alias("child")).agg(F.max_by("parent_id", F.struct("frame", "parent_id")).alias("parent"))


def spans(df: DataFrame) -> DataFrame:
    return df.groupBy(*TRACK).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def classified(df: DataFrame) -> DataFrame:
    """movie_id, track_id, role (mother, daughter, single) and the sorted children of mothers; singles are flagged and unlinked."""
    edges = links(df)
    mothers = edges.groupBy("movie_id", F.col("parent").alias("track_id")).agg(F.sort_array(F.collect_set("child")).alias("children"))
    daughters = edges.select("movie_id", F.col("child").alias("track_id")).distinct()
    flagged = df.where((F.col("track_id") > 0) & F.coalesce(~F.col("outcome").isin(NON_FLAG), F.lit(False))).select(*TRACK).distinct()
    singles = flagged.join(mothers, TRACK, "left_anti").join(daughters, TRACK, "left_anti")
    none = F.array().cast("array<bigint>")
    return (
        mothers.select(*TRACK, F.lit("mother").alias("role"), "children")
        .unionByName(daughters.select(*TRACK, F.lit("daughter").alias("role"), none.alias("children")))
        .unionByName(singles.select(*TRACK, F.lit("single").alias("role"), none.alias("children")))
    )


def roots(df: DataFrame) -> DataFrame:
    """movie_id, track_id, root_id: followed from parent to parent; a mother without rows may be the root.

    Pointers double in every round, so the rounds are the logarithm of the depth. On a cycle every member
    ends at the smallest id.
    """
    up = parent_map(df)
    ids = df.where("track_id > 0").select(*TRACK).union(up.select("movie_id", "parent")).distinct()
    parent = F.coalesce("parent", "track_id")
    at = stored(ids.join(up.withColumnRenamed("child", "track_id"), TRACK, "left").select(*TRACK, parent.alias("root_id"), F.least(parent, "track_id").alias("least")), "roots")
    rounds = max(1, ids.count()).bit_length() + 1  # enough for any path; what still moves then is on a cycle
    for _ in range(rounds):
        far = at.select("movie_id", F.col("track_id").alias("root_id"), F.col("root_id").alias("next"), F.col("least").alias("lower"))
        new = at.join(far, ["movie_id", "root_id"]).select(*TRACK, F.col("next").alias("root_id"), F.least("least", "lower").alias("least"), (F.col("next") != F.col("root_id")).alias("moved"))
        at = stored(new, "roots")
        if at.where("moved").isEmpty():
            return at.select(*TRACK, "root_id")
    ends = at.select("movie_id", F.col("track_id").alias("root_id"), F.col("root_id").alias("again"), F.col("least").alias("cycle"))
    resolved = at.join(ends, ["movie_id", "root_id"])
    return resolved.select(*TRACK, F.when(F.col("again") == F.col("root_id"), F.col("root_id")).otherwise(F.col("cycle")).alias("root_id"))


def families(df: DataFrame) -> DataFrame:
    """movie_id, root_id, the sorted members and their number."""
    return roots(df).groupBy("movie_id", "root_id").agg(F.sort_array(F.collect_set("track_id")).alias("members"), F.count_distinct("track_id").alias("size"))


def lineage_roots(df: DataFrame) -> DataFrame:
    """Mothers that are no daughters, flagged singles, and the roots of all mothers."""
    kinds = classified(df)
    mothers = kinds.where("role = 'mother'").select(*TRACK)
    top = mothers.join(kinds.where("role = 'daughter'").select(*TRACK), TRACK, "left_anti")
    of_mothers = roots(df).join(mothers, TRACK, "left_semi").select("movie_id", F.col("root_id").alias("track_id"))
    return top.union(kinds.where("role = 'single'").select(*TRACK)).union(of_mothers).distinct()


def labels(df: DataFrame) -> DataFrame:
    """movie_id, track_id, label, generation: roots numbered by (first frame, id), children ``.k`` by (birth, id).

    Each track holds the way up to some ancestor; a round puts the ancestor's own way before it, so the rounds are the
    logarithm of the depth. Tracks on or below a cycle have no root and no label.
    """
    first = spans(df).select(*TRACK, "first_frame")
    edges = parent_map(df)
    far = F.coalesce("first_frame", F.lit(10**9))
    top = lineage_roots(df).join(edges.select("movie_id", F.col("child").alias("track_id")), TRACK, "left_anti").join(first, TRACK, "left")
    top = stored(top.select(*TRACK, F.row_number().over(Window.partitionBy("movie_id").orderBy(far, "track_id")).cast("string").alias("label")), "labels")
    below = roots(df).join(top.select("movie_id", F.col("track_id").alias("root_id"), "label"), ["movie_id", "root_id"]).where("track_id <> root_id")
    order = Window.partitionBy("movie_id", "parent").orderBy(far, "child")
    ranked = edges.join(first.withColumnRenamed("track_id", "child"), ["movie_id", "child"], "left").withColumn("k", F.row_number().over(order))
    steps = ranked.select("movie_id", F.col("child").alias("track_id"), F.col("parent").alias("up"), F.col("k").cast("string").alias("way"), F.lit(1).cast("long").alias("generation"))
    at = stored(steps.join(below.select(*TRACK), TRACK, "left_semi"), "ways")
    while True:
        far = at.select("movie_id", F.col("track_id").alias("up"), F.col("up").alias("next"), F.col("way").alias("before"), F.col("generation").alias("more"))
        new = at.join(far, ["movie_id", "up"], "left").withColumn("moved", F.col("next").isNotNull())
        change = {"way": F.concat_ws(".", "before", "way"), "generation": F.col("generation") + F.coalesce("more", F.lit(0)), "up": F.coalesce("next", "up")}
        new = stored(new.withColumns(change).select(*TRACK, "up", "way", "generation", "moved"), "ways")
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    named = at.join(below.select(*TRACK, "label"), TRACK).select(*TRACK, F.concat_ws(".", "label", "way").alias("label"), "generation")
    return top.withColumn("generation", F.lit(0).cast("long")).unionByName(named)


def violations(df: DataFrame) -> DataFrame:
    """movie_id, track_id (the mother), kind: more than two daughters, one born before or with it, or it outlives a division."""
    edges, span = links(df), spans(df)
    side = lambda k: span.select("movie_id", F.col("track_id").alias(k), F.col("first_frame").alias(f"first_{k}"), F.col("last_frame").alias(f"last_{k}"))
    both = edges.join(side("child"), ["movie_id", "child"], "left").join(side("parent"), ["movie_id", "parent"], "left")
    per = both.groupBy("movie_id", F.col("parent").alias("track_id")).agg(
        (F.count("*") > 2).alias("daughters"),
        F.bool_or(F.col("first_child") <= F.col("first_parent")).alias("born"),
        (F.first("last_parent") >= F.min(F.coalesce("first_child", F.lit(10**9)))).alias("outlives"),
    )
    kinds = F.array_compact(F.array(F.when(F.col("daughters"), F.lit("too many daughters")), F.when(F.col("born"), F.lit("daughter not after mother")), F.when(F.col("outlives"), F.lit("mother outlives division"))))
    return per.select(*TRACK, F.explode(kinds).alias("kind"))


def checked_links(df: DataFrame, proposed: DataFrame) -> DataFrame:
    """The first reason against each proposed (movie_id, mother, daughter), null if there is none."""
    span = spans(df)
    side = lambda k: span.select("movie_id", F.col("track_id").alias(k), F.col("first_frame").alias(f"first_{k}"))
    count = links(df).groupBy("movie_id", F.col("parent").alias("mother")).agg(F.count("*").alias("n"))
    has = parent_map(df).select("movie_id", F.col("child").alias("daughter"), F.col("parent").alias("old"))
    rows = proposed.join(side("mother"), ["movie_id", "mother"], "left").join(side("daughter"), ["movie_id", "daughter"], "left").join(count, ["movie_id", "mother"], "left").join(has, ["movie_id", "daughter"], "left")
    reason = (
        F.when(F.col("mother") == F.col("daughter"), "self")
        .when(F.col("first_mother").isNull() | F.col("first_daughter").isNull(), "missing")
        .when(F.coalesce("n", F.lit(0)) >= 2, "two daughters already")
        .when(F.col("old").isNotNull() & (F.col("old") != F.col("mother")), "other mother")
        .when(F.col("first_daughter") <= F.col("first_mother"), "not born after mother")
    )
    return rows.select("movie_id", "mother", "daughter", reason.alias("reason"))


def ranked_families(df: DataFrame, max_families: int = 60, max_nodes: int = 400) -> DataFrame:
    """The largest families in order, taken until one more would break a limit; at least one. Single tracks only where a movie has nothing else."""
    largest = F.max("size").over(Window.partitionBy("movie_id"))
    sized = families(df).select("movie_id", "root_id", "size").withColumn("largest", largest).where("size > 1 OR largest = 1").drop("largest")
    order = Window.partitionBy("movie_id").orderBy(F.col("size").desc(), "root_id")
    rows = sized.withColumn("rank", F.row_number().over(order)).withColumn("nodes", F.sum("size").over(order))
    broken = F.max(((F.col("rank") > max_families) | (F.col("nodes") > max_nodes)).cast("int")).over(order)
    return rows.withColumn("broken", broken).where("rank = 1 OR broken = 0").select("movie_id", "root_id", "size", F.col("rank").cast("long").alias("rank"))


def generations(df: DataFrame, max_families: int = 60, max_nodes: int = 400) -> DataFrame:
    """Members of the ranked families with their depth and parent, null at the root."""
    chosen = ranked_families(df, max_families, max_nodes).select("movie_id", "root_id")
    members = roots(df).join(chosen, ["movie_id", "root_id"], "left_semi")
    depth = labels(df).select(*TRACK, "generation")
    parents = parent_map(df).select("movie_id", F.col("child").alias("track_id"), "parent")
    return members.join(depth, TRACK, "left").join(parents, TRACK, "left").select("movie_id", "root_id", "track_id", "generation", "parent")


def next_unreviewed(df: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per movie, the track that begins first among the lineages whose root is not in ``reviewed`` (movie_id, root_id)."""
    open_ = roots(df).join(reviewed, ["movie_id", "root_id"], "left_anti").join(spans(df), TRACK)
    return open_.groupBy("movie_id").agg(F.min_by("track_id", F.struct("first_frame", "track_id")).alias("track_id"))


def next_uncurated(df: DataFrame, after: int) -> DataFrame:
    """Per movie, the first frame after ``after`` that holds a track outside all lineages, and the smallest such track."""
    known = classified(df).select(*TRACK)
    rows = df.where((F.col("frame") > after) & (F.col("track_id") > 0)).join(known, TRACK, "left_anti")
    return rows.groupBy("movie_id").agg(F.min("frame").alias("frame"), F.min_by("track_id", F.struct("frame", "track_id")).alias("track_id"))
