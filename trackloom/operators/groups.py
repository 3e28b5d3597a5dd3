"""Groups of tracks that edges join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import stored


def clusters(edges: DataFrame) -> DataFrame:
    """movie_id, id and root, the smallest id that the edges (movie_id, a, b) lead to, for all ids of edges.

    Roots fall to the smallest one among the neighbours and then jump to their root's root, so that long chains take few rounds.
    """
    ends = edges.select("movie_id", "a", "b").union(edges.select("movie_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ends = stored(ends, "ends")
    roots = stored(ends.groupBy("movie_id", F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = ends.join(roots.withColumnRenamed("id", "b"), ["movie_id", "b"]).groupBy("movie_id", F.col("a").alias("id")).agg(F.min("root").alias("near"))
        nearer = roots.join(near, ["movie_id", "id"]).select("movie_id", "id", F.col("root").alias("was"), F.least("root", "near").alias("next"))
        jump = roots.select("movie_id", F.col("id").alias("next"), F.col("root").alias("far"))
        new = nearer.join(jump, ["movie_id", "next"]).select("movie_id", "id", F.least("next", "far").alias("root"), "was")
        new = stored(new, "roots")
        roots = new.select("movie_id", "id", "root")
        if new.where("root < was").isEmpty():
            return roots
