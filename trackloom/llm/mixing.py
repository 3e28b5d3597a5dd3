"""Capped water-filling: weights shared out under epoch caps, then seeded whole and fractional repetitions.

The targets are ``min(cap, level * weight)``. Each round clamps the sources at their cap and raises the
level for the rest; the level is one number, so a round is one aggregate over the table of sources. The
fractional repetition of a source takes the documents whose seeded key lies below a threshold, which is
found from exact counts of words in ever finer cells of the key, kept apart by source: no source is
gathered or sorted in one task. DataFrame functions only.

Defined results: a null text has no words; null is a source of its own, after the others; a source
without words has target 0; rows with equal doc_id share one decision; an empty table gives no rows. Of the
caller's columns, those named like a result are replaced, all others are handed on, whatever their names. A text
of any length is one row's count of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

WORDS = r"[^\x20\x09-\x0D]+"
DIGITS = 3
RESULTS = ["size", "source_size", "target", "copies"]
#: Sources up to this many rows are broadcast; a larger table of sources is joined by shuffle.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Documents with their size in words and their seeded key."""
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"),
            "mix_key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")),
        }
    )


def water_level(sources: DataFrame, share: float) -> float | None:
    """The level at which ``sum(least(cap, level * weight))`` is ``share``; None if all caps together are no more."""
    level = 0.0
    clamped = -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
            F.count_if(full).alias("n"),
        ).first()
        if row["free"] is None:
            return None
        if row["n"] == clamped:
            return level
        clamped, level = row["n"], max(0.0, share - row["held"]) / row["free"]


def targets(docs: DataFrame, weights: list[float], total: float, max_epochs: float) -> DataFrame:
    """source, source_size, target, whole (repetitions of every document) and want (words of the fractional one)."""
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row a source
    sources = staged(
        sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((ranked - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")),
        "mix-sources",
    )
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, total * words)
    filled = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    return (
        sources.withColumn("target", filled)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    )


def _joined(docs: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    by = sources.withColumnRenamed("source", "mix_source")
    by = F.broadcast(by) if n <= BROADCAST_SOURCES else by
    return docs.join(by, docs["source"].eqNullSafe(by["mix_source"]), "left").drop("mix_source")


def thresholds(docs: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Per source, the key (bound, taken itself or not) at which the words below come nearest to ``want``."""
    open_cells = sources.select("source", "want", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    found, width = None, 0
    while True:
        cells = (
            _joined(docs.select("source", "size", "mix_key"), open_cells, n)
            .where(F.substring("mix_key", 1, width) == F.col("prefix") if width else F.col("want").isNotNull())
            .groupBy("source", F.substring("mix_key", 1, width + DIGITS).alias("cell"))
            .agg(F.sum("size").alias("words"), F.min("mix_key").alias("lo"), F.max("mix_key").alias("hi"), F.first("want").alias("want"), F.first("below").alias("start"))
        )
        before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
        hit = staged(
            cells.withColumn("below", F.col("start") + F.coalesce(F.sum("words").over(before), F.lit(0)))
            .where((F.col("below") <= F.col("want")) & (F.col("want") < F.col("below") + F.col("words"))),
            "mix-cells",
        )
        one = F.col("lo") == F.col("hi")
        done = hit.where(one).select("source", F.col("lo").alias("bound"), (F.col("want") - F.col("below") > F.col("below") + F.col("words") - F.col("want")).alias("inclusive"))
        found = done if found is None else found.unionByName(done)
        open_cells = hit.where(~one).select("source", "want", F.col("cell").alias("prefix"), "below")
        width += DIGITS
        if open_cells.isEmpty():
            return found


def mixed(docs: DataFrame, weights: list[float], total: float, max_epochs: float, seed: int = 0) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target``, and ``copies``: how often the mix holds each.

    ``weights`` are dealt to the sources in order of code points, again and again, null last. All targets
    together are ``total`` times the words of the table; none is above ``max_epochs`` times its source.
    """
    names = docs.columns
    docs = sized(docs.select("doc_id", "source", "text", F.struct(*names).alias("mix_row")), seed)
    slim = staged(docs.select("doc_id", "source", "size", "mix_key"), "mix-sizes")
    sources = staged(targets(slim, weights, total, max_epochs), "mix-targets")
    n = sources.count()
    bounds = thresholds(slim, sources, n)
    cut = sources.alias("s").join(bounds.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")), "left").select("s.*", "b.bound", "b.inclusive")
    cut = staged(cut, "mix-bounds")
    extra = F.col("bound").isNotNull() & ((F.col("mix_key") < F.col("bound")) | ((F.col("mix_key") == F.col("bound")) & F.col("inclusive")))
    found = _joined(docs, cut.select("source", "source_size", "target", "whole", "bound", "inclusive"), n).withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"))
    return found.select(*(F.col("mix_row")[c].alias(c) for c in names if c not in RESULTS), *RESULTS)
