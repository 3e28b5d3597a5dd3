"""Exact quantiles of groups of any size, by refining counts between bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored

#: Values of a group up to which one aggregation buffer holds them all, cells of a refinement, and values that a cell may hold to be sorted.
DIRECT, CELLS, FINISH = 100_000, 256, 1000


def _even(c: str) -> Column:
    return F.col(c) / 2  # halves: differences do not overflow


def _logarithmic(c: str) -> Column:
    """Rises with a finite number, evenly with its logarithm on either side of 0."""
    return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.signum(c) * (F.ln(F.abs(c)) + 800))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], direct: int = DIRECT, finish: int = FINISH) -> DataFrame:
    """``by``, n and p, the interpolated quantiles of a column at the ``shares``, as ``percentile`` gives them.

    Where no group has more than ``direct`` values, ``percentile`` itself answers. Otherwise each rank that a quantile needs lies
    between bounds, at first the ends of its group; a round counts the values in cells between the bounds, by turns evenly spaced and spaced by
    their logarithms, and goes on with the one cell that holds the rank, and with the ends of what is in it. Ranks in cells of at most ``finish`` values, or of one value, are
    settled; so no buffer holds more, and a round is one pre-aggregated exchange of at most ``CELLS`` rows a rank and task.
    Nulls and NaN are left out; infinite values are not allowed; groups are not null.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    rows = stored(rows, "values")
    ends = stored(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")), "ends")
    if (ends.agg(F.max("n")).first()[0] or 0) <= direct:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("value", F.array(*(F.lit(s) for s in shares))).alias("p"))
    asked = ends.select(*by, "n", F.posexplode(F.array(*(F.lit(float(s)) for s in shares))).alias("i", "share")).withColumn("at", (F.col("n") - 1) * F.col("share"))
    asked = asked.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    ranks = asked.select(*by, F.explode(F.array("low", "high")).alias("rank")).distinct()
    hit = stored(ranks.join(ends, by).select(*by, "rank", "lo", "hi", F.lit(0).cast("long").alias("start"), F.col("n").alias("c")), "ranks")
    cell = [*by, "lo", "hi"]
    settled, spaced = None, _even
    while True:
        done = hit.where((F.col("lo") == F.col("hi")) | (F.col("c") <= finish))
        settled = done if settled is None else settled.unionByName(done)
        left = hit.where((F.col("lo") < F.col("hi")) & (F.col("c") > finish))
        if left.isEmpty():
            break
        within = rows.join(left.select(*cell, "start").distinct(), by).where("value BETWEEN lo AND hi")
        width = spaced("hi") - spaced("lo")
        place = F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor((spaced("value") - spaced("lo")) / width * CELLS))).otherwise(0)
        spaced = _logarithmic if spaced is _even else _even
        counts = within.groupBy(*cell, "start", place.alias("place")).agg(F.count("*").alias("c"), F.min("value").alias("mn"), F.max("value").alias("mx"))
        before = Window.partitionBy(*cell).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows
        counts = counts.withColumn("first", F.col("start") + F.coalesce(F.sum("c").over(before), F.lit(0))).drop("start")
        new = left.select(*cell, "rank").join(counts, cell).where("rank >= first AND rank < first + c")
        hit = stored(new.select(*by, "rank", F.col("mn").alias("lo"), F.col("mx").alias("hi"), F.col("first").alias("start"), "c"), "ranks")
    small = settled.where("lo < hi")
    sorts = rows.join(small.select(*cell).distinct(), by).where("value BETWEEN lo AND hi").groupBy(*cell).agg(F.sort_array(F.collect_list("value")).alias("v"))
    values = small.join(sorts, cell).select(*by, "rank", F.get("v", (F.col("rank") - F.col("start")).cast("int")).alias("v"))
    values = stored(values.union(settled.where("lo = hi").select(*by, "rank", F.col("lo").alias("v"))), "ranks")
    side = lambda k: values.select(*by, F.col("rank").alias(k), F.col("v").alias(f"v_{k}"))
    found = asked.join(side("low"), [*by, "low"]).join(side("high"), [*by, "high"])
    between = (F.col("high") - F.col("at")) * F.col("v_low") + (F.col("at") - F.col("low")) * F.col("v_high")
    found = found.withColumn("q", F.when(F.col("v_low") == F.col("v_high"), F.col("v_low")).otherwise(between))
    return found.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("p"))


def medians(df: DataFrame, by: list[str], value: str, name: str, direct: int = DIRECT) -> DataFrame:
    """``by`` and the median of a column as ``name``."""
    return quantiles(df, by, value, [0.5], direct).select(*by, F.col("p")[0].alias(name))
