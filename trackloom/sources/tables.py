"""Readers of foreign tables, review state and writers (S operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import TRACK
from ..operators import clean
from ..schema import CANDIDATES, SPOTS

NUMERIC = {"track_id": "bigint", "frame": "bigint", "pos_x": "double", "pos_y": "double", "parent_id": "bigint"}


def guessed_columns(names: list[str], given: dict[str, str] | None = None, candidates: dict[str, list[str]] = CANDIDATES) -> dict[str, str]:
    """Target to source name: as given, else the likeliest candidate, in its own letter case before any other."""
    lower = {n.lower(): n for n in reversed(names)}
    found = {}
    for target, tried in candidates.items():
        if given and given.get(target):
            found[target] = given[target]
            continue
        hit = next((n for c in tried for n in (c if c in names else lower.get(c.lower()),) if n), None)
        if hit:
            found[target] = hit
    return found


def standardised(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Mapped columns under their own names; shadowed ones go; numbers that cannot be read become null."""
    shadowed = [c for c in df.columns for t, s in columns.items() if c.lower() == t and c != s]
    df = df.drop(*shadowed).withColumnsRenamed({s: t for t, s in columns.items() if s != t})
    for c, kind in NUMERIC.items():
        if c in df.columns:
            number = F.expr(f"try_cast(`{c}` AS double)")
            df = df.withColumn(c, (number if kind == "double" else number.cast("bigint")))
    return df


def generic_table(df: DataFrame, given: dict[str, str] | None = None) -> DataFrame:
    return standardised(df, guessed_columns(df.columns, given))


def spots_export(df: DataFrame) -> DataFrame:
    """A spots export by the first name of each column that is there; header remnants, rows without a frame, go."""
    return standardised(df, guessed_columns(df.columns, candidates=SPOTS)).dropna(subset=["frame"])


def track_list(lines: DataFrame) -> DataFrame:
    """Lines ``L B E P`` (label, first and last frame, parent) as one row for each frame, at (-1, -1)."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.select(part.alias("p")).select(*(F.expr(f"try_cast(get(p, {i}) AS bigint)").alias(n) for i, n in enumerate("LBEP"))).where("B <= E")
    return rows.select(F.col("L").alias("track_id"), F.explode(F.sequence("B", "E")).alias("frame"), F.lit(-1.0).alias("pos_x"), F.lit(-1.0).alias("pos_y"), F.lit("").alias("outcome"), F.when(F.col("P") > 0, F.col("P")).otherwise(-1).alias("parent_id"))


def load(df: DataFrame, mask: DataFrame | None = None, frames: DataFrame | None = None, given: dict[str, str] | None = None) -> DataFrame:
    """The whole load: columns, fates, links, mothers, then area, border and border exits where pixels are there."""
    df = generic_table(df, given)
    df = df if "movie_id" in df.columns else df.withColumn("movie_id", F.lit(0).cast("long"))
    df = df.withColumn("outcome", clean.translated_outcome(F.col("outcome")) if "outcome" in df.columns else F.lit(""))
    df = df if "parent_id" in df.columns else df.withColumn("parent_id", F.lit(-1).cast("long"))
    df = clean.flag_mothers(clean.standard_links(df))
    if mask is not None:
        df = clean.flag_border_exits(clean.with_area(clean.with_border(df, mask, frames), mask))
    return df


#: Columns of a saved table; whole numbers are read as doubles first, since other tools write them so where some are missing.
SAVED = {
    "movie_id": "bigint", "track_id": "bigint", "frame": "bigint", "pos_x": "double", "pos_y": "double", "outcome": "string", "parent_id": "bigint",
    "continuous_label": "bigint", "area_px": "double", "fase": "string", "at_border": "boolean", "interpolated": "boolean",
}


def reopened(spark: SparkSession, path: str) -> DataFrame:
    """A saved CSV table in the internal schema, its columns by name and with their own types.

    Unknown columns stay strings. A value that its type cannot hold becomes null, and ``bad_record`` holds that line; else it is null.
    Missing outcomes become '' and missing parents -1, as whole columns too.
    """
    names = spark.read.option("header", True).csv(path).columns
    kind = lambda c: {"bigint": "double"}.get(SAVED.get(c, "string"), SAVED.get(c, "string"))
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(kind(c))) for c in [*names, "bad_record"]])
    df = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "bad_record").csv(path)
    df = df.withColumns({c: F.col(c).try_cast("bigint") for c in names if SAVED.get(c) == "bigint"})
    outcome = F.coalesce("outcome", F.lit("")) if "outcome" in names else F.lit("")
    parent = F.coalesce("parent_id", F.lit(-1).cast("long")) if "parent_id" in names else F.lit(-1).cast("long")
    return df.withColumns({"outcome": outcome, "parent_id": parent})


def detected_format(names: list[str]) -> str:
    """``spots`` for a spots export, ``tracks`` for a list of tracks, else ``generic``, from the names in a header."""
    have = {n.strip().lower() for n in names}
    if {"track_id", "spot_id"} <= have or {"position_x", "position_t"} <= have:
        return "spots"
    if {"l", "b", "e", "p"} <= have or {"label", "begin", "end", "parent"} <= have:
        return "tracks"
    return "generic"


def opened(spark: SparkSession, path: str, given: dict[str, str] | None = None) -> DataFrame:
    """A tracker's table of any format in the internal schema: a ``.txt`` list of tracks, or a CSV file with a header.

    Which CSV format it is shows in the header; columns that are ``given`` by target name make it a generic one.
    """
    if path.lower().endswith(".txt"):
        return track_list(spark.read.text(path))
    df = spark.read.option("header", True).csv(path)
    kind = detected_format(df.columns)
    if kind == "spots" and not given:
        return spots_export(df)
    if kind == "tracks" and not given:
        short = {n.strip().lower(): n for n in df.columns}
        names = ["l", "b", "e", "p"] if "l" in short else ["label", "begin", "end", "parent"]
        return track_list(df.select(F.concat_ws(" ", *(F.col(f"`{short[n]}`") for n in names)).alias("value")))
    return generic_table(df, given)


def append_audit(spark: SparkSession, rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def channel_columns(features: DataFrame, channel: str) -> DataFrame:
    """Key columns and those whose name begins with the channel."""
    return features.select(*TRACK, "frame", *(c for c in features.columns if c.startswith(f"{channel}_")))


def marked(state: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """A set of review marks (movie_id, kind, id) with some added and some taken away."""
    return state.unionByName(add).dropDuplicates(["movie_id", "kind", "id"]).join(remove, ["movie_id", "kind", "id"], "left_anti")


def progress(state: DataFrame, existing: DataFrame) -> DataFrame:
    """Marked among existing (movie_id, id): done, total and percent."""
    done = existing.join(state.select("movie_id", "id").distinct().withColumn("m", F.lit(1)), ["movie_id", "id"], "left")
    return done.groupBy("movie_id").agg(F.count("m").alias("done"), F.count("*").alias("total"), F.round(100.0 * F.count("m") / F.count("*"), 6).alias("percent"))


def matched_frames(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each reference (frame, filename) the candidate of the same base name, the first of several; null if missing."""
    base = F.regexp_extract("filename", r"([^/\\]*)$", 1)
    first = candidates.withColumn("name", base).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("frame", "filename"))).where("r = 1")
    return reference.withColumn("name", base).join(first.select("name", F.col("filename").alias("match")), "name", "left").select("frame", "name", "match")
