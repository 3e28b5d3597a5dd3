"""Published versions of derived tables: all tables of a version become visible at once, and their origin stands beside them.

A version's tables are written first, each under a folder of its own; then one row in the list of versions makes it the latest. Until that row is
committed, readers get the version before, whatever has failed. Older versions stay where they are.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import TRACK
from .tables import channel_columns
from .work import stored

VERSIONS = "_versions"
LISTED = "ordinal long, version string, attempt string, tables array<string>, provenance map<string,string>, published_at timestamp"


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The list of versions; an empty one where nothing has been published."""
    try:
        return spark.read.schema(LISTED).parquet(f"{path}/{VERSIONS}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTED)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Published versions in order, with their tables and their origin."""
    return _listed(spark, path).drop("attempt").orderBy("ordinal")


def publish(tables: dict[str, DataFrame], path: str, version: str, provenance: dict[str, object] | None = None) -> None:
    """Write the tables as a new version under ``path`` and make it the latest.

    ``provenance`` says where the numbers come from: files and kinds of channels, ring options, pixel size, source of times. A published
    version is never overwritten; an attempt that failed may be repeated. One writer at a time; names hold letters, digits, ``_``, ``.`` and ``-``.
    """
    if not tables:
        raise ValueError("no tables to publish")
    for name in [version, *tables]:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
            raise ValueError(f"not a name: {name}")
    spark = next(iter(tables.values())).sparkSession
    last, known = 0, False
    for r in _listed(spark, path).groupBy().agg(F.max("ordinal").alias("last"), F.bool_or(F.col("version") == version).alias("known")).collect():
        last, known = r["last"] or 0, bool(r["known"])
    if known:
        raise ValueError(f"version {version} is published already")
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}/version={version}/attempt={attempt}")
    row = spark.createDataFrame([(last + 1, version, attempt, sorted(tables), {k: str(v) for k, v in (provenance or {}).items()}, None)], LISTED)
    row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/{VERSIONS}")


def table(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the latest version, or of a given one."""
    found = _listed(spark, path).where(F.array_contains("tables", name))
    found = found.where(F.col("version") == version) if version else found
    row = found.orderBy(F.desc("ordinal")).first()
    if row is None:
        raise ValueError(f"no published table {name}" + (f" of version {version}" if version else ""))
    return spark.read.parquet(f"{path}/{name}/version={row['version']}/attempt={row['attempt']}")


def derived(tracks: DataFrame, features: DataFrame, windows: DataFrame, summary: DataFrame, validated: DataFrame, channels: list[str] = (), times: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a version by name: features, windows and summary whole and of the validated tracks (movie_id, track_id) only.

    Beside them the validated rows of ``tracks``, the columns of each channel, and the time axis if there is one. Each input is read by several
    of the tables, so costly ones should be stored; the validated tracks are stored here.
    """
    chosen = stored(validated.select(*TRACK).distinct(), "validated")
    found = {"validated_cells": tracks.join(chosen, TRACK, "left_semi")}
    for name, df in {"features": features, "windows": windows, "summary": summary}.items():
        found |= {name: df, f"{name}_validated": df.join(chosen, TRACK, "left_semi")}
    for c in channels:
        part = channel_columns(features, c)
        if len(part.columns) > len(TRACK) + 1:
            found[f"fluorescence_{c}"] = part
    return found | ({"time_index": times} if times is not None else {})
