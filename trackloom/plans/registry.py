"""All registered queries of the library and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_clean, q_consolidation, q_edits, q_lineage, q_pixels, q_review, q_statistics, q_trajectory

_GROUPS = [q_clean, q_consolidation, q_edits, q_lineage, q_pixels, q_review, q_statistics, q_trajectory]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in _GROUPS for name, (query, _) in group.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
