"""Work tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a new temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def exchanges_freed(spark: SparkSession) -> Iterator[None]:
    """Within, a write deletes the files of its exchanges when it ends: what reads the table never reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    A lost executor costs the tasks that it ran, never the written table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with exchanges_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows in a batch that goes to a Python worker: texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the corpus; the session then hands rows to Python in batches of ``BATCH_ROWS``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids up to this many are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of a whole row; nulls count as values of their own."""
    return F.xxhash64(*(x for c in docs.columns for x in (F.col(c), F.col(c).isNull())))


def without(docs: DataFrame, rows: DataFrame, gone: bool = True) -> DataFrame:
    """The rows of ``docs`` whose hash is not among ``rows`` (a column ``row``), or with ``gone`` false, those that are."""
    rows = staged(rows.select(F.col("row").alias("judged_row")).distinct(), "rows")
    by = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    return docs.join(by, row_hash(docs) == by["judged_row"], "left_anti" if gone else "left_semi")
