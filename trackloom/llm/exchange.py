"""Counting keys over a corpus with packed exchanges, and answers to whoever sent them.

Documents are dealt into batches of a few megabytes, written once as a table bucketed by batch, so that
every later pass groups by batch without moving texts again. A batch sends each of its distinct keys once, packed
by part of the key space; a part adds up what all batches sent and answers each of them in the order of
its keys. A key that a third of all documents hold is thus one entry a batch.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import mix
from .shared import exchanges_freed, shared_dir

#: Bytes of text in a batch, bytes of text in a file of the table, and entries that one part adds up, all about.
BATCH, FILE, PART = 4 << 20, 32 << 20, 3_000_000


def batched(docs: DataFrame) -> tuple[DataFrame, int]:
    """A table (batch, doc_id, text) bucketed by batch, and the bytes of all texts. Null texts are kept."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    batches = max(1, -(-total // BATCH))
    files = min(batches, max(24, -(-total // FILE)))
    name = f"batches_{uuid.uuid4().hex}"
    rows = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")).repartition(files, "batch")
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    with exchanges_freed(spark):
        writer.bucketBy(files, "batch").sortBy("batch").saveAsTable(name)
    return spark.table(name), total


def parts_of(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """The parts that hold some of the keys, and the places of these keys in order."""
    part = (mix(keys) >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[cut[p] : cut[p + 1]]) for p in range(parts) if cut[p] < cut[p + 1]]


def narrow(x: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes end to end as a binary column whose rows end there."""
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows of a binary column end to end."""
    found = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else [0]
        found.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8))
    return np.concatenate(found) if found else np.zeros(0, np.uint8)


def widen(data: bytes | np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def squeezed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def opened(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def gathered(table: pa.Table, column: str) -> list[bytes]:
    return table.column(column).to_pylist()


def batches_of(found: Iterator[tuple], names: list[str], schema: pa.Schema) -> pa.Table:
    """Rows of Python values as an Arrow table."""
    rows = list(found)
    return pa.table([pa.array([r[i] for r in rows], schema.field(n).type) for i, n in enumerate(names)], schema=schema)


def passed(table: DataFrame, answers: DataFrame | None, work: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """``work`` on every batch with the answers that came back to it; the texts are not moved."""
    if answers is None:
        return table.groupBy("batch").applyInArrow(lambda t: work(t, None), schema)

    def both(t: pa.Table, a: pa.Table) -> pa.Table:
        return work(t, a)

    return table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(both, schema)
