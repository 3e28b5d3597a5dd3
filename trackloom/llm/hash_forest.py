"""Approximate nearest neighbours by a forest of hash prefixes.

Every row is indexed. Rows are dealt by a hash of their id into shards of bounded size; a shard holds, for
each tree, the sorted array of its rows' hash strings (signs of random projections). A query descends to its longest
matching prefix in every tree, and then all trees ascend together, one bit at a time, until the rows under
the prefixes are enough; these are compared exactly. Queries go in blocks of bounded size over all shards, and each
shard returns its nearest few, so what is gathered for a query is a few rows a shard.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, take no part;
vectors of different lengths are not compared; rows with the query's own id are no candidates; repeated
rows are candidates each; equal query rows are answered once; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

TREES, BITS = 40, 24
#: Rows of a shard, and queries that are sent to every task at a time.
SHARD_ROWS, QUERY_BLOCK = 8192, 8192
#: Part of a shard's rows at which the ascent ends. Recall on vectors spread evenly over a sphere needs as much.
ENOUGH = 0.6
#: Rows below which the ascent never ends, the query itself not counted: shards of fewer rows are compared as a whole.
LEAST = 256


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


class Forest:
    """Sorted hash strings of the rows of ``x`` for each tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.bits = bits
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits))
        keys = self.strings(x)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """For each tree, the hash string of each row as an integer, first bit highest."""
        signs = (x @ self.planes > 0).reshape(len(x), -1, self.bits)
        return (signs @ (np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place under the query's prefix, by tree, prefix length from 0 and query."""
        at = self.strings(queries)
        lo = np.empty((len(self.keys), self.bits + 1, len(queries)), np.int32)
        hi = np.empty_like(lo)
        for t, keys in enumerate(self.keys):
            for length in range(self.bits + 1):
                down = self.bits - length
                start = (at[t] >> down) << down
                lo[t, length] = np.searchsorted(keys, start)
                hi[t, length] = np.searchsorted(keys, start + (1 << down))
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, enough: float) -> np.ndarray:
        """Rows under the prefixes of one query: from the longest match up until they are enough."""
        rows = self.keys.shape[1]
        size = (hi - lo).sum(0)
        level = int(np.flatnonzero(size > 0).max(initial=0))
        while True:
            if size[level] >= enough or level == 0:
                found = np.zeros(rows, bool)
                for t in range(len(self.keys)):
                    found[self.order[t, lo[t, level] : hi[t, level]]] = True
                if level == 0 or found.sum() >= enough:
                    return np.flatnonzero(found)
            level -= 1


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, enough: float = ENOUGH) -> DataFrame:
    """query_id, rank, vec_id, score for ``vectors`` and ``queries`` of (vec_id, embedding): Euclidean distance in double precision."""
    cast = lambda df: df.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("width"))
    vectors = cast(vectors)
    queries = staged(cast(queries).dropDuplicates(["vec_id", "embedding"]), "queries")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    vectors = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).toArrow()
        sent = vectors.sparkSession.sparkContext.broadcast(block)
        part = vectors.groupBy("shard", "width").applyInArrow(_searched(sent, k, enough), "query_id long, query_row long, vec_id long, score double")
        part = part.withColumn("query_row", F.col("query_row") * blocks + b)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(sent, k: int, enough: float):
    def search(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("embedding"), width)
        block = sent.value
        rows = np.flatnonzero(block.column("width").to_numpy() == width)
        query_ids = block.column("vec_id").to_numpy()[rows]
        q = _matrix(block.column("embedding").take(pa.array(rows)), width)
        forest = Forest(x)
        out: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(rows), 512):
            lo, hi = forest.ranges(q[a : a + 512])
            for i in range(a, min(a + 512, len(rows))):
                own = int((ids == query_ids[i]).sum())
                near = forest.candidates(lo[:, :, i - a], hi[:, :, i - a], max(enough * len(ids), max(LEAST, k) + own))
                near = near[ids[near] != query_ids[i]]
                score = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                if len(near) > k:
                    keep = score <= np.partition(score, k - 1)[k - 1]
                    near, score = near[keep], score[keep]
                best = np.lexsort((ids[near], score))[:k]
                n = len(best)
                out.append((np.full(n, query_ids[i]), np.full(n, rows[i]), ids[near[best]], score[best]))
        found = [np.concatenate(c) if out else np.zeros(0) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c).cast(t) for n, c, t in zip(("query_id", "query_row", "vec_id", "score"), found, kinds, strict=True)})

    return search
