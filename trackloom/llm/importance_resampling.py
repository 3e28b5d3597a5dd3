"""Importance resampling towards a target: array-scored weights, an exact cutoff by weighted medians, sorted winners.

The features of a text are its runs of words, each hashed into one of a fixed number of buckets. How often the buckets
occur in the documents and in the target is counted over all rows; the logarithm of the ratio of both shares is a
bucket's gain, and the gains are one array of bounded length that scores every text where it lies. A seeded Gumbel value
on top makes the highest scores a draw without replacement.

The lowest score drawn is found by selection, not by a sort of all rows: every partition tells the median of its keys
that are still open and how many these are; the weighted median of the medians is the next pivot, and as a quarter of
the open keys at least lies on either side of it, that part is discarded for good. The table of keys is written anew
each time it has shrunk to an eighth. Only the winners are sorted, by ranges, and numbered from the sizes of the ranges.

Defined results: a null text has no words; a text without features has weight 0; a null doc_id is drawn with the key
``null`` and comes first among equal scores; rows that repeat a doc_id share its random value, and rows equal in score
and doc_id are drawn in the order in which they were written; a target without rows or words counts nothing; an empty
table gives no rows; all other columns, whatever their names, are ignored. Texts are taken whole; one text is one
row's work, however long.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import ALNUM, Rolling, Texts, blocks
from .shared import staged

#: Open keys up to which the selection ends on the driver, and how far a table of keys shrinks before it is written anew.
FINISH, SHRUNK = 4096, 8
KEY = ("key_score", "key_doc", "key_row")

Key = tuple[int, int, int]


def _bucketed(texts: Texts, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each document, and of every run of 1 to ``longest`` words its document and its bucket."""
    words = texts.lowered().words(ALNUM)
    data, hashes, doc, count = words.texts.data, words.hashes(), words.doc(), words.counts()
    docs, found = [], []
    for k in range(1, longest + 1):
        first = np.flatnonzero(np.arange(len(words)) + k <= words.of[1:][doc])
        number, distinct = pd.factorize(Rolling(hashes).all(k)[first] if k > 1 else hashes)
        place = np.empty(len(distinct), np.int64)
        place[number[::-1]] = first[::-1]
        crc = [zlib.crc32(b" ".join(data[words.start[w] : words.end[w]].tobytes() for w in range(i, i + k))) % buckets for i in place.tolist()]
        docs.append(doc[first])
        found.append(np.array(crc, np.int64)[number])
    return count, np.concatenate(docs), np.concatenate(found)


def counted(docs: DataFrame, buckets: int, longest: int = 1) -> np.ndarray:
    """How often each bucket occurs in all texts: a task adds up its own, and at most ``buckets`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for block in blocks(batches):
            n += np.bincount(_bucketed(Texts.of(block.column("text")), buckets, longest)[2], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets)
    for r in rows:
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the logarithm of each bucket's share of the target over its share of the source, floored."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def scored(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every document."""
    gain = np.array(gains(counted(docs, buckets, longest), counted(target, buckets, longest)), np.float64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            count, doc, bucket = _bucketed(Texts.of(block.column("text")), buckets, longest)
            n = np.bincount(doc, minlength=len(count))
            total = np.bincount(doc, gain[bucket], minlength=len(count)).astype(np.int64)  # sums of whole numbers: exact
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (count, n, total // np.maximum(n, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + gumbel)


def _at_most(a: np.ndarray, bound: Key, same: bool) -> np.ndarray:
    """Which keys (columns of ``a``) lie below ``bound``, or with ``same``, are equal to it."""
    first, second, third = (x == b for x, b in zip(a, bound, strict=True))
    if same:
        return first & second & third
    return (a[0] < bound[0]) | (first & ((a[1] < bound[1]) | (second & (a[2] < bound[2]))))


def _medians(keys: DataFrame, low: Key | None, pivot: Key | None, high: Key | None) -> list:
    """For each partition, on either side of the pivot: the number of open keys and their lower median."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(k).to_numpy() for k in KEY]) for b in batches if b.num_rows]
        if not parts:
            return
        a = np.concatenate(parts, axis=1)
        if low is not None:
            a = a[:, ~_at_most(a, low, False) & ~_at_most(a, low, True)]
        if high is not None:
            a = a[:, _at_most(a, high, False)]
        under = _at_most(a, pivot, False) if pivot else np.zeros(a.shape[1], bool)
        equal = _at_most(a, pivot, True) if pivot else under
        row: list[int] = [int(equal.sum())]
        for side in (a[:, under], a[:, ~under & ~equal]):
            n = side.shape[1]
            middle = side[:, np.lexsort(side[::-1])[(n - 1) // 2]] if n else np.zeros(3, np.int64)
            row += [n, *middle.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names)

    names = ["equal", *(f"{side}_{c}" for side in ("under", "over") for c in ("n", *KEY))]
    return keys.mapInArrow(told, ", ".join(f"{n} long" for n in names)).collect()


def _weighted_median(found: list, side: str) -> Key | None:
    """The median of the partitions' medians, each weighted by the keys that it stands for."""
    rows = sorted((tuple(r[f"{side}_{k}"] for k in KEY), r[f"{side}_n"]) for r in found if r[f"{side}_n"])
    half, upto = sum(n for _, n in rows) / 2, 0
    for key, n in rows:
        upto += n
        if upto >= half:
            return key
    return None


def _literal(key: Key) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(k) for v, k in zip(key, KEY, strict=True)))


def _between(low: Key | None, high: Key | None) -> Column:
    above = F.lit(True) if low is None else F.struct(*KEY) > _literal(low)
    return above if high is None else above & (F.struct(*KEY) < _literal(high))


def cutoff(keys: DataFrame, n: int, finish: int = FINISH) -> Key | None:
    """The n-th smallest key of a written table of unique keys; None if ``n`` is 0."""
    if n <= 0:
        return None
    low = pivot = high = None
    table, size = keys, None
    while True:
        found = _medians(table, low, pivot, high)
        under, equal = sum(r["under_n"] for r in found), sum(r["equal"] for r in found)
        size = size or sum(r["over_n"] for r in found)
        if under < n <= under + equal:
            return pivot
        if n <= under:
            high, side, left = pivot, "under", under
        else:
            n, low, side, left = n - under - equal, pivot if pivot else low, "over", sum(r["over_n"] for r in found)
        pivot = _weighted_median(found, side)
        if left <= finish:
            return sorted(tuple(r) for r in table.where(_between(low, high)).collect())[n - 1]
        if left * SHRUNK <= size:
            table, size = staged(table.where(_between(low, high)), "open-keys"), left


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """``rank`` from 1 in the order of ``KEY``: ranges are sorted, and start at the number of rows before them."""
    numbered = rows.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id())
    numbered = staged(numbered.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place") - F.shiftleft("range", 33)), "winners")
    start, starts = 0, []
    for r in sorted(numbered.groupBy("range").count().collect()):  # one number a range
        starts.append((r["range"], start))
        start += r["count"]
    of = rows.sparkSession.createDataFrame(starts, "range long, before long")
    return numbered.join(of, "range").withColumn("rank", F.col("before") + F.col("place") + 1).drop("range", "before", "place")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, finish: int = FINISH) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: ``percent`` of those with ``least_words`` words are drawn."""
    rows = scored(docs, target, buckets, longest, seed).withColumns(
        {"key_score": -F.col("score"), "key_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "key_row": F.monotonically_increasing_id()}
    )
    rows = staged(rows, "scored")
    able = F.col("n_words") >= least_words
    n = rows.where(able).count() * percent // 100
    last = cutoff(rows.where(able).select(*KEY), n, finish)
    wins = able & (F.struct(*KEY) <= _literal(last)) if last else F.lit(False)
    columns = ["doc_id", "n_features", "weight", "score"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1_000_000))
    drawn = ranked(rows.where(wins), parts).select(*columns, "rank")
    return drawn.unionByName(rows.where(~wins).select(*columns, F.lit(None).cast("long").alias("rank")))
