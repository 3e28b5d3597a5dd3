"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` cuts the corpus into shards of whole documents and stores, for each shard, the sorted word
positions of every term. ``search`` looks phrases up in every shard: it takes the lists of a phrase's terms
from the rarest on, shifts each by the term's offset and intersects them. A phrase lies in one document,
so a shard answers alone: no postings move between machines, and a common passage is found once per document
that has it. Phrases are read in blocks of bounded size; each block goes over all shards.

Words: ``A-Z`` lower-cased, then runs of digits, letters and non-ASCII characters. Terms are 64-bit hashes
of words. A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: a document without text or words has 0 words and no hits and is not contaminated; an
empty benchmark hits nothing; rows that repeat a doc_id are judged one by one; items that share an item_id
count once; items without an id or text are not searched for; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .packing import ALNUM, Texts, blocks
from .shared import staged

INDEX = "shard long, doc_ids binary, n_words binary, terms binary, lengths binary, gaps binary"
#: Bytes of item texts that are looked for at a time, and so the most that is sent to every task.
ITEM_BLOCK = 8 << 20


def _ids(column: pa.Array) -> np.ndarray:
    """doc_ids as int64; null becomes the smallest value."""
    return column.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64)


def build_index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """A row for each shard: its number, its documents, its terms and the gaps between the positions of each term.

    Position of a word: its number in the shard plus the number of documents before its own, so that no
    phrase crosses documents. ``terms``, sorted term hashes, restricts the index to words that queries
    can ask for; otherwise every word is indexed.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, block in enumerate(blocks(batches)):
            words = Texts.of(block.column("text")).lowered().words(ALNUM)
            term = words.hashes()
            position = (np.arange(len(words)) + words.doc()).astype(np.int32)
            if terms is not None and len(terms):
                known = terms[np.minimum(np.searchsorted(terms, term), len(terms) - 1)] == term
                term, position = term[known], position[known]
            elif terms is not None:
                term, position = term[:0], position[:0]
            order = np.argsort(term, kind="stable")
            term, position = term[order], position[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            gaps = np.diff(position, prepend=np.int32(0))
            gaps[starts] = position[starts]
            row = [_ids(block.column("doc_id")), words.counts().astype(np.int64), term[starts], np.diff(np.r_[starts, len(term)]).astype(np.int32), gaps.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([task + number]), *(pa.array([x.tobytes()]) for x in row)], ["shard", "doc_ids", "n_words", "terms", "lengths", "gaps"])

    return docs.select("doc_id", "text").mapInArrow(shards, INDEX)


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict[str, bytes]):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.first = np.r_[0, np.cumsum(self.n_words + 1)]
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.at = np.r_[0, np.cumsum(self.lengths)].astype(np.int64)
        gaps = np.frombuffer(row["gaps"], np.int32)
        total = np.r_[0, np.cumsum(gaps, dtype=np.int64)]
        self.positions = total[1:] - np.repeat(total[self.at[:-1]], self.lengths)

    def rank(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in the shard, -1 where it has none."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, rank: int) -> np.ndarray:
        return self.positions[self.at[rank] : self.at[rank + 1]]

    def phrase(self, ranks: np.ndarray) -> np.ndarray:
        """Where the words of these ranks stand one after another."""
        found = None
        for offset in np.argsort(self.lengths[ranks], kind="stable"):
            shifted = self.postings(ranks[offset]) - offset
            if found is None:
                found = shifted
            else:
                at = np.searchsorted(shifted, found)
                at[at == len(shifted)] = 0
                found = found[shifted[at] == found]
            if not len(found):
                break
        return found

    def near(self, ranks: np.ndarray, width: int) -> np.ndarray:
        """First words of the runs of ``width`` words, from a word of the phrase on, that hold all its words in any order."""
        ranks = np.unique(ranks)
        ranks = ranks[np.argsort(self.lengths[ranks], kind="stable")]
        rare = self.postings(ranks[0])
        at = [self.postings(r) for r in ranks]
        starts = []
        for p in rare:
            here = np.unique(np.concatenate([x[np.searchsorted(x, p - width + 1) : np.searchsorted(x, p, "right")] for x in at]))
            for s in here:
                doc = np.searchsorted(self.first, s, "right") - 1
                end = min(s + width, self.first[doc + 1] - 1)
                if all((i := np.searchsorted(x, s)) < len(x) and x[i] < end for x in at):
                    starts.append(s)
        return np.unique(np.array(starts, np.int64))


def windows(items: list[tuple[str, str]], n: int) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
    """Item ids, the term hashes of all items, and for each distinct window (item number, first term, length)."""
    words = Texts.of(pa.array([t for _, t in items], pa.string())).lowered().words(ALNUM)
    spans = []
    for i in range(len(items)):
        a, b = words.of[i], words.of[i + 1]
        spans += [(i, s, n) for s in range(a, b - n + 1)] if b - a >= n else [(i, a, b - a)] if b > a else []
    return [k for k, _ in items], words.hashes() if len(words) else np.zeros(0, np.uint64), spans


def _covered(shard: Shard, spans: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """First positions and ends of the merged runs of hit words."""
    edge = np.zeros(shard.first[-1] + 1, np.int32)
    for starts, length in spans:
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + length, -1)
    hit = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
    return np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)


def search(index: DataFrame, items: list[tuple[str, str]], n: int = 13, slop: int | None = None) -> DataFrame:
    """A row for each document: ``shard`` and ``place`` in it, ``doc_id, n_words, items`` (ids found) and the hit words as ``starts`` and ``ends``.

    Exact windows of ``n`` words; with ``slop``, also windows all of whose words stand within ``n + slop`` words.
    """
    names, terms, spans = windows(items, n)
    lengths = np.array([s[2] for s in spans], np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                rank = shard.rank(terms)
                missing = np.r_[0, np.cumsum(rank < 0)]
                hits, pairs = [], set()
                for k, (item, a, length) in enumerate(spans):
                    if missing[a + length] > missing[a]:
                        continue
                    starts, width = (shard.phrase(rank[a : a + length]), lengths[k]) if slop is None else (shard.near(rank[a : a + length], length + slop), length + slop)
                    if len(starts):
                        doc = np.searchsorted(shard.first, starts, "right") - 1
                        hits.append((starts, width) if slop is None else (starts, 1))
                        pairs.update(zip(doc.tolist(), [names[item]] * len(doc), strict=True))
                starts, ends = _covered(shard, hits)
                doc = np.searchsorted(shard.first, starts, "right") - 1
                cut = np.searchsorted(doc, np.arange(len(shard.doc_ids) + 1))
                by_doc: dict[int, set] = {}
                for d, name in pairs:
                    by_doc.setdefault(d, set()).add(name)
                base = shard.first[doc]
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x - base, pa.int64()))  # noqa: E731, B023
                ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == -(2**63))
                found = pa.array([sorted(by_doc.get(d, ())) for d in range(len(shard.doc_ids))], pa.list_(pa.string()))
                own = [pa.array(np.full(len(ids), row["shard"], np.int64)), pa.array(np.arange(len(ids), dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([*own, ids, pa.array(shard.n_words), found, lists(starts), lists(ends)], ["shard", "place", "doc_id", "n_words", "items", "starts", "ends"])

    return index.mapInArrow(find, "shard long, place long, doc_id long, n_words long, items array<string>, starts array<long>, ends array<long>")


@F.pandas_udf(LongType())
def _union_length(starts: pd.Series, ends: pd.Series) -> pd.Series:
    def one(s, e):
        order = np.argsort(s, kind="stable")
        s, e = np.asarray(s)[order], np.maximum.accumulate(np.asarray(e)[order]) if len(e) else np.asarray(e)
        return int((e - np.maximum(s, np.r_[0, e[:-1]])).clip(0).sum()) if len(s) else 0

    return pd.Series([one(s, e) for s, e in zip(starts, ends, strict=True)])


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK) -> list[DataFrame]:
    """The items in parts of about ``size`` bytes of text."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // size))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [items]


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated: whether at least one word in ``share`` lies in a window of an item."""
    parts = item_blocks(benchmark)
    one = [(r["item_id"], r["text"]) for r in parts[0].collect()] if len(parts) == 1 else None
    terms = np.unique(windows(one, n)[1]) if one is not None else None
    index = build_index(docs, terms)
    if one is not None:
        found = search(staged(index, "postings"), one, n, slop)
    else:
        index = staged(index, "postings")
        found = None
        for part in parts:  # a block of items at a time, each over all shards
            rows = search(index, [(r["item_id"], r["text"]) for r in part.collect()], n, slop)
            rows = staged(rows.where(F.size("items") > 0), "matches")
            found = rows if found is None else found.unionByName(rows)
        every = search(index, [], n)
        merged = found.groupBy("shard", "place").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "starts", "ends")))
        found = every.select("shard", "place", "doc_id", "n_words").join(merged, ["shard", "place"], "left")
        found = found.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("items", "array<string>"), ("starts", "array<long>"), ("ends", "array<long>"))})
        found = found.withColumn("items", F.array_sort(F.array_distinct("items")))
    n_hit = F.when(F.size("starts") > 0, _union_length("starts", "ends")).otherwise(F.lit(0))
    n_hit = n_hit if one is None else F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.withColumn("n_hit", n_hit.cast("long"))
    return found.select("doc_id", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
