"""SimHash near-dedup by an inverted index of fingerprint bytes with count filtering.

A fingerprint's 64 bits are the majority of the bits of all hashes of its text's shingles. Fingerprints that differ in at most
two bits share at least six of their eight bytes at the same places, and so at least two of the four pairs of neighbouring bytes
as a whole. A list of one byte would hold a 256th of all fingerprints; lists are therefore kept for four bytes at once, one for each
choice of two byte pairs, so each pair of fingerprints that can be linked meets in a list. There the shared
bytes of each two members are tallied, those with six or more are kept, and the bits of these are compared.

A list of more than ``LIST`` members is replaced by the lists of six bytes that include its four: such a list holds 65,536
different fingerprints at most, and the members at one or two bits from each are looked up in it rather than compared one by one.
Equal fingerprints are one entry from the start. A task hands on a spanning forest of the links that it found, never all pairs
of a group; links make components over all tasks.

Words are those between white space, ``A-Z`` lower-cased; shingles are runs of 3 words joined by one space, repeats count,
fewer words count as one shingle.

Defined results: without words, or with a null text, the fingerprint is zero, which is linked like any other; rows that
repeat a doc_id are told apart by their fingerprints; component_id is the smallest doc_id of a component (null only if all
are null); an empty table gives no rows; other columns, whatever their names, are ignored. A text is hashed whole by the task
that reads it, a million shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hamming_minhash import components, spread
from .packing import blocks
from .shared import staged

SEED = 42
#: Members up to which a list's pairs are tallied one by one, and members that one task takes, about.
LIST, PART_MEMBERS = 1024, 500_000
#: Bits in which linked fingerprints may differ, and bytes that they share at least.
BITS, SHARED = 2, 6


def _mask(byte_places: tuple[int, ...]) -> int:
    """The bits of some bytes, as a signed 64-bit number."""
    return int(np.uint64(sum(0xFF << (8 * b) for b in byte_places)).astype(np.int64))


FOUR = [_mask((2 * i, 2 * i + 1, 2 * j, 2 * j + 1)) for i, j in combinations(range(4), 2)]
SIX = [_mask(places) for places in combinations(range(8), SHARED)]


def fingerprint(text: bytes, n: int = 3) -> int:
    """The SimHash of a text, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    runs = max(1, len(words) - n + 1)
    starts, ends = (ends - size + 1)[:runs], ends[len(words) - runs :]
    counts = np.zeros(64, np.int64)
    for a in range(0, runs, 1 << 20):
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[a : a + (1 << 20)].tolist(), ends[a : a + (1 << 20)].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > runs, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fp = np.array([fingerprint((t or "").encode(), n) for t in block.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, fp long")


def _masks(masks: list[int]) -> Column:
    return F.array(*(F.lit(m).cast("long") for m in masks))


def _listed(rows: DataFrame) -> DataFrame:
    """fp, mask and list: the list of the bytes under the mask."""
    return rows.withColumn("list", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def index(nodes: DataFrame, limit: int = LIST) -> DataFrame:
    """list and fp: the lists of two members and more, those of four bytes or, above ``limit`` members, those of six."""
    postings = _listed(nodes.select("fp", F.explode(_masks(FOUR)).alias("mask")))
    sizes = staged(postings.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    members = staged(spread(postings, sizes, "list", "fp"), "members")
    within = F.filter(_masks(SIX), lambda m: m.bitwiseAND(F.col("mask")) == F.col("mask"))
    deep = members.where(F.col("n") > limit).select("fp", F.explode(within).alias("mask")).distinct()
    return members.where(F.col("n") <= limit).select("list", "fp").unionByName(_listed(deep).select("list", "fp"))


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share enough bytes, and of these, which differ in few bits."""
    differ = a ^ b
    shared = 8 - (differ.view(np.uint8).reshape(-1, 8) != 0).sum(1)
    kept = np.flatnonzero(shared >= SHARED)
    out = np.zeros(len(a), bool)
    out[kept] = np.bitwise_count(differ[kept]) <= BITS
    return out


def _looked_up(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked members of one sorted list, by looking up what lies at one or two of the bits in which members differ at all."""
    free = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [np.uint64(1) << np.uint64(i) for i in range(64) if int(free) >> i & 1]
    found = [np.zeros((2, 0), np.int64)]
    for flip in [*bits, *(x | y for x, y in combinations(bits, 2))]:
        other = fp ^ flip
        mine = np.flatnonzero(other > fp)
        at = np.minimum(np.searchsorted(fp, other[mine]), len(fp) - 1)
        hit = fp[at] == other[mine]
        found.append(np.stack([mine[hit], at[hit]]))
    a, b = np.concatenate(found, axis=1)
    good = _linked(fp[a], fp[b])
    return a[good], b[good]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of each of ``n`` numbers' component under the links ``a``-``b``."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def tallied(lists: np.ndarray, fp: np.ndarray, limit: int = LIST) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components which the members of the lists make."""
    order = np.lexsort((fp, lists))
    lists, fp = lists[order], fp[order]
    node, distinct = pd.factorize(fp)
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.zeros(0, np.int64)
    size = np.diff(np.r_[starts, len(lists)])
    root = np.arange(len(distinct))
    for s, n in zip(starts[size > limit].tolist(), size[size > limit].tolist(), strict=True):
        a, b = _looked_up(fp[s : s + n])
        root = forest(len(root), np.r_[np.arange(len(root)), node[s + a]], np.r_[root, node[s + b]])
    left = np.repeat(np.where(size <= limit, size, 0), size) - (np.arange(len(lists)) - np.repeat(starts, size))  # members from each place on
    at = np.arange(len(lists))
    for step in range(1, limit):
        at = at[left[at] > step]
        if not len(at):
            break
        new = at[root[node[at]] != root[node[at + step]]]
        new = new[_linked(fp[new], fp[new + step])]
        if len(new):
            root = forest(len(root), np.r_[np.arange(len(root)), node[new]], np.r_[root, node[new + step]])
    child = np.flatnonzero(root != np.arange(len(root)))
    return distinct[root[child]], distinct[child]


def links(nodes: DataFrame, limit: int = LIST) -> DataFrame:
    """a, b: links between different fingerprints, enough to span every component."""
    rows = staged(index(nodes, limit), "postings")
    parts = max(1, -(-rows.count() // PART_MEMBERS))

    def tally(table: pa.Table) -> pa.Table:
        a, b = tallied(table.column("list").to_numpy(), table.column("fp").to_numpy().view(np.uint64), limit)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return rows.withColumn("part", F.pmod("list", F.lit(parts))).groupBy("part").applyInArrow(tally, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, limit: int = LIST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    signed = staged(fingerprints(docs, n), "fingerprints")
    nodes = staged(signed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    labels = components(staged(links(nodes.select("fp"), limit).distinct(), "links"))
    named = staged(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = staged(spread(named.select("fp", "label"), smallest, "label", "fp").select("fp", "component_id"), "components")
    return spread(signed, named, "fp", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
