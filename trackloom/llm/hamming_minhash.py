"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has 80 symbols of 16 bits, each from the smallest value of one hash function over
its shingles. Signatures are cut into 20 chunks of 4 symbols. If two signatures differ in at most 39
symbols, then by the pigeonhole principle some chunk differs in at most one, so both share a key made of
that chunk with the differing symbol left out: every pair under the threshold meets. At a similarity of
0.75 a symbol differs with probability 1/4, and more than 39 of 80 do in about one pair of a million.

Texts with equal sets are one node from the start. Within a key each node is first compared with one hub,
then with the node nearest to the consensus of all signatures. Links make components, and only nodes that
share a key but still lie in different components are looked at further: first each with the nearest node of
another component, then pair by pair in blocks. There a pair is passed on by one of its keys only, and only
if an upper bound of what it has in common allows a link: the shingles of the two that occur in some other
such node at all, and, for two nodes near the same hub, the shingles of the hub that both hold (as bitmaps)
plus those outside it that occur elsewhere. So a large group of near copies makes rows in proportion to its
size. Every link is confirmed on the full sets.

Words are those between white space, ``A-Z`` lower-cased. Shingles are runs of 5 words, fewer words count as one
shingle; a shingle is a 64-bit hash of its words.

Defined results: without words, or with a null text, a document has no shingles and is a component alone;
rows that repeat a doc_id are told apart by their sets; component_id is the smallest doc_id of a component (null
only if all are null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import PLAIN, Rolling, Texts, blocks, mix
from .shared import staged

SYMBOLS, CHUNK = 80, 4
#: Symbols in which two signatures may differ: one less than twice the number of chunks.
THRESHOLD = 2 * (SYMBOLS // CHUNK) - 1
_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Keys that one task sorts at a time, nodes of one key compared at a time, and the most ids that are broadcast.
PART_KEYS, GROUP_BLOCK, BROADCAST_IDS = 2_000_000, 2048, 500_000
#: Rows of one key from which on a join may split them.
HOT = 20_000
#: Nodes of one key in a batch from which on only the smallest of them goes to the key's part.
LOCAL = 3


def shingle_sets(texts: Texts, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, ascending, as one array and the bounds of the documents in it."""
    words = texts.lowered().words(PLAIN)
    hashes = words.hashes()
    count = words.counts()
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), runs)
    first = np.repeat(words.of[:-1] - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(runs.sum())
    last = np.minimum(first + n, words.of[doc + 1])
    value = Rolling(hashes).runs(first, last)
    found = []
    for a in range(0, len(texts), 1 << 16):  # the document's number fits in the upper 16 bits
        lo, hi = np.searchsorted(doc, [a, a + (1 << 16)])
        x, d = value[lo:hi], doc[lo:hi]
        key = ((d - a).astype(np.uint64) << np.uint64(48)) | (x >> np.uint64(16))
        order = np.argsort(key)
        if len(key) and ((key[order][1:] == key[order][:-1]) & (x[order][1:] != x[order][:-1])).any():
            order = np.lexsort((x, d))  # two shingles that agree in 48 bits
        x, d = x[order], d[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (d[1:] != d[:-1])] if len(x) else np.zeros(0, bool)
        found.append((x[new], d[new]))
    value = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
    doc = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_hashes(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the set of each document that has shingles."""
    starts = at[:-1][np.diff(at) > 0]
    x = mix(value + np.uint64(1))
    return mix(np.add.reduceat(x, starts) ^ mix(np.add.reduceat(mix(x), starts)))


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbols of each document that has shingles."""
    starts = at[:-1][np.diff(at) > 0]
    x = mix(value + np.uint64(1))
    symbols = np.empty((len(starts), len(_FACTORS)), np.uint16)
    for i, factor in enumerate(_FACTORS):
        symbols[:, i] = mix(np.minimum.reduceat(x * factor, starts)) & np.uint64(0xFFFF)
    return symbols


def signed(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, row, n_shingles, node (hash of the set, null if it is empty), signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            value, at = shingle_sets(Texts.of(block.column("text")), n)
            size = np.diff(at)
            node, sig = np.zeros(len(size), np.int64), [None] * len(size)
            if len(value):
                have = np.flatnonzero(size > 0)
                node[have] = set_hashes(value, at).view(np.int64)
                for i, s in zip(have.tolist(), signatures(value, at), strict=True):
                    sig[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()), block.column("row"), pa.array(size.astype(np.int64)), pa.array(node, mask=size == 0), pa.array(sig, pa.binary())],
                ["doc_id", "row", "n_shingles", "node", "signature"],
            )

    return docs.select("doc_id", "row", "text").mapInArrow(sign, "doc_id long, row long, n_shingles long, node long, signature binary")


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """A key for each document and symbol: its chunk without that symbol."""
    n = len(symbols)
    s = symbols.astype(np.uint64).reshape(n, -1, CHUNK)
    keys = np.empty((n, s.shape[1], CHUNK), np.uint64)
    for out in range(CHUNK):
        rest = [j for j in range(CHUNK) if j != out]
        packed = (s[:, :, rest[0]] << np.uint64(32)) | (s[:, :, rest[1]] << np.uint64(16)) | s[:, :, rest[2]]
        salt = mix((np.arange(s.shape[1]) * CHUNK + out + 1).astype(np.uint64))
        keys[:, :, out] = mix(packed ^ salt[None, :])
    return keys.reshape(n, -1)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: which are the first of their kind, and how many there are of each one's kind."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(first), len(keys)])
    return first, np.repeat(size, size)


def _stars(nodes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of the first node of a key and another one of it."""
    hub, other = nodes[first][np.cumsum(first) - 1][~first], nodes[~first]
    order = np.lexsort((other, hub))
    hub, other = hub[order], other[order]
    new = np.r_[True, (hub[1:] != hub[:-1]) | (other[1:] != other[:-1])] if len(hub) else np.zeros(0, bool)
    return hub[new], other[new]


DEALT = "part int, keys binary, nodes binary, more binary, hubs binary, others binary"


def _dealt(nodes: DataFrame, parts: int) -> DataFrame:
    """Keys with their nodes, packed by part of the key space.

    Of a key that ``LOCAL`` nodes of a batch have, only the smallest node goes to the part, marked as one of
    ``more``; the batch itself pairs the others with it and passes them on under a part number of its own,
    from ``parts`` on. So a key that a third of all nodes have comes to its part once a batch.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy(zero_copy_only=False)
            keys = chunk_keys(_symbols(batch.column("signature")))
            owner = np.repeat(node, keys.shape[1])
            keys = keys.ravel()
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            first, size = _runs(keys)
            many = size >= LOCAL
            held = many & ~first
            if held.any():
                hubs, others = _stars(owner[many], first[many])
                own = parts + int(mix(owner[:1].view(np.uint64))[0] % np.uint64(parts))
                yield _packed([(own, keys[held], owner[held], np.zeros(0, bool), hubs, others)])
            keys, owner, many = keys[~held], owner[~held], many[~held]
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            none = np.zeros(0, np.int64)
            yield _packed([(p, keys[i], owner[i], many[i], none, none) for p in range(parts) if len(i := order[cut[p] : cut[p + 1]])])

    return nodes.select("node", "signature").mapInArrow(deal, DEALT)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in DEALT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(1, 6))], names)


def _groups(dealt: DataFrame, parts: int) -> DataFrame:
    """Keys of two nodes and more: hub (the smallest) and member pairs; and all members of keys of three and more."""

    def group(table: pa.Table) -> pa.Table:
        keys, nodes, more, hubs, others = (np.frombuffer(b"".join(table.column(k).to_pylist()), t) for k, t in (("keys", "u8"), ("nodes", "i8"), ("more", "?"), ("hubs", "i8"), ("others", "i8")))
        if table.column("part")[0].as_py() < parts:
            order = np.lexsort((nodes, keys))
            keys, nodes, more = keys[order], nodes[order], more[order]
            first, size = _runs(keys)
            hubs, others = _stars(nodes, first)
            of = np.cumsum(first) - 1
            large = (size > 2) | (np.bincount(of, more)[of] > 0)
            keys, nodes = keys[large], nodes[large]
        return pa.table(
            {
                "key": pa.chunked_array([pa.nulls(len(hubs), pa.int64()), pa.array(keys.view(np.int64))]),
                "hub": pa.chunked_array([pa.array(hubs), pa.nulls(len(keys), pa.int64())]),
                "node": pa.chunked_array([pa.array(others), pa.array(nodes)]),
            }
        )

    return dealt.groupBy("part").applyInArrow(group, "key long, hub long, node long")


def spread(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each ``key``; rows of a hot key are split by ``by``.

    Hot is a key with more than ``HOT`` rows and a ten-thousandth of all, so at most 10,000 keys are hot and their
    list is broadcast. A hot key's row of ``side`` is sent once for each such share of its rows.
    """
    share = F.greatest(F.lit(HOT), F.col("all") / 10_000)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > HOT).crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).where(F.col("n") > share)
    hot = staged(hot.select(key, F.ceil(F.col("n") / share).cast("int").alias("split")), "hot")
    if hot.isEmpty():
        return rows.join(side, key, how)
    hot = F.broadcast(hot)
    split = F.coalesce("split", F.lit(1))
    many = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), split).cast("int")).drop("split")
    copies = side.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), split - 1))).drop("split")
    return many.join(copies, [key, "salt"], how).drop("salt")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose signatures are under the threshold and whose set sizes allow a link."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("signature").alias(f"sig_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    pairs = spread(staged(pairs.distinct(), "pairs"), side("a"), "a", "b").join(side("b"), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= THRESHOLD))

    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.where(fits).select("a", "b", "sig_a", "sig_b").mapInArrow(close, "a long, b long")


def _node_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node and its whole set (8 bytes a shingle, ascending) for the wanted nodes."""
    ids = nodes.join(wanted, "node").select("doc_id")
    ids = staged(ids.distinct(), "wanted")
    by = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = docs.select("doc_id", "text").join(by, docs["doc_id"].eqNullSafe(by["doc_id"]), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            value, at = shingle_sets(Texts.of(block.column("text")), n)
            if not len(value):
                continue
            node = set_hashes(value, at)
            packed = value.tobytes()
            have = np.flatnonzero(np.diff(at) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array([packed[8 * at[i] : 8 * at[i + 1]] for i in have], pa.binary())], ["node", "members"])

    return some.mapInArrow(sets, "node long, members binary").dropDuplicates(["node"])


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    return staged(_node_sets(docs, nodes, pairs.select("a").union(pairs.select("b")).toDF("node").distinct(), n), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("members").alias(f"set_{k}"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return staged(spread(pairs, side("a"), "a", "b").join(side("b"), "b").mapInArrow(confirm, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, for all nodes of the links.

    Labels fall to the smallest among the neighbours and then jump to their label's label, until none changes.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = staged(nearer.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("was")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _unsettled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label, n (nodes of the key) for the keys whose nodes lie in different components."""
    members = groups.where(F.col("key").isNotNull()).select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    return spread(staged(members, "members"), mixed, "key", "node")


def _symbols(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _blocked(unsettled: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = unsettled.join(nodes.select("node", "signature"), "node")
    return rows.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP_BLOCK).cast("int")))


def _with_consensus(unsettled: DataFrame, nodes: DataFrame) -> DataFrame:
    """hub and node: the node of each key, or of a block of a large key, that agrees most with all signatures, and each other one."""

    def star(table: pa.Table) -> pa.Table:
        node, sig = table.column("node").to_numpy(), _symbols(table.column("signature"))
        ranked = np.sort(sig, 0)
        new = np.r_[np.ones((1, sig.shape[1]), bool), ranked[1:] != ranked[:-1]]
        mode = np.empty(sig.shape[1], np.uint16)
        for c in range(sig.shape[1]):
            starts = np.flatnonzero(new[:, c])
            mode[c] = ranked[starts[np.diff(np.r_[starts, len(node)]).argmax()], c]
        hub = np.lexsort((node, -(sig == mode).sum(1)))[0]
        far = np.flatnonzero(((sig != sig[hub]).sum(1) <= THRESHOLD) & (node != node[hub]))
        return pa.table({"hub": pa.array(np.full(len(far), node[hub]), pa.int64()), "node": pa.array(node[far], pa.int64())})

    return _blocked(unsettled, nodes).groupBy("key", "block").applyInArrow(star, "hub long, node long")


def _with_nearest(unsettled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of each node and the nearest one by signature, of its key, that lies in another component."""

    def nearest(table: pa.Table) -> pa.Table:
        node, label, sig = table.column("node").to_numpy(), table.column("label").to_numpy(), _symbols(table.column("signature"))
        best, at = np.full(len(node), THRESHOLD + 1), np.zeros(len(node), np.int64)
        for x in range(len(node)):
            differ = np.where(label != label[x], (sig != sig[x]).sum(1), THRESHOLD + 1)
            at[x] = differ.argmin()
            best[x] = differ[at[x]]
        near = best <= THRESHOLD
        return _pairs(node[near], node[at[near]])

    return _blocked(unsettled, nodes).groupBy("key", "block").applyInArrow(nearest, "a long, b long")


def _near_hubs(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """node, home (the hub that it was compared with most often), which of the hub's shingles it holds, and its others."""
    told = stars.groupBy("node", "hub").count().union(stars.groupBy(F.col("hub").alias("node"), "hub").count())
    homes = told.groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("home"))
    hubs = sets.select(F.col("node").alias("home"), F.col("members").alias("hub_members"))
    rows = spread(staged(homes, "homes"), hubs, "home", "node").join(sets, "node")

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, others = [], []
            for mine, hub in zip(batch.column("members"), batch.column("hub_members"), strict=True):
                mine, hub = _unpacked(mine.as_py()), _unpacked(hub.as_py())
                held.append(np.packbits(np.isin(hub, mine, assume_unique=True)).tobytes())
                other = mine[~np.isin(mine, hub, assume_unique=True)]
                others.append(other.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("home"), pa.array(held, pa.binary()), pa.array(others, pa.binary())], ["node", "home", "held", "members"])

    return rows.mapInArrow(relate, "node long, home long, held binary, members binary")


def _shared_counts(sets: DataFrame, parts: int) -> DataFrame:
    """node and n_shared: how many of its shingles occur in another of these nodes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members = [_unpacked(x) for x in batch.column("members").to_pylist()]
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), [len(x) for x in members])
            value = np.concatenate(members)
            part = (mix(value) % np.uint64(parts)).astype(np.int64)
            rows = [(p, value[part == p].tobytes(), node[part == p].tobytes()) for p in np.unique(part).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["part", "shingles", "nodes"])

    def count(table: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64)
        node = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
        order = np.argsort(value, kind="stable")
        value, node = value[order], node[order]
        twin = np.zeros(len(value), bool)
        same = value[1:] == value[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        of, n = np.unique(node[twin], return_counts=True)
        return pa.table({"node": pa.array(of, pa.int64()), "n": pa.array(n, pa.int64())})

    dealt = sets.select("node", "members").mapInArrow(deal, "part int, shingles binary, nodes binary")
    return dealt.groupBy("part").applyInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_shared"))


def _across(unsettled: DataFrame, nodes: DataFrame, shared: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that may be linked; each is passed on by one of its keys."""
    cut = F.ceil(F.col("n") / GROUP_BLOCK).cast("int")
    rows = unsettled.join(nodes.select("node", "signature", "n_shingles"), "node").join(shared, "node").join(homes, "node", "left")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), cut).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "label", "signature", "n_shingles", "n_shared", "home", "held", "n_other")

    def compare(table: pa.Table) -> pa.Table:
        i, j, key = (table.column(k)[0].as_py() for k in ("i", "j", "key"))
        mine, node, label, size, shared = (table.column(k).to_numpy() for k in ("mine", "node", "label", "n_shingles", "n_shared"))
        home = np.where(table.column("home").is_valid().to_numpy(), table.column("home").fill_null(0).to_numpy(), node)
        other = table.column("n_other").fill_null(0).to_numpy()
        held_bytes = [x or b"" for x in table.column("held").to_pylist()]
        wide = max(1, *map(len, held_bytes))
        held = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in held_bytes), np.uint8).reshape(len(node), wide)
        sig = _symbols(table.column("signature"))
        slot = int((chunk_keys(sig[:1])[0] == np.int64(key).astype(np.uint64)).argmax())
        chunk, out = divmod(slot, CHUNK)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in left:
            fits = (label[right] != label[x]) & ((100 + percent) * np.minimum(shared[right], shared[x]) >= percent * (size[right] + size[x]))
            fits &= 100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x])
            near = right[fits & (right > x if i == j else True)]
            common = np.bitwise_count(held[near] & held[x]).sum(1, dtype=np.int64) + np.minimum(other[near], other[x])
            near = near[(home[near] != home[x]) | ((100 + percent) * common >= percent * (size[near] + size[x]))]
            if not len(near):
                continue
            differ = sig[near] != sig[x]
            wrong = differ.reshape(len(near), -1, CHUNK).sum(2)
            first = (wrong <= 1).argmax(1)
            place = np.where(wrong[np.arange(len(near)), first] == 1, differ.reshape(len(near), -1, CHUNK)[np.arange(len(near)), first].argmax(1), 0)
            near = near[(differ.sum(1) <= THRESHOLD) & (first == chunk) & (place == out)]
            found_a.append(np.full(len(near), node[x]))
            found_b.append(node[near])
        return _pairs(np.concatenate(found_a), np.concatenate(found_b))

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; documents are linked at ``percent`` of shingles in common."""
    return judged(docs.withColumn("row", F.lit(None).cast("long")), n, percent).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, ``row`` (a long that the caller gives each row), n_shingles, label (of the component, null without words), component_id, kept."""
    signed_docs = staged(signed(docs, n), "signed")
    nodes = staged(
        signed_docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "nodes",
    )
    parts = max(1, -(-nodes.count() * SYMBOLS // PART_KEYS))
    groups = staged(_groups(_dealt(nodes, parts), parts), "groups")
    stars = groups.where(F.col("key").isNull()).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = staged(_near(stars, nodes, percent), "near-pairs")
    links = _confirmed(pairs, _sets_of(docs, nodes, pairs, n), percent)
    labels = components(links)
    open_keys = staged(_unsettled(groups, labels), "unsettled")
    if not open_keys.isEmpty():
        sets = staged(_node_sets(docs, nodes, open_keys.select("node").distinct(), n), "sets")
        stars = staged(_with_consensus(open_keys, nodes), "stars")
        settled = labels.withColumnRenamed("label", "l")
        side = lambda k: settled.select(F.col("node").alias(k), F.col("l").alias(f"label_{k}"))
        far = stars.distinct().join(side("hub"), "hub", "left").join(side("node"), "node", "left")
        far = far.where(F.coalesce("label_hub", "hub") != F.coalesce("label_node", "node"))
        pairs = staged(far.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "near-pairs")
        links = links.unionByName(_confirmed(pairs, sets, percent))
        labels = components(links)
        homes = staged(_near_hubs(stars, sets), "homes")
        parts = max(1, -(-nodes.count() * SYMBOLS // PART_KEYS))
        shared = staged(_shared_counts(sets, parts), "shared")
        others = homes.select("node", "home", "held").join(_shared_counts(homes.select("node", "members"), parts).withColumnRenamed("n_shared", "n_other"), "node", "left")
        homes = staged(others, "homes")
        open_keys = staged(_unsettled(groups, labels), "unsettled")
        pairs = staged(_with_nearest(open_keys, nodes).distinct(), "near-pairs")
        links = links.unionByName(_confirmed(pairs, sets, percent))
        labels = components(links)
        open_keys = staged(_unsettled(groups, labels), "unsettled")
        pairs = staged(_across(open_keys, nodes, shared, homes, percent).distinct(), "near-pairs")
        labels = components(links.unionByName(_confirmed(pairs, sets, percent)))
    named = staged(nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = staged(spread(named.select("node", "label"), smallest, "label", "node").select("node", "label", "component_id"), "components")
    found = signed_docs.select("doc_id", "row", "n_shingles", "node")
    alone = found.where("node is null").withColumns({"label": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    found = spread(found.where("node is not null"), named, "node", "doc_id").unionByName(alone)
    return found.select("doc_id", "row", "n_shingles", "label", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
