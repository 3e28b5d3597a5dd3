"""Histogram sort: exact counts below candidate key boundaries fix the splitters, then rows move once.

Every row has a hexadecimal key. A round counts bytes and rows in the cells that hold an unresolved
splitter, each cell cut by up to three more digits of the key, fewer where many splitters are open, so that the
driver gets at most ``PROBES`` counters a round however many rows there are and however uneven the keys.
Cells are pre-aggregated in each task.
DataFrame functions only.

Defined results: a null text has 8 bytes and CRC-32 0, like an empty one; a null ``doc_id`` sorts first;
rows equal in ``doc_id`` and text are one key and stay in one shard; an empty table gives no rows; other
columns, whatever their names, are ignored by ``text_keys``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Digits by which a cell is cut at most, and counters of a round (so that 4096 open splitters are cut by one digit).
DIGITS, PROBES = 3, 1 << 16


@dataclass
class Splitter:
    """Rows with ``key < bound`` lie below it; ``None`` is above every key."""

    bound: str | None
    size: int
    rows: int


@dataclass
class _Cell:
    prefix: str
    upper: str | None
    size_below: int
    rows_below: int
    size: int
    rows: int
    lo: str | None = None
    hi: str | None = None

    def low(self) -> Splitter:
        return Splitter(self.prefix, self.size_below, self.rows_below)

    def high(self) -> Splitter:
        return Splitter(self.upper, self.size_below + self.size, self.rows_below + self.rows)


def text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a key under which equal texts are neighbours, ordered by doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flipped = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.md5(text.cast("binary")), F.coalesce(F.lpad(F.lower(F.hex(flipped)), 16, "0"), F.lit(""))).alias("key"),
    )


def _inside(active: list[str], width: int) -> Column:
    return F.substring("key", 1, width).isin(active) if width else F.lit(True)


def find_splitters(keys: DataFrame, wanted: list[tuple[str, float, float]], size: int, rows: int) -> list[Splitter]:
    """Boundaries whose ``size`` or ``rows`` below come as near as ``tolerance`` allows to the wanted amounts.

    ``wanted`` holds (``"size"`` or ``"rows"``, amount, tolerance). With tolerance 0 a splitter ends at the nearest
    boundary between two different keys. The driver gets one counter for each probe, ``PROBES`` at most.
    """
    found: list[Splitter | None] = [None] * len(wanted)
    cells = {i: _Cell("", None, 0, 0, size, rows) for i in range(len(wanted))}
    width = 0
    while cells:
        active = sorted({c.prefix for c in cells.values()})
        digits = max([d for d in range(1, DIGITS + 1) if len(active) * 16**d <= PROBES], default=1)
        probes = (
            keys.where(_inside(active, width))
            .groupBy(F.substring("key", 1, width + digits).alias("cell"))
            .agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            .collect()
        )
        width += digits
        under: dict[str, list] = {}
        for p in sorted(probes, key=lambda r: r["cell"]):
            under.setdefault(p["cell"][: width - digits], []).append(p)
        cut: dict[str, list[_Cell]] = {}
        for parent in {c.prefix: c for c in cells.values()}.values():
            below, n, kids = parent.size_below, parent.rows_below, under.get(parent.prefix, [])
            for k, p in enumerate(kids):
                upper = kids[k + 1]["cell"] if k + 1 < len(kids) else parent.upper
                cut.setdefault(parent.prefix, []).append(_Cell(p["cell"], upper, below, n, p["size"], p["rows"], p["lo"], p["hi"]))
                below, n = below + p["size"], n + p["rows"]
        for i, parent in list(cells.items()):
            kind, amount, tolerance = wanted[i]
            at = lambda s, kind=kind: s.size if kind == "size" else s.rows
            cell = next((c for c in cut.get(parent.prefix, []) if at(c.high()) > amount), None)
            if cell is None:
                found[i] = parent.high()
            else:
                low, high = cell.low(), cell.high()
                nearest = low if amount - at(low) <= at(high) - amount else high
                if abs(at(nearest) - amount) <= tolerance or cell.lo == cell.hi:
                    found[i] = nearest
                else:
                    cells[i] = cell
                    continue
            del cells[i]
    return found


def bucket(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or below the key, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def histogram_shards(keys: DataFrame, n_shards: int = 24, tolerance: float = 0.0, piece_rows: int = 2_000_000) -> DataFrame:
    """Put rows (``key``, ``size``, others) into ``n_shards`` of nearly equal size in key order.

    ``tolerance`` is a share of a shard's ideal size. The rows are cut further into pieces of about
    ``piece_rows``, at least two a shard, so that numbering the slots of a shard is not one task's work:
    each piece starts at the exact count of rows below its boundary.
    """
    keys = staged(keys, "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("rows")).first()
    size, rows = total["size"], total["rows"]
    pieces = min(4096, max(2 * n_shards, -(-rows // piece_rows)))
    wanted = [("size", k * size / n_shards, tolerance * size / n_shards) for k in range(1, n_shards)]
    wanted += [("rows", k * rows / pieces, 0.25 * rows / pieces) for k in range(1, pieces)]
    splitters = find_splitters(keys, wanted, size, rows) if rows else []
    ends = [s for s in splitters[: n_shards - 1] if s.bound is not None]
    cuts = {s.bound: s for s in splitters if s.bound is not None}
    bounds = sorted(cuts)
    shard_of = [sum(s.bound <= b for s in ends) for b in ["", *bounds]]
    starts = [0, *(cuts[b].rows for b in bounds)]
    first: dict[int, int] = {}
    for shard, start in zip(shard_of, starts, strict=True):
        first.setdefault(shard, start)
    offsets = [start - first[shard] for shard, start in zip(shard_of, starts, strict=True)]
    in_piece = Window.partitionBy("piece").orderBy("key")
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("piece") + 1).cast(kind)
    return (
        keys.withColumn("piece", bucket(F.col("key"), bounds))
        .withColumn("in_piece", F.row_number().over(in_piece) - 1)
        .withColumn("shard", pick(shard_of, "int"))
        .withColumn("slot", pick(offsets, "long") + F.col("in_piece"))
        .drop("piece", "in_piece")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Documents in shards 0 to ``n_shards - 1`` of nearly equal bytes, equal texts side by side."""
    return histogram_shards(text_keys(docs), n_shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
