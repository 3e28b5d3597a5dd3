"""Whole texts as flat byte buffers: words and rolling hashes of many documents at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; one longer document is handled alone.
BLOCK = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[np.uint64, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that are separated by white space.
PLAIN = ~SPACES
#: Bytes of words of digits, letters and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n, modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK + 2)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the number of each value among them; by hashing, as most values repeat."""
    number, distinct = pd.factorize(values)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[number]


class Rolling:
    """Hashes of any runs of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        self.sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(values))[: len(values)], out=self.sum[1:])
        self.down = powers(_INVERSE, len(values))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start])

    def all(self, k: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """Of the k values from each place that has as many, or from each of the places a to before b."""
        n = len(self.sum) - k
        n = n if b is None else min(n, b)
        return mix((self.sum[a + k : n + k] - self.sum[a:n]) * self.down[a:n]) if n > a else np.zeros(0, np.uint64)


class Texts:
    """Documents laid end to end: ``data`` holds their bytes, document i is ``data[at[i]:at[i + 1]]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Of an Arrow column of strings; null counts as empty."""
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        return cls(data, at - at[0])

    def __len__(self) -> int:
        return len(self.at) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.at)

    def byte_values(self) -> np.ndarray:
        return _BYTE[self.data]

    def words(self, kind: np.ndarray) -> Words:
        return Words(self, kind)


class Words:
    """Word j is ``data[start[j]:end[j]]``; document i has the words ``of[i]`` to ``of[i + 1]``."""

    def __init__(self, texts: Texts, kind: np.ndarray):
        inside = kind[texts.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = texts.at[1:-1]
        cut = cut[(cut > 0) & (cut < len(inside))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.texts, self.start = texts, np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, texts.at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Rolling(self.texts.byte_values()).runs(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts())


def column(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or a field of a struct column as ``column.field``."""
    name, *fields = path.split(".")
    return pc.struct_field(batch.column(name), fields) if fields else batch.column(name)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``size`` bytes of text."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + size, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
