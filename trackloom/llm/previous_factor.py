"""Suffix-array dedup by longest-previous-factor arrays.

The bytes around repeated anchors meet in parts (see ``repeats``). A part sorts their suffixes, but for those whose bytes up to the
threshold have a hash of their own, and finds for each the previous and the next one in suffix order that belongs to
an earlier document; the longer of the two common prefixes is its longest previous factor. Where that reaches the threshold, the string
starts in an earlier document and this copy goes; the first stays. Suffixes are compared up to the threshold, which is all
that is asked of them.

Defined results: null and empty texts have no bytes; shorter texts than the threshold lose none; of equal texts the
one with the smallest doc_id stays whole; rows that share a doc_id do not count against each other; null is the
smallest doc_id; what is kept may not be valid UTF-8 and is binary; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Rolling, Texts
from .repeats import HOT, spans, without_repeats


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes, and for each in that order the length of the prefix common with the one before (``length`` at most)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    words = []
    for k in range(0, length, 8):
        word = eight[np.minimum(starts + k, len(eight) - 1)]
        words.append(word if length - k >= 8 else word >> np.uint64(8 * (8 - (length - k))) << np.uint64(8 * (8 - (length - k))))
    order = np.lexsort(words[::-1])
    common = np.zeros(len(order), np.int64)
    open_ = np.arange(len(order)) > 0
    for k, word in zip(range(0, length, 8), words, strict=True):
        word = word[order]
        differ = np.zeros(len(order), np.uint64)
        differ[1:] = word[1:] ^ word[:-1]
        same = differ == 0
        lead = np.where(same, 8, 7 - (np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64) // 8))
        common[open_] = np.minimum(k + lead, length)[open_]
        open_ &= same
    return order, common


def _nearest_earlier(owner: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place, the prefix common with the nearest earlier place of a smaller owner, 0 where it is under ``least``.

    Pointers jump over places whose own pointer already skips them, all at once.
    """
    before, shared = np.arange(len(owner)) - 1, common.copy()
    active = np.flatnonzero((shared >= least) & (before >= 0))
    while len(active):
        active = active[owner[before[active]] >= owner[active]]
        at = before[active]
        reach = np.minimum(shared[active], np.where(at > 0, shared[at], 0))
        jump = before[at]
        before[active], shared[active] = jump, reach
        active = active[(reach >= least) & (jump >= 0)]
    return np.where(shared >= least, shared, 0)


def longest_previous(owner: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of each suffix in suffix order, where it is ``least`` or more; owners are documents."""
    after = np.r_[common[1:], 0][::-1]
    return np.maximum(_nearest_earlier(owner, common, least), _nearest_earlier(owner[::-1], after, least)[::-1])


def _hashed_alike(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Suffixes whose first ``length`` bytes have a hash that others have too: all that can share so many with another one."""
    rolling = Rolling(Texts(data, np.array([0, len(data)])).byte_values())
    number, _ = pd.factorize(rolling.runs(start, start + length))
    return np.flatnonzero((np.bincount(number) > 1)[number])


def match_bytes(length: int):
    """Marks the strings of ``length`` bytes that start in an earlier document of the part."""

    def match(docs: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs, by_id = sizes - length + 1, np.argsort(docs, kind="stable")
        start = spans((np.cumsum(sizes) - sizes)[by_id], runs[by_id])
        place = spans((np.cumsum(runs) - runs)[by_id], runs[by_id])
        some = _hashed_alike(data, start, length)
        order, common = sorted_suffixes(data, start[some], length)
        owner = np.repeat(docs[by_id], runs[by_id])[some][order]
        mark = np.zeros(len(start), bool)
        mark[place[some][order]] = longest_previous(owner, common, length) >= length
        return mark, runs

    return match


def suffix_array_dedup(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed runs of bytes, kept."""
    found = without_repeats(docs, "bytes", match_bytes(length), length, hot)
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "starts", "ends", "kept")
