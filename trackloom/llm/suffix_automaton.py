"""Substring dedup by suffix automata of reference shards.

A reference shard is the text around repeated anchors that one part of the key space owns, of the earlier documents;
its suffix automaton grows in the order of doc_ids. Later texts are streamed through it for matching statistics, the length of the
longest match that ends at each word; where it reaches the window length, the window starts in an earlier document. All
reference text together grows with the corpus, so a shard is not broadcast whole: each shard is sent only
the pieces of documents that can match it (see ``repeats``), which finds the same windows.

Defined results: null and empty texts have no words; documents of fewer words than a window lose none; of equal
documents the one with the smallest doc_id keeps its words; rows that share a doc_id do not count against each
other; null is the smallest doc_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import HOT, cut_texts, first_of_each, without_repeats


class SuffixAutomaton:
    """All substrings of the sequences added so far; symbols are anything hashable."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A state of length one more than that of p for the shorter strings of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, symbols: list) -> None:
        last = 0
        for c in symbols:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            p, cur = last, self._state(self.length[last] + 1, 0, {})
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                self.link[cur] = self._split(p, c, self.next[p][c])
            last = cur

    def matching(self, symbols: list) -> list[int]:
        """For each place, the length of the longest substring ending there that the automaton holds."""
        state = length = 0
        out = []
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            out.append(length)
        return out


def match_words(length: int):
    """Marks the runs of ``length`` words that start in an earlier document of the shard."""

    def match(docs: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = cut_texts(data, sizes)
        kept, of, later = first_of_each(docs, texts)
        automaton, found, waiting = SuffixAutomaton(), [], []
        for i in kept:  # by doc_id
            if waiting and docs[waiting[0][0]] < docs[i]:
                for _, words in waiting:
                    automaton.add(words)
                waiting = []
            words = texts[i].split(b" ")
            found.append(np.array(automaton.matching(words)[length - 1 :]) >= length)
            waiting.append((i, words))
        marks = [np.ones_like(found[k]) if late else found[k] for k, late in zip(of.tolist(), later.tolist(), strict=True)]
        return np.concatenate(marks), np.array([len(x) for x in marks], np.int64)

    return match


def substring_dedup(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, starts and ends of the removed runs of words, kept (words joined by one space)."""
    found = without_repeats(docs, "words", match_words(length), length, hot)
    return found.select("doc_id", F.col("n_units").alias("n_words"), "starts", "ends", "kept")

