"""Runs of ``length`` units (bytes or words) that also start in an earlier document: what both substring dedups share.

Every run holds an anchor: the smallest of the hashes of its grams (of 20 bytes or 16 words). Equal runs have equal anchors.
Neighbouring runs of an anchor stand together in surroundings of at most 84 units. A batch sends of each of its distinct
surroundings the anchor, a hash and the smallest doc_id. Where an earlier document holds equal surroundings, all their runs go;
the others are shown to nobody if all documents have the same ones around this anchor. Only different surroundings of one anchor, each once
in the corpus and with its smallest doc_id, go to the part of the key space that owns the anchor. There a matcher compares units, not hashes,
and answers which runs start in an earlier document; a document then takes away all that its answered runs cover.
What a batch found out about its anchors comes back to it with the answers. All passes are linear in the corpus.

A phrase that very many documents hold with different neighbours would give its one anchor a part's work without bound. The
runs around an anchor with more than ``hot`` surroundings are therefore dealt apart, by the place of the anchor in them: in
``PIECES`` pieces, each owned by the units that all its runs share, and with ``FAR`` times as many surroundings run by run,
each owned by its own units. Equal runs still meet, as they hold the anchor at the same place and share these units.

Order of documents: doc_id, null first; rows that share a doc_id do not count against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import batched, binaries, flat, narrow, parts_of, passed, widen
from .packing import PLAIN, Rolling, Texts, mix
from .shared import staged

GRAM = {"bytes": 20, "words": 16}
KEY_BYTES = 6
_MASK = np.uint64((1 << 8 * KEY_BYTES) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Distinct surroundings of batches that one part numbers, and bytes of them that one part compares, about.
PART, PART_BYTES = 1_500_000, 3 << 20
#: Bytes of a unit, with what separates it, and units for each anchor, about.
UNIT_BYTES, ANCHOR_UNITS = {"bytes": 1, "words": 7}, 15
#: Surroundings of an anchor above which they are split, pieces of the first split, and the factor of the second.
HOT, PIECES, FAR = 8192, 4, 16
#: Places whose grams are compared at a time, so that they stay in a processor's cache.
NEAR = 1 << 15
#: (doc ids, surroundings end to end, bytes of each) of a part to (marks for the runs of all, end to end; runs of each).
Matcher = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: What a part says of surroundings: nothing to do; an earlier document has them; to be shown as they are, in pieces, run by run.
ALONE, LATER, WHOLE, SPLIT, APART = range(5)


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each span, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


@dataclass
class Units:
    """Units of the documents of a batch: those of document i are ``of[i]`` to ``of[i + 1]``."""

    doc_ids: np.ndarray
    kind: str
    texts: Texts

    @classmethod
    def read(cls, table: pa.Table, kind: str) -> Units:
        column = table.column("text").combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ids = table.column("doc_id").fill_null(-(2**63)).to_numpy().astype(np.int64)
        return cls(ids, kind, Texts.of(column))

    @cached_property
    def _words(self):
        return self.texts.words(PLAIN)

    @cached_property
    def of(self) -> np.ndarray:
        return self.texts.at if self.kind == "bytes" else self._words.of

    @cached_property
    def rolling(self) -> Rolling:
        return Rolling(self.texts.byte_values() if self.kind == "bytes" else self._words.hashes())

    @cached_property
    def _spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space after each, and where they start."""
        words = self._words
        n = words.end - words.start
        start = np.cumsum(n + 1) - n - 1
        data = np.full(int((n + 1).sum()), 0x20, np.uint8)
        data[spans(start, n)] = self.texts.data[spans(words.start, n)]
        return data, np.r_[start, len(data)]

    def slices(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the units from each a to before b, end to end, and how many each has."""
        if self.kind == "bytes":
            return self.texts.data[spans(a, b - a)], b - a
        data, start = self._spaced
        sizes = start[b] - start[a] - 1
        return data[spans(start[a], sizes)], sizes

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """What is left of each document without these units."""
        stay = ~gone
        if self.kind == "bytes":
            left = self.texts.data[stay].tobytes()
            at = np.r_[0, np.cumsum(stay)][self.of]
            return [left[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        data, start = self._spaced
        n = np.diff(start)
        left = data[np.repeat(stay, n)].tobytes()
        at = np.r_[0, np.cumsum(n[stay])][np.r_[0, np.cumsum(stay)][self.of]]
        return [left[x : max(x, y - 1)] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@dataclass
class Anchors:
    """Occurrences of anchors: document, the first and last start of the runs that they stand for, and the anchor's place."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray

    @classmethod
    def standing(cls, of: np.ndarray, first: np.ndarray, at: np.ndarray, length: int) -> Anchors:
        """Anchors stand for all runs up to the next one or the end of the document."""
        doc = np.searchsorted(of, first, "right") - 1
        last = of[doc + 1] - length
        same = np.flatnonzero(doc[1:] == doc[:-1])
        last[same] = first[same + 1] - 1
        return cls(doc, first, last, at)

    def taken(self, where: np.ndarray) -> Anchors:
        return Anchors(*(getattr(self, k)[where] for k in ("doc", "first", "last", "at")))

    def split(self, pieces: int, length: int, gram: int, rolling: Rolling) -> tuple[Anchors, np.ndarray, np.ndarray]:
        """The same runs in up to ``pieces`` pieces by the anchor's place in them; keys, by the units common to a piece; of which occurrence each is."""
        places = length - gram + 1
        cut = np.arange(pieces + 1) * places // pieces
        low, high = np.tile(cut[:-1], len(self.at)), np.tile(cut[1:] - 1, len(self.at))  # places of the anchor in the runs of a piece
        of = np.repeat(np.arange(len(self.at)), pieces)
        at = self.at[of]
        first, last = np.maximum(self.first[of], at - high), np.minimum(self.last[of], at - low)
        some = np.flatnonzero(first <= last)
        low, high, of, at, first, last = (x[some] for x in (low, high, of, at, first, last))
        key = mix(rolling.runs(at - low, at - high + length) + low.astype(np.uint64))
        return Anchors(self.doc[of], first, last, at), key & _MASK, of


def anchors(units: Units, length: int) -> tuple[Anchors, np.ndarray]:
    """Occurrences of anchors and their keys."""
    rolling, of, gram = units.rolling, units.of, GRAM[units.kind]
    span, at = length - gram + 1, []
    bits = np.uint64(NEAR.bit_length() + 8)
    for a in range(0, max(0, int(of[-1]) - length + 1), NEAR):
        low = rolling.all(gram, a, a + NEAR + span - 1)
        low = (low >> bits << bits) | np.arange(len(low), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :]) if span > width else low
        at.append((low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) + a)
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    fits = np.diff(of) >= length
    begins = of[:-1][fits]
    starts = spans(begins, of[1:][fits] - length + 1 - begins)
    cut = np.zeros(len(at), bool)
    cut[1:] = at[1:] != at[:-1]
    cut[begins] = True
    first = starts[cut[starts]]
    at = at[first]
    return Anchors.standing(of, first, at, length), rolling.runs(at, at + gram) & _MASK


def _several(keys: np.ndarray, contents: np.ndarray, docs: np.ndarray, hot: int) -> np.ndarray:
    """What is to be done with surroundings that batches sent: key, hash and smallest doc_id of each."""
    number, distinct = pd.factorize(mix(keys * _SPREAD + contents))
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    earliest = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(earliest, number, docs)
    of, held = pd.factorize(keys[first])
    low, high = np.full(len(held), np.iinfo(np.int64).max), np.full(len(held), np.iinfo(np.int64).min)
    np.minimum.at(low, of, earliest)
    np.maximum.at(high, of, earliest)
    n = np.bincount(of, minlength=len(held))
    todo = np.where(low < high, WHOLE + (n > hot) + (n > FAR * hot), ALONE).astype(np.uint8)
    return np.where(docs > earliest[number], np.uint8(LATER), todo[of][number])


ANSWER = "batch int, kind string, part int, answer binary, keys binary, own binary, shown long"


def _rows(table: pa.Table, kind: str, answer: pa.Array, **more: pa.Array) -> pa.Table:
    """Answers to the rows of a part."""
    n = table.num_rows
    columns = {"kind": pa.array([kind] * n, pa.string()), "answer": answer, "keys": pa.nulls(n, pa.binary()), "own": pa.nulls(n, pa.binary()), "shown": pa.nulls(n, pa.int64())} | more
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), **columns}).select(["batch", "kind", "part", "answer", "keys", "own", "shown"])


def _judged(hot: int, length: int):
    """For each surroundings of a batch in this part what is to be done with them, and the keys of those to be shown; the batch's own notes go back."""
    weight = np.array([0, 0, 1, 3, length])

    def work(table: pa.Table) -> pa.Table:
        keys, contents = (widen(flat(table.column(k)), KEY_BYTES) for k in ("keys", "contents"))
        planes = table.column("docs").to_pylist()
        docs = np.concatenate([_joined(x, np.int64) for x in planes])
        todo = _several(keys, contents, docs, hot)
        shown = todo >= WHOLE
        cut = np.cumsum([len(x) // 8 for x in planes])
        n = np.r_[0, np.cumsum(shown)][cut]
        weighed = np.diff(np.r_[0, np.cumsum(weight[todo])][np.r_[0, cut]])
        shown_keys = binaries(np.frombuffer(narrow(keys[shown], KEY_BYTES), np.uint8), n * KEY_BYTES)
        return _rows(table, "judged", binaries(todo, cut), keys=shown_keys, own=table.column("own"), shown=pa.array(weighed, pa.int64()))

    return work


def _of_kind(table: pa.Table, kind: str) -> pa.Table:
    """Rows of one kind by part."""
    return table.filter(pc.equal(table.column("kind"), kind)).sort_by("part")


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on: high bytes that are alike cost nothing when compressed."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _joined(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _own(a: Anchors, number: np.ndarray, shown_by: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """What a batch has to know of its anchors again, for the surroundings of each part; ``shown_by`` ascends in a part.

    First runs and places of the anchors that show the surroundings, then numbers, first runs and places of all other ones.
    """
    begin = np.r_[0, cut[:-1]].astype(np.int64)
    step = np.diff(a.first[shown_by], prepend=0)
    step[begin] = a.first[shown_by[begin]]
    step, place = step.astype("<i4"), (a.at - a.first).astype("<i2")
    more = np.flatnonzero(shown_by[number] != np.arange(len(number)))
    more = more[np.argsort(number[more], kind="stable")]
    of = np.searchsorted(cut, number[more], "right")
    inner, first = (number[more] - begin[of]).astype("<i4"), a.first[more].astype("<i4")
    at = np.searchsorted(of, np.arange(len(cut) + 1))
    found = []
    for i, (x, y) in enumerate(zip(begin.tolist(), cut.tolist(), strict=True)):
        k = slice(at[i], at[i + 1])
        found.append(b"".join([_planes(step[x:y]), _planes(place[shown_by[x:y]]), _planes(inner[k]), _planes(first[k]), _planes(place[more[k]])]))
    return found


def _noted(own: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in the part, first runs and places of all anchors, first those that show its n surroundings."""
    m = (len(own) - 6 * n) // 10
    cut = np.cumsum([0, 4 * n, 2 * n, 4 * m, 4 * m, 2 * m]).tolist()
    step, place, inner, first, more = (_joined(own[x:y], k) for x, y, k in zip(cut[:-1], cut[1:], (np.int32, np.int16, np.int32, np.int32, np.int16), strict=True))
    return np.r_[np.arange(n), inner], np.r_[np.cumsum(step, dtype=np.int64), first], np.r_[place, more].astype(np.int64)


@dataclass
class Judged:
    """Occurrences of a batch, the number of each one's surroundings; an occurrence with the smallest doc_id and what is to be done, for each surroundings; those to be shown, and their keys."""

    a: Anchors
    number: np.ndarray
    shown_by: np.ndarray
    todo: np.ndarray
    shown: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, units: Units, answers: pa.Table, length: int) -> Judged:
        judged = _of_kind(answers, "judged")
        todo, keys = flat(judged.column("answer")), widen(flat(judged.column("keys")), KEY_BYTES)
        sizes = pc.binary_length(judged.column("answer")).to_pylist()
        noted = [_noted(x, n) for x, n in zip(judged.column("own").to_pylist(), sizes, strict=True)]
        base = np.r_[0, np.cumsum(sizes)].tolist()
        number, first, place = (np.concatenate(x) for x in zip(*((k + b, f, p) for (k, f, p), b in zip(noted, base, strict=False)), strict=True))
        shows = np.concatenate([np.arange(len(k)) < n for (k, _, _), n in zip(noted, sizes, strict=True)])
        order = np.argsort(first)
        first, number, shows = first[order], number[order], np.flatnonzero(shows[order])
        shown_by = np.empty(len(todo), np.int64)
        shown_by[number[shows]] = shows
        return cls(Anchors.standing(units.of, first, first + place[order], length), number, shown_by, todo, np.flatnonzero(todo >= WHOLE), keys)


@dataclass
class Shown:
    """Pieces of shown surroundings: runs, of which of the shown ones, number of the equal ones; one of each number; these by part."""

    a: Anchors
    of: np.ndarray
    number: np.ndarray
    one: np.ndarray
    parts: list[tuple[int, np.ndarray]]


def _shown(units: Units, j: Judged, length: int, parts: int) -> Shown:
    whole = j.a.taken(j.shown_by[j.shown])
    todo = j.todo[j.shown]
    kept = np.flatnonzero(todo == WHOLE)
    if len(kept) == len(todo):  # no hot anchor: all are distinct
        same = np.arange(len(todo))
        return Shown(whole, same, same, same, parts_of(j.keys, parts))
    groups = [(whole.taken(kept), j.keys[kept], kept)]
    for level, pieces in ((SPLIT, PIECES), (APART, length - GRAM[units.kind] + 1)):
        at = np.flatnonzero(todo == level)
        a, key, of = whole.taken(at).split(pieces, length, GRAM[units.kind], units.rolling)
        groups.append((a, key, at[of]))
    a = Anchors(*(np.concatenate([getattr(g[0], k) for g in groups]) for k in ("doc", "first", "last", "at")))
    key, of = (np.concatenate([g[i] for g in groups]) for i in (1, 2))
    content = units.rolling.runs(a.first, a.last + length) ^ (key * _SPREAD)
    order = np.lexsort((a.first, units.doc_ids[a.doc], content))
    first = np.flatnonzero(np.r_[True, content[order][1:] != content[order][:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    one = order[first]  # of equal ones, that of the smallest doc_id
    return Shown(a, of, number, one, parts_of(key[one], parts))


def _matched(match: Matcher):
    def work(table: pa.Table) -> pa.Table:
        docs, sizes, texts = flat(table.column("docs")).view(np.int64), flat(table.column("sizes")).view(np.int32), flat(table.column("texts"))
        marks, runs = match(docs, texts, sizes.astype(np.int64))
        cut = np.r_[0, np.cumsum(runs)][np.r_[0, np.cumsum([len(x.as_py()) // 4 for x in table.column("sizes")])]]
        back = [np.packbits(marks[a:b]).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return _rows(table, "marks", pa.array(back, pa.binary()))

    return work


def first_of_each(docs: np.ndarray, texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Places of the distinct texts (with the smallest doc_id, in its order), the number of each text, and whether it comes later than the first."""
    number: dict[bytes, int] = {}
    kept, of = [], np.empty(len(texts), np.int64)
    for i in np.argsort(docs, kind="stable").tolist():
        k = number.setdefault(texts[i], len(kept))
        if k == len(kept):
            kept.append(i)
        of[i] = k
    return kept, of, docs > docs[np.array(kept, np.int64)][of] if len(texts) else np.zeros(0, bool)


def cut_texts(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    whole, cut = data.tobytes(), np.r_[0, np.cumsum(sizes)].tolist()
    return [whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _removed(units: Units, j: Judged, s: Shown, answers: pa.Table, length: int) -> np.ndarray:
    """Whether each unit goes."""
    n = int(units.of[-1])
    a = j.a
    begins, ends = [], []
    todo = j.todo[j.number]
    later = (todo == LATER) | (units.doc_ids[a.doc] > units.doc_ids[a.doc[j.shown_by]][j.number])
    begins.append(a.first[later])
    ends.append(a.last[later] + length)
    if len(j.shown):
        got = _of_kind(answers, "marks")
        got = dict(zip(got.column("part").to_pylist(), got.column("answer").to_pylist(), strict=True))
        runs = (s.a.last - s.a.first + 1)[s.one]
        base = np.zeros(len(s.one), np.int64)
        marked, total = [np.zeros(0, bool)], 0
        for p, at in s.parts:
            m = runs[at]
            base[at] = total + np.cumsum(m) - m
            total += int(m.sum())
            marked.append(np.unpackbits(np.frombuffer(got[p], np.uint8))[: int(m.sum())].astype(bool))
        marked = np.concatenate(marked)
        # marks of the runs of all shown surroundings, from those of their pieces
        whole = a.taken(j.shown_by[j.shown])
        m = whole.last - whole.first + 1
        at = np.cumsum(m) - m
        hit = np.zeros(int(m.sum()), bool)
        k = s.a.last - s.a.first + 1
        after = units.doc_ids[s.a.doc] > units.doc_ids[s.a.doc[s.one]][s.number]
        hit[spans(at[s.of] + s.a.first - whole.first[s.of], k)] = np.repeat(after, k) | marked[spans(base[s.number], k)]
        place = np.full(len(j.todo), -1)
        place[j.shown] = np.arange(len(j.shown))
        open_ = np.flatnonzero((todo >= WHOLE) & ~later)
        of = place[j.number[open_]]
        start = spans(a.first[open_], m[of])[hit[spans(at[of], m[of])]]
        begins.append(start)
        ends.append(start + length)
    return np.cumsum(np.bincount(np.concatenate(begins), minlength=n + 1) - np.bincount(np.concatenate(ends), minlength=n + 1))[:n] > 0


def without_repeats(docs: DataFrame, kind: str, match: Matcher, length: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_units, starts and ends of the removed runs (in units), and what is kept of the text as bytes."""
    table, size = batched(docs)
    key_parts = max(1, -(-size // UNIT_BYTES[kind] // ANCHOR_UNITS // PART))

    def deal(t: pa.Table, _: pa.Table | None) -> pa.Table:
        units = Units.read(t, kind)
        a, keys = anchors(units, length)
        content = units.rolling.runs(a.first, a.last + length) ^ (keys * _SPREAD)
        held, by_id = np.bincount(a.doc, minlength=len(units.doc_ids)), np.argsort(units.doc_ids, kind="stable")
        order = spans((np.cumsum(held) - held)[by_id], held[by_id])
        code, distinct = pd.factorize(content[order])
        one = np.empty(len(distinct), np.int64)
        one[code[::-1]] = order[::-1]
        by_place = np.argsort(one)
        one, back = one[by_place], np.argsort(by_place)
        dealt = parts_of(keys[one], key_parts)
        by_part = np.concatenate([at for _, at in dealt]) if dealt else np.zeros(0, np.int64)
        rank, number = np.empty(len(one), np.int64), np.empty(len(order), np.int64)
        rank[by_part] = np.arange(len(one))
        number[order] = rank[back[code]]
        one = one[by_part]
        cut = np.cumsum([len(at) for _, at in dealt], dtype=np.int64)
        ids = units.doc_ids[a.doc[one]]
        planes = [_planes(ids[x:y]) for x, y in zip(np.r_[0, cut[:-1]].tolist(), cut.tolist(), strict=True)] if dealt else []
        low = {k: binaries(np.frombuffer(narrow(x[one], KEY_BYTES), np.uint8), cut * KEY_BYTES) for k, x in (("keys", keys), ("contents", content))}
        own = _own(a, number, one, cut) if dealt else []
        batch = pa.array([t.column("batch")[0].as_py()] * len(dealt), pa.int32())
        return pa.table({"batch": batch, "part": pa.array([p for p, _ in dealt], pa.int32()), **low, "docs": pa.array(planes, pa.binary()), "own": pa.array(own, pa.binary())})

    dealt = passed(table, None, deal, "batch int, part int, keys binary, contents binary, docs binary, own binary")
    judged = staged(dealt.groupBy("part").applyInArrow(_judged(hot, length), ANSWER), "judged")
    n = judged.agg(F.coalesce(F.sum("shown"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-n * length * 3 // 2 * UNIT_BYTES[kind] // PART_BYTES))

    def show(t: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("docs", "sizes", "texts")
        if not t.num_rows or not answers.num_rows:
            return pa.table({"batch": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), **{k: pa.array([], pa.binary()) for k in names}})
        units = Units.read(t, kind)
        j = Judged.of(units, answers, length)
        s = _shown(units, j, length, parts)
        cut = np.cumsum([len(at) for _, at in s.parts], dtype=np.int64)
        one = s.one[np.concatenate([at for _, at in s.parts])] if s.parts else np.zeros(0, np.int64)
        texts, sizes = units.slices(s.a.first[one], s.a.last[one] + length)
        ids = units.doc_ids[s.a.doc[one]]
        ends = np.r_[0, np.cumsum(sizes)][cut]
        columns = (binaries(ids.view(np.uint8), cut * 8), binaries(sizes.astype(np.int32).view(np.uint8), cut * 4), binaries(texts, ends))
        batch = t.column("batch")[0].as_py()
        return pa.table({"batch": pa.array([batch] * len(s.parts), pa.int32()), "part": pa.array([p for p, _ in s.parts], pa.int32()), **dict(zip(names, columns, strict=True))})

    answers = judged
    if n:
        shown = passed(table, judged, show, "batch int, part int, docs binary, sizes binary, texts binary")
        answers = judged.unionByName(staged(shown.groupBy("part").applyInArrow(_matched(match), ANSWER), "marks"))

    def clear(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({k: pa.array([], v) for k, v in (("doc_id", pa.int64()), ("n_units", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary()))})
        units = Units.read(t, kind)
        if answers.num_rows:
            j = Judged.of(units, answers, length)
            gone = _removed(units, j, _shown(units, j, length, parts), answers, length)
        else:
            gone = np.zeros(int(units.of[-1]), bool)
        edge = np.zeros(len(gone) + 1, bool)
        edge[units.of] = True  # a run ends with its document
        first = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]][: len(gone)] | edge[:-1]))
        last = np.flatnonzero(gone & (np.r_[~gone[1:], True][: len(gone)] | edge[1:])) + 1
        cut = np.searchsorted(first, units.of)
        lists = lambda x, doc: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x - units.of[doc], pa.int64()))
        doc = np.searchsorted(units.of, first, "right") - 1
        ids = t.column("doc_id").combine_chunks()
        return pa.table({"doc_id": ids, "n_units": pa.array(np.diff(units.of).astype(np.int64)), "starts": lists(first, doc), "ends": lists(last, doc), "kept": pa.array(units.kept(gone), pa.binary())})

    return passed(table, answers, clear, "doc_id long, n_units long, starts array<long>, ends array<long>, kept binary")
