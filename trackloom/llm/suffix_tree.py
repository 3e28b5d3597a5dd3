"""LM scoring by a probabilistic suffix tree over words.

A state is a context of up to ``DEPTH`` words. Candidates are the contexts seen ``LEAST`` times or more, below
which none can pass the test that follows, so states grow with the corpus; a candidate stays if its next-word distribution diverges enough from the one of the longest shorter suffix that stayed,
each occurrence being judged by the counts without it, so that chance does not look like divergence. A state's distribution is smoothed with that of its suffix: next words seen once lend their mass to it,
``P(x | s) = (c(s, x) + a(s) P(x | suffix of s)) / (c(s) + a(s))`` with ``a(s)`` their number and a half
and ``c`` without them; the root is the smoothed unigram distribution of the contract. A token is scored
by the longest suffix state before it.

Counts of words and of candidate contexts with their next words are taken over all training documents by
packed exchanges, depth by depth. States are never in one place: the part of the key space that owns a context decides
whether it stays and answers each batch that holds it.

Defined results: a null or empty text is the end alone; without training tokens both scores are those of
an empty table of counts; rows that repeat a doc_id are counted and scored one by one; a null doc_id is held
out by no fold and trains; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PART, batched, narrow, opened, parts_of, passed, squeezed, widen
from .packing import PLAIN, Rolling, Texts, numbered
from .shared import staged

DEPTH = 3
#: Occurrences of a candidate: a context gains only by a next word seen three times or more.
LEAST = 3
#: Nats by which a state's distribution must diverge from its suffix's, on average over its occurrences.
DIVERGENCE = 0.02
#: Added to the count of every word, and of one unseen word, at the root.
ROOT = 0.1
END = np.uint64(0x5851F42D4C957F2D)
#: Bytes of a key that are sent, by depth: single words are counted without truncation.
KEY_BYTES = [8, 6, 6, 6]


class Sequence:
    """The tokens of a batch: words and an end for each document."""

    def __init__(self, table: pa.Table):
        column = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        words = Texts.of(column).lowered().words(PLAIN)
        counts = words.counts()
        self.n = counts + 1
        self.ends = np.cumsum(self.n)
        self.token = np.full(int(self.n.sum()), END, np.uint64)
        at = np.arange(len(self.token))
        self.place = at - np.repeat(self.ends - self.n, self.n)
        word = np.ones(len(self.token), bool)
        word[self.ends - 1] = False
        self.token[word] = words.hashes()
        self.rolling = Rolling(self.token)
        self.teaches = np.repeat(~pc.fill_null(table.column("held"), False).to_numpy(zero_copy_only=False).astype(bool), self.n)

    def keys(self, depth: int, where: np.ndarray) -> np.ndarray:
        """Hashes of the ``depth`` words before each place and its token."""
        key = self.token[where] if depth == 0 else self.rolling.runs(where - depth, where + 1)
        return key if KEY_BYTES[depth] == 8 else key & np.uint64((1 << 8 * KEY_BYTES[depth]) - 1)


def _answered(seq: Sequence, answers: pa.Table | None, depths: int, parts: list[int], least: float):
    """For each depth: the places counted, the number of distinct key of each, the keys, the counts of the keys if known,
    the distinct contexts (keys of the depth before) and the number of each place's.

    A place is counted at a depth if the words before it are a candidate: the sequence that ends one place
    earlier was counted ``least`` times or more.
    """
    places = np.arange(len(seq.token))
    frequent = context = of = None
    for depth in range(depths):
        where = places if depth == 0 else places[(seq.place >= depth)]
        if depth:
            where = where[frequent[where - 1]]
            of = number_at[where - 1]
            used = np.zeros(len(distinct), bool)
            used[of] = True
            context, of = distinct[used], (np.cumsum(used) - 1)[of]
        distinct, number = numbered(seq.keys(depth, where))
        count = None
        if answers is not None:
            mine = answers.filter(pc.equal(answers.column("depth"), depth))
            if mine.num_rows or not len(distinct):
                count = np.zeros(len(distinct), np.int64)
                got = dict(zip(mine.column("part").to_pylist(), mine.column("counts").to_pylist(), strict=True))
                for p, at in parts_of(distinct, parts[depth]):
                    count[at] = opened(got[p], "<i8")
        yield depth, where, number, distinct, count, context, of
        if count is None:
            return
        frequent, number_at = np.zeros(len(seq.token), bool), np.zeros(len(seq.token), np.int64)
        frequent[where] = count[number] >= least
        number_at[where] = number


def _sent(seq: Sequence, batch: int, depth: int, where: np.ndarray, number: np.ndarray, distinct: np.ndarray, parts: int) -> list[tuple]:
    own = np.bincount(number, seq.teaches[where], len(distinct)).astype(np.int64)
    return [(batch, p, narrow(distinct[at], KEY_BYTES[depth]), squeezed(own[at])) for p, at in parts_of(distinct, parts)]


def _totals(depth: int):
    def add(table: pa.Table) -> pa.Table:
        width = KEY_BYTES[depth]
        keys = [widen(x, width) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([opened(x, "<i8") for x in table.column("counts").to_pylist()])
        distinct, number = numbered(np.concatenate(keys))
        total = np.bincount(number, counts, len(distinct)).astype(np.int64)
        cut = np.cumsum([0, *map(len, keys)])
        back = [squeezed(total[number[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        first = np.arange(table.num_rows) == 0
        return pa.table(
            {
                "batch": table.column("batch"),
                "depth": pa.array(np.full(table.num_rows, depth, np.int32)),
                "part": table.column("part"),
                "counts": pa.array(back, pa.binary()),
                "tokens": pa.array(np.where(first, total.sum(), 0)),
                "words": pa.array(np.where(first, (total > 0).sum(), 0)),
            }
        )

    return add


ANSWER = "batch int, depth int, part int, counts binary, tokens long, words long"


def _smoothed(seq: Sequence, levels, answers: pa.Table | None, parts: list[int], tokens: int, words: int):
    """log of the root's and of the longest state's probability at every place, and the counts of the words."""
    base = chance = known = None
    for depth, where, number, _, count, context, of in levels:
        c = count[number]
        if depth == 0:
            base = (c + ROOT) / (tokens + ROOT * (words + 1))
            chance, known = base.copy(), c
            continue
        mine = answers.filter(pc.equal(answers.column("depth"), -depth))
        got = dict(zip(mine.column("part").to_pylist(), mine.column("counts").to_pylist(), strict=True))
        state = np.zeros((2, len(context)))
        for p, at in parts_of(context, parts[depth]):
            state[:, at] = opened(got[p], "<i8").reshape(2, -1)
        kept, once = state[:, of]
        stays = kept > 0
        w, c, kept, mass = where[stays], c[stays], kept[stays], 0.5 + once[stays]
        chance[w] = (np.where(c > 1, c, 0) + mass * chance[w]) / (kept + mass)
    return base, chance, known


SENT = "batch int, part int, keys binary, counts binary, gain binary"


def _sums(depth: int, parts: list[int], least: float, tokens: int, words: int, last: bool):
    """What a batch adds to the candidates of a depth (with their gain), and its keys of the next depth if there is one."""

    def work(table: pa.Table, answers: pa.Table | None) -> pa.Table:
        seq = Sequence(table)
        levels = list(_answered(seq, answers, depth + (1 if last else 2), parts, least))
        batch = table.column("batch")[0].as_py() if table.num_rows else 0
        _, chance, _ = _smoothed(seq, [x for x in levels if x[0] < depth], answers, parts, tokens, words)
        _, where, number, distinct, count, context, of = levels[depth]
        teach = seq.teaches[where]
        at, of, c = where[teach], of[teach], count[number][teach]
        firm = c > 2
        own = np.stack([np.bincount(of, x, len(context)) for x in (c > 1, c == 1, firm)]).astype(np.int32)
        gain = np.bincount(of, np.where(firm, np.log(np.maximum(c - 1, 1)) - np.log(chance[at]), 0.0), len(context)).astype(np.float32)
        rows = [(batch, p, narrow(context[x], KEY_BYTES[depth - 1]), squeezed(own[:, x]), squeezed(gain[x])) for p, x in parts_of(context, parts[depth])]
        if len(levels) > depth + 1:
            rows += [(*r, None) for r in _sent(seq, batch, depth + 1, *levels[depth + 1][1:4], parts[depth + 1])]
        kinds = (("batch", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("gain", pa.binary()))
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds)})

    return work


def _staying(depth: int, least: float, divergence: float):
    """Answers each batch's contexts with what is kept and what is seen once of those that stay, and with 0 for the others."""
    width = KEY_BYTES[depth - 1]

    def decide(table: pa.Table) -> pa.Table:
        keys = [widen(x, width) for x in table.column("keys").to_pylist()]
        own = np.concatenate([opened(x, "<i4").reshape(3, -1) for x in table.column("counts").to_pylist()], axis=1)
        gain = np.concatenate([opened(x, "<f4") for x in table.column("gain").to_pylist()])
        distinct, number = numbered(np.concatenate(keys))
        kept, once, firm, gain = (np.bincount(number, x, len(distinct)) for x in (*own, gain))
        total = kept + once
        # each occurrence is judged by the counts without it: what then was seen once or never gets what the state lends
        lent = (total - firm) * np.log((once + 0.5) / (total + 0.5))
        stays = (total >= least) & (kept > 0) & (gain - firm * np.log(np.maximum(total, 1)) + lent >= divergence * total)
        state = (np.stack([kept, once]) * stays).astype(np.int64)
        cut = np.cumsum([0, *map(len, keys)])
        back = [squeezed(state[:, number[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        none = pa.array(np.zeros(table.num_rows, np.int64))
        return pa.table({"batch": table.column("batch"), "depth": pa.array(np.full(table.num_rows, -depth, np.int32)), "part": table.column("part"), "counts": pa.array(back, pa.binary()), "tokens": none, "words": none})

    return decide


def _decided(depth: int, least: float, divergence: float):
    """States of a depth and counts of the next one, from one exchange."""
    states, counts = _staying(depth, least, divergence), _totals(depth + 1)

    def work(table: pa.Table) -> pa.Table:
        is_state = pc.is_valid(table.column("gain"))
        found = [f(t) for f, t in ((states, table.filter(is_state)), (counts, table.filter(pc.invert(is_state)))) if t.num_rows]
        return pa.concat_tables(found)

    return work


def scored(docs: DataFrame, folds: int = 10, held: int = 0, depth: int = DEPTH, least_share: float = 0.0, divergence: float = DIVERGENCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the fold ``held`` does not teach."""
    table, size = batched(docs)
    table = table.withColumn("held", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False)))
    parts = [max(1, -(-size // 30 // PART)), *[max(1, -(-size // 6 // PART))] * depth]

    def first(t: pa.Table, _: pa.Table | None) -> pa.Table:
        seq = Sequence(t)
        level = next(_answered(seq, None, 1, parts, 0))
        rows = _sent(seq, t.column("batch")[0].as_py(), *level[:4], parts[0])
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("batch", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())))})

    sent = passed(table, None, first, "batch int, part int, keys binary, counts binary")
    answers = staged(sent.groupBy("part").applyInArrow(_totals(0), ANSWER), "counts")
    tokens, words = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    least = max(LEAST, least_share * tokens)
    if depth:
        only = passed(table, answers, _next_only(parts, least), "batch int, part int, keys binary, counts binary")
        answers = answers.unionByName(staged(only.groupBy("part").applyInArrow(_totals(1), ANSWER), "counts"))
    for d in range(1, depth + 1):
        both = passed(table, answers, _sums(d, parts, least, tokens, words, d == depth), SENT)
        answers = answers.unionByName(staged(both.groupBy("part").applyInArrow(_decided(d, least, divergence), ANSWER), "answers"))

    def score(t: pa.Table, a: pa.Table) -> pa.Table:
        seq = Sequence(t)
        base, chance, known = _smoothed(seq, _answered(seq, a, depth + 1, parts, least), a, parts, tokens, words)
        start = seq.ends - seq.n
        add = lambda x: np.add.reduceat(x, start) if len(start) else x[:0]
        return pa.table(
            {
                "doc_id": t.column("doc_id"),
                "held_out": t.column("held"),
                "n_tokens": pa.array(seq.n.astype(np.int64)),
                "n_known": pa.array(add((known > 0).astype(np.int64)).astype(np.int64)),
                "base_score": pa.array(add(np.log10(base)).astype(float)),
                "score": pa.array(add(np.log10(chance)).astype(float)),
            }
        )

    found = passed(table, answers, score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _next_only(parts: list[int], least: float):
    def work(t: pa.Table, a: pa.Table | None) -> pa.Table:
        seq = Sequence(t)
        levels = list(_answered(seq, a, 2, parts, least))
        rows = _sent(seq, t.column("batch")[0].as_py() if t.num_rows else 0, *levels[1][:4], parts[1]) if len(levels) > 1 else []
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("batch", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())))})

    return work
