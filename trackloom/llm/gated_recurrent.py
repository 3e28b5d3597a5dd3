"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of its hash beside the mean embedding of its runs of 3 and of 5
bytes. A window of
words is read forwards and backwards by gated recurrent units; attention weighs the states of its words; a logistic
unit scores it. Every overlapping window of a whole text is scored, and a second logistic unit joins the windows'
scores to one for the document. Words are those between white space, ``A-Z`` lower-cased.

Training takes a bounded sample of labelled documents, long ones among them. Few of them may be toxic, so a word's embedding starts from
its naive Bayes log-odds, and the network first learns to find a window's strongest word. Only documents are labelled, so the windows that
teach next are chosen by these log-odds: those two of each toxic document that hold most; the one and another of each clean one.

Defined results: null and empty texts are one empty window; without labels of both kinds all scores are the
share of label 1 (0.5 without any); labels other than 0 and 1 teach nothing; rows that repeat a doc_id are scored
one by one; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import PLAIN, Rolling, Texts, Words, blocks
from .rule_ensemble import bucket, lessons

#: Labelled documents (those with the smallest hashes) that one task trains on at most. Of a text of more than ``SAMPLE_BYTES``,
#: ``PIECES`` runs of characters, spread evenly over all of it, teach; scoring reads whole texts.
SAMPLE, SAMPLE_BYTES, PIECES = 10_000, 1 << 15, 8
WINDOW, STRIDE = 48, 24
WIDTH, HIDDEN, ATTENTION = 8, 8, 8
#: Labelled documents that must hold a word or a run of bytes before it gets an embedding; the others share one.
SEEN = 4
#: Lengths, in bytes, of the runs of a word that are its character input.
GRAMS = (3, 5)
#: Share of the words whose own embedding is left out in a training step, so that their characters must speak.
DROPPED = 0.5
DECAY = 0.02
#: Windows that are first learnt from naive Bayes, and labelled documents that pull a word's log-odds half-way to 0.
GUIDED, SHRUNK = 6000, 3


@dataclass
class Vocabulary:
    """The distinct words of some texts: rows of the embedding tables for each word, and for its runs of bytes."""

    word: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    count: np.ndarray


def _rows(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 and on for the sorted known hashes, 0 for others."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


def word_ids(texts: Texts) -> tuple[Words, np.ndarray, Vocabulary]:
    """The words, the number of each in the vocabulary, and the vocabulary with hashes in place of rows."""
    words = texts.lowered().words(PLAIN)
    values = words.texts.byte_values()
    rolling = Rolling(values)
    hashes = rolling.runs(words.start, words.end) if len(words) else np.zeros(0, np.uint64)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    start, end = words.start[first], words.end[first]
    owner, gram = [], []
    for n in GRAMS:
        runs = np.maximum(end - start - n + 1, 1)
        of = np.repeat(np.arange(len(first)), runs)
        a = start[of] + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        owner.append(of)
        gram.append(rolling.runs(a, np.minimum(a + n, end[of])) ^ np.uint64(n) if len(a) else np.zeros(0, np.uint64))
    order = np.argsort(np.concatenate(owner), kind="stable")
    owner, gram = np.concatenate(owner)[order], np.concatenate(gram)[order]
    runs = np.bincount(owner, minlength=len(first))
    return words, number.ravel(), Vocabulary(distinct, gram, owner, runs)


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, Vocabulary]:
    """Bounds of the texts' words, numbers of the words, and the vocabulary of all texts, read block by block."""
    counts, hashes, words, runs, grams = [], [], [], [], []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for block in blocks([batch]):
        w, number, v = word_ids(Texts.of(block.column("text")))
        counts.append(w.counts())
        hashes.append(v.word[number])
        words.append(v.word)
        runs.append(v.count)
        grams.append(v.gram)
    distinct, first = np.unique(np.concatenate(words), return_index=True)
    n, gram = np.concatenate(runs), np.concatenate(grams)
    start = np.cumsum(n) - n
    count = n[first]
    used = np.repeat(start[first] - np.cumsum(count) + count, count) + np.arange(count.sum())
    vocabulary = Vocabulary(distinct, gram[used], np.repeat(np.arange(len(first)), count), count)
    return np.r_[0, np.cumsum(np.concatenate(counts))], np.searchsorted(distinct, np.concatenate(hashes)), vocabulary


def often_seen(doc: np.ndarray, value: np.ndarray, least: int) -> np.ndarray:
    """The values that occur in ``least`` documents and more, ascending."""
    order = np.lexsort((doc, value))
    doc, value = doc[order], value[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    values, n = np.unique(value[new], return_counts=True)
    return values[n >= least]


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word, within it, of every window; a text of few words or none has one."""
    per = np.maximum(1, 1 + -(-(counts - WINDOW) // STRIDE)).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), per)
    return doc, (np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(per)[:-1]].astype(np.int64), per)) * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _often_seen_runs(doc: np.ndarray, number: np.ndarray, v: Vocabulary, docs_at_once: int = 256) -> np.ndarray:
    """The runs of bytes that occur in ``SEEN`` documents and more, ascending; ``doc`` ascends."""
    distinct, run = np.unique(v.gram, return_inverse=True)
    run, first, seen = run.ravel(), np.cumsum(v.count) - v.count, np.zeros(len(distinct), np.int32)
    for a in range(0, int(doc[-1]) + 1 if len(doc) else 0, docs_at_once):
        lo, hi = np.searchsorted(doc, [a, a + docs_at_once])
        pair = np.unique((doc[lo:hi] - a) * len(v.count) + number[lo:hi])
        of, word = np.divmod(pair, len(v.count))
        n = v.count[word]
        used = np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        held = np.unique(np.repeat(of, n) * len(distinct) + run[used])
        seen += np.bincount(held % len(distinct), minlength=len(distinct)).astype(np.int32)
    return distinct[seen >= SEEN]


class Network:
    """Parameters, the forward pass and its gradient."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 3):
        """``words`` and ``grams`` are the sorted hashes that have embeddings of their own."""
        self.words, self.grams = words, grams
        rng = np.random.default_rng(seed)
        rand = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": rand(len(words) + 1, WIDTH, scale=0.1), "gram": rand(len(grams) + 1, WIDTH, scale=0.3)}
        for d in "fb":
            self.p |= {f"x{d}": rand(2 * WIDTH, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": rand(HIDDEN, 3 * HIDDEN)}
        self.p |= {"a": rand(2 * HIDDEN, ATTENTION), "q": rand(ATTENTION), "o": rand(2 * HIDDEN), "k": np.zeros(1, np.float32)}

    def known(self, v: Vocabulary) -> Vocabulary:
        """Rows in place of hashes."""
        return Vocabulary(_rows(self.words, v.word), _rows(self.grams, v.gram), v.owner, v.count)

    def inputs(self, v: Vocabulary, own: np.ndarray | None = None) -> np.ndarray:
        """One row for each word of the vocabulary, and a last one of zeros for the padding."""
        p = self.p
        out = np.zeros((len(v.word) + 1, 2 * WIDTH), np.float32)
        if len(v.word):
            out[:-1, :WIDTH] = p["word"][v.word] if own is None else p["word"][v.word] * own[:, None]
            starts = np.r_[0, np.cumsum(v.count)[:-1]]
            out[:-1, WIDTH:] = np.add.reduceat(p["gram"][v.gram], starts, axis=0) / v.count[:, None]
        return out

    def read(self, gates: np.ndarray, number: np.ndarray, live: np.ndarray, d: str, keep: bool = False):
        """States of one direction, time first; ``gates`` are the inputs' projections by word."""
        steps, n = number.shape
        u = self.p[f"u{d}"]
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        kept = {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates[number[t]]
            r_z = _sigmoid(g[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            r, z = r_z[:, :HIDDEN], r_z[:, HIDDEN:]
            un = h @ u[:, 2 * HIDDEN :]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * un)
            new = h + live[t] * (1 - z) * (c - h)
            if keep:
                kept[t] = (h, r, z, un, c)
            states[t] = h = new
        return states, kept

    def forward(self, x: np.ndarray, number: np.ndarray, keep: bool = False):
        """Logit of every window; ``number`` (steps, windows) holds rows of ``x``, the last row is padding."""
        p = self.p
        live = (number < len(x) - 1).astype(np.float32)[:, :, None]
        live[0] = 1  # an empty window still has one state
        states, kept = [], {}
        for d in "fb":
            s, kept[d] = self.read(x @ p[f"x{d}"] + p[f"c{d}"], number, live, d, keep)
            states.append(s)
        h = np.concatenate(states, 2)
        e = np.tanh(h @ p["a"])
        s = np.where(live[:, :, 0] > 0, e @ p["q"], -1e9)
        s = np.exp(s - s.max(0))
        w = s / s.sum(0)
        pooled = (w[:, :, None] * h).sum(0)
        return pooled @ p["o"] + p["k"][0], (live, kept, h, e, w, pooled) if keep else None

    def gradient(self, v: Vocabulary, number: np.ndarray, y: np.ndarray, weight: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
        """``own`` is 0 for words whose own embedding is left out, else 1."""
        p, x = self.p, self.inputs(v, own)
        logit, (live, kept, h, e, w, pooled) = self.forward(x, number, keep=True)
        n = len(y)
        dl = ((_sigmoid(logit) - y) * weight / n).astype(np.float32)
        g = {"o": pooled.T @ dl, "k": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["o"]
        dw = (h * dpool).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        dh = w[:, :, None] * dpool
        g["q"] = np.einsum("tn,tna->a", ds, e)
        de = ds[:, :, None] * p["q"] * (1 - e * e)
        g["a"] = np.einsum("tnh,tna->ha", h, de)
        dh = dh + de @ p["a"].T
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            u = p[f"u{d}"]
            dgates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            g[f"u{d}"] = np.zeros_like(u)
            back = np.zeros((number.shape[1], HIDDEN), np.float32)
            steps = range(number.shape[0])
            for t in reversed(steps) if d == "f" else steps:
                before, r, z, un, c = kept[d][t]
                total = back + dh[t, :, i * HIDDEN : (i + 1) * HIDDEN]
                step = total * live[t]
                dc = step * (1 - z) * (1 - c * c)
                dz = -step * (c - before) * z * (1 - z)
                dr = dc * un * r * (1 - r)
                dun = dc * r
                dgate = np.concatenate([dr, dz, dc], 1)
                np.add.at(dgates, number[t], dgate)
                inner = np.concatenate([dr, dz, dun], 1)
                g[f"u{d}"] += before.T @ inner
                back = total - step * (1 - z) + inner @ u.T
            g[f"x{d}"], g[f"c{d}"] = x.T @ dgates, dgates.sum(0)
            dx += dgates @ p[f"x{d}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], v.word, dx[:-1, :WIDTH] * own[:, None])
        np.add.at(g["gram"], v.gram, (dx[:-1, WIDTH:] / v.count[:, None])[v.owner])
        return g


def _numbers(number: np.ndarray, of: np.ndarray, doc: np.ndarray, first: np.ndarray, pad: int) -> np.ndarray:
    """Vocabulary numbers of the words of windows, time first."""
    at = (of[doc] + first)[None, :] + np.arange(WINDOW)[:, None]
    inside = at < of[doc + 1][None, :]
    return np.where(inside, number[np.minimum(at, max(len(number) - 1, 0))] if len(number) else pad, pad)


def joined(logit: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """What the second unit sees of each document: the highest window, their sum, their mean, how many."""
    prob = _sigmoid(logit)
    top = np.full(docs, -30.0)
    np.maximum.at(top, doc, logit)
    n = np.bincount(doc, minlength=docs)
    total = np.bincount(doc, prob, docs)
    return np.stack([np.clip(top, -12, 12), np.log1p(total), total / np.maximum(n, 1), np.log1p(n)], 1)


@dataclass
class Model:
    network: Network | None
    weights: np.ndarray
    intercept: float

    def scores(self, texts: Texts, at_once: int = 4096) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.intercept)
        words, number, vocabulary = word_ids(texts)
        doc, first = window_starts(words.counts())
        x = self.network.inputs(self.network.known(vocabulary))
        logit = np.empty(len(doc), np.float32)
        for a in range(0, len(doc), at_once):
            part = slice(a, a + at_once)
            logit[part], _ = self.network.forward(x, _numbers(number, words.of, doc[part], first[part], len(x) - 1))
        return _sigmoid(joined(logit, doc, len(texts)) @ self.weights + self.intercept)


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps with a little shrinkage."""
    shift, scale = z.mean(0), np.maximum(z.std(0), 1e-6)
    s = np.c_[(z - shift) / scale, np.ones(len(z))]
    w = np.zeros(s.shape[1])
    for _ in range(30):
        p = _sigmoid(s @ w)
        w += np.linalg.solve((s * (p * (1 - p))[:, None]).T @ s + 0.3 * np.eye(len(w)), s.T @ (y - p) - 0.3 * w * np.r_[np.ones(len(w) - 1), 0])
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale * shift).sum())


def _trained(net: Network, v: Vocabulary, numbers: np.ndarray, pick: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int, rate: float, rng: np.random.Generator, batch: int = 256) -> None:
    """Adam steps on the picked windows; ``target`` and ``weight`` are theirs, ``v`` holds rows of the network's tables."""
    pad, first = len(v.word), np.r_[0, np.cumsum(v.count)]
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(pick)), max(1, len(pick) // batch)):
            here, local = np.unique(numbers[:, pick[rows]], return_inverse=True)
            here = here[here < pad]
            local = np.where(local.reshape(WINDOW, -1) < len(here), local.reshape(WINDOW, -1), len(here))
            starts, count = first[here], v.count[here]
            grams = np.repeat(starts - np.r_[0, np.cumsum(count)[:-1]].astype(np.int64), count) + np.arange(count.sum())
            part = Vocabulary(v.word[here], v.gram[grams], np.repeat(np.arange(len(here)), count), count)
            step += 1
            for k, g in net.gradient(part, local, target[rows], weight[rows], (rng.random(len(here)) >= DROPPED).astype(np.float32)).items():
                m, s = moment[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + rate * DECAY * net.p[k]).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, epochs: int = 4, rate: float = 0.01, seed: int = 5) -> Model:
    """The network fitted to labelled texts.

    First it learns from ``GUIDED`` windows of any of these texts what naive Bayes makes of their strongest word, then from labels. The second unit is
    fitted on scores of texts that the network which gave them has not seen: of a quarter that is held aside, or where
    that holds too few of a kind, of each of three parts by a network trained on the others.
    """
    y = np.asarray(labels, float)
    if min(y.sum(), len(y) - y.sum()) < 2:
        return Model(None, np.zeros(4), float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    of, number, vocabulary = numbered(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(of))
    words, grams = often_seen(owner, vocabulary.word[number], SEEN), _often_seen_runs(owner, number, vocabulary)
    pad = len(vocabulary.word)
    of_doc, of_word = np.divmod(np.unique(owner * (pad + 1) + number), pad + 1)
    doc, first = window_starts(np.diff(of))
    numbers = _numbers(number, of, doc, first, pad)

    def fitted(use: np.ndarray) -> tuple[Network, np.ndarray]:
        """A network that has read the texts of ``use`` only, and its logits of all windows."""
        net = Network(words, grams, seed)
        v = net.known(vocabulary)
        mine = use[of_doc]
        seen = [np.bincount(of_word[mine & (y[of_doc] == k)], minlength=pad) for k in (0, 1)]
        n = [int((use & (y == k)).sum()) for k in (0, 1)]
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        total = seen[0] + seen[1]
        odds = np.where(total >= 3, odds * total / (total + SHRUNK), 0.0)
        net.p["word"][:] = 0
        net.p["word"][v.word, 0] = np.where(v.word > 0, odds, 0.0)
        strongest = np.r_[np.where(v.word > 0, odds, 0.0), 0.0][numbers].max(0)
        some = rng.permutation(np.flatnonzero(use[doc]))[:GUIDED]
        guide = _sigmoid(1.5 * (strongest[some] - 1.5)).astype(np.float32)
        weight = np.where(guide > 0.5, 0.5 / max((guide > 0.5).mean(), 1e-3), 0.5 / max((guide <= 0.5).mean(), 1e-3)).astype(np.float32)
        _trained(net, v, numbers, some, guide, weight, max(2, min(20, 4 * GUIDED // len(some))), rate, rng)
        sums = np.r_[np.maximum(odds, 0), 0][numbers].sum(0)
        order, other = np.lexsort((-sums, doc)), np.lexsort((rng.random(len(doc)), doc))
        place = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        pick = np.unique(np.concatenate([order[place == 0], order[(place == 1) & (y[doc[order]] == 1)], other[(place == 0) & (y[doc[other]] == 0)]]))
        pick = pick[use[doc[pick]]]
        target = y[doc[pick]].astype(np.float32)
        weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3)).astype(np.float32)
        _trained(net, v, numbers, pick, target, weight, epochs, rate, rng)
        x = net.inputs(v)
        return net, np.concatenate([net.forward(x, numbers[:, a : a + 4096])[0] for a in range(0, len(doc), 4096)])

    judged = np.arange(len(y)) % 4 == 3
    if min(y[judged].sum(), (1 - y[judged]).sum()) >= 200:
        net, logit = fitted(~judged)
        return Model(net, *_logistic(joined(logit, doc, len(texts))[judged], y[judged]))
    part, aside = np.zeros(len(y), np.int64), np.zeros(len(doc))
    for k in (0, 1):  # both kinds are dealt evenly
        part[y == k] = np.arange(int((y == k).sum())) % 3
    for k in range(3):
        away = part[doc] == k
        aside[away] = fitted(part != k)[1][away] if 0 < y[part != k].sum() < (part != k).sum() else 0.0
    return Model(fitted(np.ones(len(y), bool))[0], *_logistic(joined(aside, doc, len(texts)), y))


def teaching(text: str) -> Column:
    """What training reads of a text: all of it, or of a long one its pieces."""
    size = SAMPLE_BYTES // PIECES
    step = (F.length(text) - size) / (PIECES - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col(text), (1 + i * step).cast("int"), F.lit(size)))
    return F.when(F.octet_length(text) <= SAMPLE_BYTES, F.col(text)).otherwise(F.array_join(pieces, " "))


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of documents in the held-out fold teach nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    taught = lessons(docs, labels, label, folds, held, sample)
    known = taught.join(docs.select("doc_id"), F.col("of") == F.col("doc_id"), "left_semi").distinct()  # bounded like ``lessons``: the texts are not moved for it
    rows = docs.where("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("of"))
    rows = rows.select("doc_id", teaching("text").alias("text"), F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "y").limit(sample)

    def fitted(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("y").to_numpy(), table.column("doc_id").to_numpy()))
        table = table.take(pa.array(order))
        return pa.table({"model": pa.array([pickle.dumps(train(table.column("text").to_pylist(), table.column("y").to_numpy()))], pa.binary())})

    # the bounded sample is one task's work on an executor; the driver sees only the model
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "model binary").first()
    model = docs.sparkSession.sparkContext.broadcast(pickle.loads(found["model"]) if found else train([], np.zeros(0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(model.value.scores(Texts.of(block.column("text"))).astype(float))], ["doc_id", "score"])

    found = docs.mapInArrow(score, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
