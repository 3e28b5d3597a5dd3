"""Quality classifier: a sparse rule ensemble.

Statistics of every whole text become columns. On a bounded sample of labelled rows, boosted trees are
grown; every path from a root to a node is a conjunctive rule; a lasso logistic regression keeps the few
rules that matter; and the score is one Spark column expression over the statistics.

Defined results: null and empty texts have statistics 0 and get the score of such rows; without usable
labels the score is 0.5; labels other than 0 and 1, and null ones, teach nothing; a document with several
label rows counts once for each; rows that repeat a doc_id are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .packing import PLAIN, Texts, blocks, column
from .shared import staged

#: Labelled rows that are taken to the driver at most: those with the smallest hashes of the doc_id.
SAMPLE = 20_000

_CLASSES = {
    "lower": [*range(0x61, 0x7B)],
    "upper": [*range(0x41, 0x5B)],
    "digit": [*range(0x30, 0x3A)],
    "symbol": [b for b in range(0x21, 0x7F) if chr(b) in "#$%&*+/<=>@[\\]^_`{|}~"],
    "stop": [ord("."), ord("!"), ord("?")],
    "comma": [ord(","), ord(";"), ord(":")],
    "space": [0x20, *range(0x09, 0x0E)],
    "line": [0x0A],
    "wide": [*range(0x80, 0x100)],
}
STATISTICS = [
    *(f"{k}_share" for k in _CLASSES),
    "log_bytes",
    "log_words",
    "mean_word",
    "longest_word",
    "distinct_words",
    "top_word",
    "distinct_lines",
    "words_a_line",
    "upper_words",
    "odd_words",
]


def _most_repeated(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document, the number of distinct values and how often the most frequent one occurs."""
    distinct, top = np.zeros(docs), np.zeros(docs)
    for a in range(0, docs, 1 << 16):
        lo, hi = np.searchsorted(doc, [a, a + (1 << 16)])
        if lo == hi:
            continue
        key = np.sort(((doc[lo:hi] - a).astype(np.uint64) << np.uint64(48)) | (value[lo:hi] >> np.uint64(16)))
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        owner = (key[start] >> np.uint64(48)).astype(np.int64)
        run = np.diff(np.r_[start, len(key)])
        distinct[a : a + (1 << 16)] = np.bincount(owner, minlength=min(1 << 16, docs - a))
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        top[owner[first] + a] = np.maximum.reduceat(run, first)
    return distinct, top


def text_statistics(texts: Texts) -> dict[str, np.ndarray]:
    """One array for each name in ``STATISTICS``, one value for each text."""
    docs, at = len(texts), texts.at
    size = np.diff(at).astype(float)
    found: dict[str, np.ndarray] = {}

    def within(mark: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mark, dtype=np.int64)]
        return total[at[1:]] - total[at[:-1]]

    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[members] = True
        found[f"{name}_share"] = within(table[texts.data]) / np.maximum(size, 1)
    words = texts.words(PLAIN)
    count = words.counts().astype(float)
    doc, hashes, length = words.doc(), words.hashes(), words.end - words.start
    longest = np.zeros(docs)
    full = count > 0
    if len(words):
        longest[full] = np.maximum.reduceat(length, words.of[:-1][full])
    letter = np.r_[0, np.cumsum(((texts.data | 0x20) >= 0x61) & ((texts.data | 0x20) <= 0x7A) | (texts.data >= 0x80), dtype=np.int64)]
    upper = np.r_[0, np.cumsum((texts.data >= 0x41) & (texts.data <= 0x5A), dtype=np.int64)]
    symbols = np.zeros(256, bool)
    symbols[[*_CLASSES["symbol"], *_CLASSES["digit"]]] = True
    symbol = np.r_[0, np.cumsum(symbols[texts.data], dtype=np.int64)]
    inside = lambda total: total[words.end] - total[words.start]
    shouted = (inside(upper) > 1) & (inside(upper) == inside(letter))
    odd = inside(symbol) > 0
    per = np.maximum(count, 1)
    distinct, top = _most_repeated(doc, hashes, docs)
    table = np.ones(256, bool)
    table[0x0A] = False
    lines = texts.words(table)
    line_count = lines.counts().astype(float)
    distinct_lines, _ = _most_repeated(lines.doc(), lines.hashes(), docs)
    found |= {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(count),
        "mean_word": np.bincount(doc, length, docs) / per,
        "longest_word": longest,
        "distinct_words": distinct / per,
        "top_word": top / per,
        "distinct_lines": distinct_lines / np.maximum(line_count, 1),
        "words_a_line": count / np.maximum(line_count, 1),
        "upper_words": np.bincount(doc, shouted, docs) / per,
        "odd_words": np.bincount(doc, odd, docs) / per,
    }
    return found


def with_statistics(docs: DataFrame, *carried: str, text: str = "text") -> DataFrame:
    """The carried columns and the statistics of the whole text, a column or a field of a carried struct."""
    kept = docs.select(*carried) if "." in text else docs.select(*carried, text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            found = text_statistics(Texts.of(column(block, text)))
            yield pa.RecordBatch.from_arrays([*(block.column(k) for k in carried), *(pa.array(found[k].astype(float)) for k in STATISTICS)], [*carried, *STATISTICS])

    return kept.mapInArrow(measure, StructType([*kept.select(*carried).schema, *(StructField(k, DoubleType()) for k in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """True where every term (statistic, above, value) holds: above the value, or else at most it."""

    terms: tuple[tuple[str, bool, float], ...]

    def applies(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, above, value in self.terms:
            hit &= (x[:, names.index(name)] > value) == above
        return hit

    def column(self) -> Column:
        hit = F.lit(True)
        for name, above, value in self.terms:
            hit = hit & (F.col(name) > F.lit(value) if above else F.col(name) <= F.lit(value))
        return hit


def _grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: np.ndarray, rules: set, names: list[str]) -> None:
    """One regression tree of Newton steps; adds its paths to ``rules`` and its output to ``out``."""
    g, h = gradient[rows].sum(), weight[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.bincount(b, w, len(cuts) + 1).cumsum()[:-1] for w in (gradient[rows], weight[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    if best[1] is None:
        out[rows] += g / (h + 1)
        return
    _, f, k = best
    for above in (False, True):
        side = rows[(binned[rows, f] > k) == above]
        terms = (*path, (names[f], above, float(edges[f][k])))
        rules.add(Rule(tuple(sorted(set(terms)))))
        _grow(binned, edges, gradient, weight, side, depth - 1, least, terms, out, rules, names)


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32) -> list[Rule]:
    """The paths of gradient-boosted trees as conjunctive rules."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    rules: set[Rule] = set()
    margin = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), depth, max(5, len(y) // 400), (), step, rules, names)
        margin += rate * step
    return sorted(rules, key=lambda r: r.terms)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is free."""
    n, k = z.shape
    shift, scale = z.mean(0), np.maximum(z.std(0), 1e-3)
    s = (z - shift) / scale
    size = 0.25 * (np.linalg.norm(s.T @ s / n, 2) + 1) if k else 1
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(s @ v + c))) - y
        new = v - s.T @ r / n / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        low = c - r.mean() / size
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), low + (t - 1) / t2 * (low - b)
        w, b, t = new, low, t2
    return w / scale, b - float((w / scale * shift).sum())


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            margin = margin + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.0015) -> RuleModel:
    """Rules and weights from statistics and labels; fewer than two labels of a kind give a constant."""
    if min(y.sum(), len(y) - y.sum()) < 2:
        return RuleModel([], [], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules = tree_rules(x, y, names)
    z = np.stack([r.applies(x, names) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    weights, intercept = lasso_logistic(z, y, penalty)
    kept = np.flatnonzero(weights)
    return RuleModel([rules[i] for i in kept], [float(weights[i]) for i in kept], intercept)


def bucket(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def lessons(docs: DataFrame, labels: DataFrame, label: str, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """of, y: usable labels of ``docs`` outside the held-out fold, of documents with the smallest hashes where there are many.

    The hash bound keeps ``sample`` labels and a margin of six standard deviations, so that what follows never
    orders or sends more than that.
    """
    taught = labels.where(F.col(label).isin(0, 1) & (bucket(F.col("doc_id"), folds) != held)).select(F.col("doc_id").cast("long").alias("of"), F.col(label).cast("double").alias("y"))
    n = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(taught, F.col("doc_id") == F.col("of")).count()
    if n <= sample:
        return taught
    share = (sample + 6 * sample**0.5) / n
    return taught.where(F.xxhash64("of") < F.lit(int(-(2**63) + min(share, 0.999) * 2**64)))


def learnt(measured: DataFrame, taught: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """The ensemble fitted to the rows of ``measured`` (doc_id and statistics) that ``taught`` labels."""
    rows = measured.join(taught, measured["doc_id"] == taught["of"]).orderBy(F.xxhash64("of"), "of", *STATISTICS, "y").limit(sample).select(*STATISTICS, "y").toPandas()
    return fit(rows[STATISTICS].to_numpy(float).reshape(-1, len(STATISTICS)), rows["y"].to_numpy(float), STATISTICS)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of documents in the held-out fold teach nothing."""
    measured = staged(with_statistics(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id"), "statistics")
    model = learnt(measured, lessons(measured, labels, label, folds, held, sample), sample)
    score = measured.select("doc_id", F.coalesce(bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    taught = lessons(docs, labels, label)
    known = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(taught.select(F.col("of").alias("doc_id")).distinct(), "doc_id", "left_semi")
    model = learnt(staged(with_statistics(known, "doc_id"), "statistics"), taught)
    rows = with_statistics(docs.select(F.struct(*docs.columns).alias("document")), "document", text="document.text")
    return rows.where(model.score() >= threshold).select("document.*")
