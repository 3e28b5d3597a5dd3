"""Substring dedup of documents that lie in many batches, against brute force."""

import random
from collections import Counter

import pytest

from trackloom.llm import exchange, previous_factor, repeats, suffix_automaton

from .test_llm import SCHEMA, removed, runs, words


def corpus():
    """Copies, near copies, lines that many texts hold, alone and with the same or other neighbours, and rows that share a doc_id."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, base, pair = some(60), some(150), [some(20), some(20)]
    out = [None, "", "ab " * 40, " ".join(base), " ".join(line)]
    for i in range(60):
        text = some(rng.randint(0, 120))
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = line
        if i % 4 == 0:
            text = base[rng.randint(0, 40) : rng.randint(80, 150)]
        if i % 5 == 0:
            text = pair[0] + line + pair[1] if i % 2 else pair[1] + line + pair[0]
        if i % 7 == 0:
            text = list(base)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        out.append(" ".join(text))
    rows = [(i, t) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return [*rows, (7, rows[3][1]), (7, " ".join(line)), (7, " ".join(line)), (None, " ".join(base)), (-4, " ".join(pair[1]))]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 3, 4) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture
def small(monkeypatch):
    """Batches of a few texts, and parts of a few anchors."""
    monkeypatch.setattr(exchange, "BATCH", 1500)
    monkeypatch.setattr(repeats, "PART", 300)
    monkeypatch.setattr(repeats, "PART_BYTES", 3000)


@pytest.mark.parametrize("hot", [8192, 2, 1, 0])
def test_bytes_of_many_batches(docs, rows, small, hot):
    got = Counter((r.doc_id, r.n_bytes, tuple(r.starts), tuple(r.ends), bytes(r.kept)) for r in previous_factor.suffix_array_dedup(docs, hot=hot).collect())
    units = [(i, (t or "").encode()) for i, t in rows]
    want = Counter((i, len(b), *map(tuple, runs(m)), bytes(x for x, g in zip(b, m) if not g)) for (i, b), m in zip(units, removed(units, 50)))
    assert got == want
    assert sum(map(bool, (k[2] for k in want))) > 20


@pytest.mark.parametrize("hot", [8192, 0])
def test_words_of_many_batches(docs, rows, small, hot):
    got = Counter((r.doc_id, r.n_words, tuple(r.starts), tuple(r.ends), bytes(r.kept)) for r in suffix_automaton.substring_dedup(docs, hot=hot).collect())
    units = [(i, words(t)) for i, t in rows]
    want = Counter((i, len(w), *map(tuple, runs(m)), " ".join(x for x, g in zip(w, m) if not g).encode()) for (i, w), m in zip(units, removed(units, 50)))
    assert got == want


def test_copies_are_settled_without_their_text(spark, small):
    """Texts that are equal all around an anchor are told apart by no part, however many batches hold them."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(10)]

    def match(*_):
        raise AssertionError("text was sent")

    got = repeats.without_repeats(spark.createDataFrame([(i, texts[i % 10]) for i in range(100)], "doc_id long, text string"), "bytes", match).collect()
    assert {(r.doc_id, bytes(r.kept).decode()) for r in got} == {(i, texts[i] if i < 10 else "") for i in range(100)}
    assert {r.doc_id: list(zip(r.starts, r.ends)) for r in got} == {i: [(0, 400)] if i >= 10 else [] for i in range(100)}


@pytest.mark.parametrize("near", [64, 1 << 15])
def test_anchors_do_not_depend_on_blocks(monkeypatch, near):
    """Runs stand with the leftmost smallest gram in them, whatever the blocks and the documents around."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (300, 49, 0, 50, 200)]
    units = repeats.Units.read(pa.table({"doc_id": pa.array(range(5)), "text": pa.array(texts)}), "bytes")
    monkeypatch.setattr(repeats, "NEAR", near)
    a, keys = repeats.anchors(units, 50)
    assert sum((a.last - a.first + 1).tolist()) == sum(max(0, len(t) - 49) for t in texts)
    bits = np.uint64(near.bit_length() + 8)
    grams = (units.rolling.all(20) >> bits).tolist()
    for first, last, at, key in zip(a.first.tolist(), a.last.tolist(), a.at.tolist(), keys.tolist()):
        for s in range(first, last + 1):
            assert at == min(range(s, s + 31), key=lambda i: (grams[i], i))
        assert key == int(units.rolling.runs(np.array([at]), np.array([at + 20]))[0]) & (2**48 - 1)
