"""Every operator against a brute-force version, on texts with nulls, empties, long ones, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.llm import (
    gated_recurrent,
    hamming_minhash,
    hash_forest,
    histogram_sort,
    mixing,
    positional_index,
    previous_factor,
    rule_ensemble,
    suffix_automaton,
    suffix_tree,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size string, key string, label int, part int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = [None, "", "   \n", "One", "two words", " ".join(base), " ".join(base), "\n".join(base)]
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 5) : rng.randint(55, 70)]
        if i % 5 == 0:
            words = list(base)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    out += [" ".join(base).upper(), " ".join(w.capitalize() for w in base)]
    out.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    return out


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source); the last three repeat the first doc_id, a whole row, and null."""
    found = [(i, t, None if i % 11 == 3 else f"s{i % 3}") for i, t in enumerate(texts())]
    return [*found, (5, "another text of document five", "s1"), found[6], (None, found[9][1], "s2")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", "y", 3, 4) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [tuple(r) for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed(units, length):
    """Brute force: marks of the units that go, documents given as (doc_id, units)."""
    order = lambda d: -(2**63) if d is None else d
    first = {}
    for doc, seq in units:
        for i in range(len(seq) - length + 1):
            w = tuple(seq[i : i + length])
            first[w] = min(first.get(w, 2**63), order(doc))
    marks = []
    for doc, seq in units:
        gone = [False] * len(seq)
        for i in range(len(seq) - length + 1):
            if first[tuple(seq[i : i + length])] < order(doc):
                gone[i : i + length] = [True] * length
        marks.append(gone)
    return marks


def runs(marks):
    starts = [i for i, m in enumerate(marks) if m and (i == 0 or not marks[i - 1])]
    return starts, [next((j for j in range(i, len(marks)) if not marks[j]), len(marks)) for i in starts]


@pytest.mark.parametrize("hot", [8192, 1, 0])  # no anchor split, all in pieces or run by run, all run by run
def test_substring_dedup(docs, none, rows, hot):
    got = Counter((r.doc_id, r.n_words, tuple(r.starts), tuple(r.ends), bytes(r.kept)) for r in suffix_automaton.substring_dedup(docs, hot=hot).collect())
    units = [(i, words(t)) for i, t, _ in rows]
    want = Counter((i, len(w), *map(tuple, runs(m)), " ".join(x for x, g in zip(w, m) if not g).encode()) for (i, w), m in zip(units, removed(units, 50)))
    assert got == want
    assert any(k[2] for k in want)
    assert suffix_automaton.substring_dedup(none).count() == 0


@pytest.mark.parametrize("hot", [8192, 1, 0])
def test_suffix_array_dedup(docs, none, rows, hot):
    short = [(i, t, s) for i, t, s in rows if len(t or "") < 20_000]
    got = Counter((r.doc_id, r.n_bytes, tuple(r.starts), tuple(r.ends), bytes(r.kept)) for r in previous_factor.suffix_array_dedup(docs, hot=hot).collect() if r.n_bytes < 20_000)
    units = [(i, (t or "").encode()) for i, t, _ in rows]
    marks = removed(units, 50)
    want = Counter((i, len(b), *map(tuple, runs(m)), bytes(x for x, g in zip(b, m) if not g)) for (i, b), m in zip(units, marks) if len(b) < 20_000)
    assert len(short) == sum(got.values())
    assert got == want
    assert previous_factor.suffix_array_dedup(none).count() == 0


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(50):
        parts = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(3)]
        automaton = suffix_automaton.SuffixAutomaton()
        for p in parts:
            automaton.add(p)
        asked = [rng.choice("abc") for _ in range(20)]
        held = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i, len(p) + 1)} | {()}
        best = [max(k for k in range(e + 2) if tuple(asked[e + 1 - k : e + 1]) in held) for e in range(len(asked))]
        assert automaton.matching(asked) == best


def test_longest_previous_factor():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 380)
    owner = starts // 40
    order, common = previous_factor.sorted_suffixes(data, starts, 13)
    found = np.empty(len(order), np.int64)
    found[order] = previous_factor.longest_previous(owner[order], common, 5)
    pieces = [bytes(data[s : s + 13]) for s in starts]
    for i in range(len(starts)):
        best = max((next((k for k in range(13) if pieces[i][k] != pieces[j][k]), 13) for j in range(len(starts)) if owner[j] < owner[i]), default=0)
        assert found[i] == (best if best >= 5 else 0)


def test_near_duplicates(docs, none, rows):
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate(LOWER))
        sets.append(frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                    changed = True
    least = {}
    for (d, _, _), x in zip(rows, label):
        least[x] = min((v for v in (least.get(x), d) if v is not None), default=None)
    want = Counter((d, len(s), least[x] if s else d, d == (least[x] if s else d)) for (d, _, _), s, x in zip(rows, sets, label))
    assert Counter(collected(hamming_minhash.near_duplicates(docs))) == want
    assert hamming_minhash.near_duplicates(none).count() == 0


def test_near_duplicates_that_differ_in_case(spark):
    made = [(1, "The Cat Sat On The Mat Today"), (2, "the cat sat on the mat today"), (3, "É x y z w v"), (4, "é x y z w v")]
    found = hamming_minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(collected(found)) == [(1, 3, 1, True), (2, 3, 1, False), (3, 2, 3, True), (4, 2, 4, True)]


@pytest.mark.parametrize("hot", [20_000, 5])
def test_hot_group_of_near_copies(spark, hot, monkeypatch):
    """``hot`` of 5 splits every key of the joins that has more than a few rows."""
    monkeypatch.setattr(hamming_minhash, "HOT", hot)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    made = []
    for i in range(150):
        w = list(base)
        for k in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{i}_{k}"
        made.append((i, " ".join(w)))
    got = dict((r.doc_id, r.component_id) for r in hamming_minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect())
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(56)) for _, t in made]
    label = list(range(150))
    for _ in range(150):
        new = [min(label[j] for j in range(150) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) for i in range(150)]
        if new == label:
            break
        label = new
    assert got == dict(enumerate(label))


def items():
    t = texts()
    long = words(t[20]) or words(t[21])
    return [("b1", " ".join(words(t[5])[10:40])), ("b2", "two WORDS"), ("b3", ""), ("b4", None), (None, "one"), ("b2", "one"), ("b5", " ".join(long[:14]))]


def windows_of(n=13):
    found = []
    for k, t in items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        if k and w:
            found += [(k, tuple(w[i : i + n])) for i in range(max(1, len(w) - n + 1))]
    return found


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contaminated_documents(spark, docs, none, rows, block, monkeypatch):
    real = positional_index.item_blocks
    monkeypatch.setattr(positional_index, "item_blocks", lambda b: real(b, block))
    benchmark = spark.createDataFrame(items(), "item_id string, text string")
    if block == 40:
        docs = docs.where("doc_id IS NOT NULL AND doc_id NOT IN (5, 6)")
        rows = [r for r in rows if r[0] not in (None, 5, 6)]
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in positional_index.contaminated_documents(docs, benchmark).collect())
    want = Counter()
    for d, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hit, names = set(), set()
        for k, win in windows_of():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(k)
        want[(d, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert got == want
    assert positional_index.contaminated_documents(none, benchmark).count() == 0
    assert positional_index.contaminated_documents(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_item_blocks_change_no_row(spark, docs, monkeypatch):
    """Items in several blocks give what one block gives, also for rows with a null doc_id or that share doc_id and number of words."""
    long = words(texts()[5])
    more = [(None, " ".join(long[10:40])), (900, " ".join(long[:30])), (900, "clean " * 30), (900, " ".join(long[15:45]))]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items(), "item_id string, text string")
    real, found = positional_index.item_blocks, []
    for block in (1 << 20, 40):
        monkeypatch.setattr(positional_index, "item_blocks", lambda b, block=block: real(b, block))
        got = positional_index.contaminated_documents(docs, benchmark).collect()
        found.append(Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got))
    assert found[0] == found[1]
    assert (900, 30, 0, (), False) in found[1] and any(k[0] is None and k[2] for k in found[1])


def test_proximity(spark):
    index = positional_index.build_index(spark.createDataFrame([(1, "c x a y b"), (2, "a b"), (3, "c z z z z a b"), (4, None)], "doc_id long, text string"))
    found = positional_index.search(index, [("q", "a b c")], slop=2).where(F.size("items") > 0)
    assert [r.doc_id for r in found.collect()] == [1]


def test_language_model(docs, none, rows):
    got = suffix_tree.scored(docs, least_share=0.002)
    tokens = [words((t or "").translate(LOWER)) + ["\n"] for _, t, _ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)) for (d, _, _), t, h in zip(rows, tokens, held))
    back = got.collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in back) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in back)
    assert suffix_tree.scored(none).count() == 0


def test_language_model_learns_contexts(spark):
    """On texts of a Markov chain the held-out score beats the unigram score; frequent successors score higher."""
    rng = random.Random(9)
    chain = []
    for d in range(300):
        w = ["w0"]
        for _ in range(60):
            w.append(f"w{(int(w[-1][1:]) + rng.choice([1, 1, 1, 2])) % 20}")
        chain.append((d, " ".join(w)))
    found = suffix_tree.scored(spark.createDataFrame(chain, "doc_id long, text string"), least_share=0.001).where("held_out").collect()
    assert found and all(r.score > 0.6 * r.base_score for r in found)
    train = [(d, "a b a c a b") for d in range(1, 60)]
    probe = spark.createDataFrame([*train, *[(1000 + i, f"a {w}") for i, w in enumerate(["a", "b", "c"])], (1003, "a"), (1004, "a zz"), (1005, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_tree.scored(probe, folds=1_000_000, least_share=0.01).collect()}
    assert found[1001].score > found[1002].score > found[1004].score


def test_language_model_keeps_rare_contexts_of_large_inputs(spark):
    """A context seen six times in 100,000 tokens is a state as it is in a small input."""
    rng = random.Random(3)
    filler = [(d, " ".join(f"w{rng.randrange(50)}" for _ in range(500))) for d in range(200)]
    rare = [(1000 + d, "q z") for d in range(6)]
    for made in (rare + filler[:1], rare + filler):
        found = {r.doc_id: r for r in suffix_tree.scored(spark.createDataFrame(made, "doc_id long, text string"), folds=1_000_000).collect()}
        assert found[1000].score > found[1000].base_score + 1


@pytest.mark.parametrize("probes", [1 << 16, 300])
def test_shards(docs, none, rows, probes, monkeypatch):
    monkeypatch.setattr(histogram_sort, "PROBES", probes)
    got = collected(histogram_sort.shard_documents(docs, 4))
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter(r[:3] for r in got) == want
    for shard in range(4):
        slots = sorted(r[5] for r in got if r[4] == shard)
        assert slots == list(range(len(slots)))
    keys = sorted((hashlib.md5((t or "").encode()).hexdigest(), -(2**63) if d is None else d, len((t or "").encode()) + 8) for d, t, _ in rows)
    total, below, cuts = sum(k[2] for k in keys), 0, []
    ends = np.cumsum([k[2] for k in keys])
    same = [i + 1 == len(keys) or keys[i][:2] != keys[i + 1][:2] for i in range(len(keys))]
    for k in (1, 2, 3):
        edges = [0, *(e for e, s in zip(ends, same) if s)]
        cuts.append(min(edges, key=lambda e, k=k: (abs(e - k * total / 4), e)))
    sizes = [sum(r[1] for r in got if r[4] <= k) for k in (0, 1, 2)]
    assert below == 0 and sizes == cuts
    assert histogram_sort.shard_documents(none, 4).count() == 0


def test_mix(docs, none, rows):
    got = collected(mixing.mixed(docs.select("doc_id", "source", "text"), [3.0, 1.0, 2.0], 1.5, 2.0).select("doc_id", "source", "size", "source_size", "target", "copies"))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: [3.0, 1.0, 2.0][i % 3] for i, s in enumerate(order)}
    share, cap = 1.5 * sum(sizes.values()), {s: 2.0 * n for s, n in sizes.items()}
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap[s], mid * weight[s]) for s in sizes) < share else (lo, mid)
    assert Counter((r[0], r[1], r[2], r[3]) for r in got) == Counter((d, s, len(words(t)), sizes[s]) for d, t, s in rows)
    taken = Counter()
    for r in got:
        assert r[4] == pytest.approx(min(cap[r[1]], lo * weight[r[1]]), rel=1e-9) and 0 <= r[5] <= 2
        taken[r[1]] += r[2] * r[5]
    for s in sizes:
        largest = max(len(words(t)) for _, t, x in rows if x == s)
        assert abs(taken[s] - min(cap[s], lo * weight[s])) <= largest
    assert mixing.mixed(none.select("doc_id", "source", "text"), [3.0, 1.0, 2.0], 1.5, 2.0).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(5)
    made = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(40)) if i % 3 else "#$%& @@ " * 20) for i in range(300)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, 1 if i % 3 else 0) for i in range(300)], (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    found = rule_ensemble.scored(table, labels).collect()
    assert len(found) == 300 and all(r.predicted == (1 if r.doc_id % 3 else 0) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert {r.score for r in rule_ensemble.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert rule_ensemble.scored(none, labels).count() == 0
    kept = rule_ensemble.accepted(table.withColumn("upper_share", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "upper_share"] and kept.count() == 200


def test_toxicity(spark, none):
    rng = random.Random(6)
    good = [f"word{i}" for i in range(50)]
    made = []
    for i in range(240):
        w = [rng.choice(good) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["vile", "nasty", "rotten"])
        made.append((i, " ".join(w)))
    table = spark.createDataFrame([*made, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in gated_recurrent.scored(table, labels).collect()}
    right = [found[i].predicted == int(i % 4 == 0) for i in range(240) if found[i].held_out]
    assert sum(right) >= 0.9 * len(right) and len(found) == 242
    assert found[500].score == found[501].score and 0 <= found[500].score <= 1
    assert {r.score for r in gated_recurrent.scored(table, labels.limit(0)).collect()} == {0.5}
    assert gated_recurrent.scored(none, labels).count() == 0
    # repeated rows score alike, clashing columns change nothing, and long texts teach and are scored whole
    longest = [(600 + i, " ".join(w for _, t in made[i::60] for w in t.split()) * 40) for i in range(8)]
    wide = table.unionByName(spark.createDataFrame([*longest, *made[:3]], "doc_id long, text string")).withColumns({"of": F.lit(1), "y": F.lit(1), "score": F.lit("s")})
    again = gated_recurrent.scored(wide, labels.unionByName(spark.createDataFrame([(600 + i, int(i % 4 == 0)) for i in range(8)], "doc_id long, toxic int"))).collect()
    assert len(again) == 242 + 11 and len({(r.doc_id, round(r.score, 6)) for r in again}) == 250
    assert all(r.predicted == 1 for r in again if r.doc_id in (600, 604))


def test_gradient():
    texts_ = gated_recurrent.Texts.of(pd.Series([" ".join(f"w{i * j % 7}" for j in range(50)) for i in range(1, 4)]).pipe(lambda s: __import__("pyarrow").array(s)))
    w, number, v = gated_recurrent.word_ids(texts_)
    net = gated_recurrent.Network(np.unique(v.word), np.unique(v.gram), 1)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    known = net.known(v)
    doc, first = gated_recurrent.window_starts(w.counts())
    numbers = gated_recurrent._numbers(number, w.of, doc, first, len(v.word))
    y, weight, own = np.arange(len(doc)) % 2.0, np.ones(len(doc)), np.ones(len(v.word))

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.inputs(known), numbers)[0]))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradient(known, numbers, y, weight, own)
    for k in ("o", "q", "uf", "ub", "xf", "gram", "word"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        slope = (up - loss()) / 2e-3
        net.p[k][at] = old
        assert slope == pytest.approx(g[k][at], rel=0.05, abs=1e-5)


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 8))
    bad = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [1.0] * 3)]
    table = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (0, x[0].tolist()), (7, x[8].tolist()), *bad], "vec_id long, embedding array<double>")
    found = hash_forest.nearest(table, table.where("vec_id % 20 = 0"), 10, enough=1.0).collect()
    ids, mat = np.array([*range(400), 7]), np.vstack([x, x[8]])
    for q in range(0, 400, 20):
        d = np.sqrt(((mat - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[1] for g in got] == ids[order].tolist() and np.allclose([g[2] for g in got], d[order])
    default = hash_forest.nearest(table, table.where("vec_id % 20 = 0"), 10).collect()
    exact = {(r.query_id, r.vec_id) for r in found}
    assert len({(r.query_id, r.vec_id) for r in default} & exact) >= 0.9 * len(exact)
    assert hash_forest.nearest(table.limit(0), table, 10).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with small labels and benchmark."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items(), "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages_decide_row_by_row(spark, docs, none, corpus):
    """Each stage against a brute-force version, on nulls, repeated rows and columns with clashing names."""
    import corpus_pipeline as cp

    stages = dict(cp.STAGES)
    again = docs.where("doc_id = 6").limit(1)  # a third equal row; and a unique text under the doc_id of a copy
    more = spark.createDataFrame([(7, "nothing like the others at all in here", "en", "s1", 1, "x", "y", 3, 4), (None, None, None, None, None, None, None, None, None)], SCHEMA)
    table = docs.unionByName(again).unionByName(more).withColumns({"row": F.lit(1), "text_hash": F.lit("t"), "document": F.lit("d"), "copy": F.lit(2)})
    given = collected(table)
    sets = []
    for r in given:
        w = words((r[1] or "").translate(LOWER))
        sets.append(frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    label = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    left = stages["MinHash near-dedup"](spark, table, corpus)
    assert left.columns == table.columns
    got = Counter(collected(left))
    assert not got - Counter(given)
    for x in set(label):
        group = [given[i] for i in range(len(given)) if label[i] == x]
        smallest = min((r[0] for r in group if r[0] is not None), default=None)
        assert sum(got[r] for r in {r for r in group if r[0] == smallest}) >= 1
    assert sum(got.values()) == len(set(label))
    clean = []
    for r in given:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))
        hit = {i + k for _, win in windows_of() for i in range(len(w) - len(win) + 1) if tuple(w[i : i + len(win)]) == win for k in range(len(win))}
        if not hit or 20 * len(hit) < len(w):
            clean.append(r)
    assert Counter(collected(stages["benchmark decontamination"](spark, table, corpus))) == Counter(clean) != Counter(given)
    good = rule_ensemble.scored(table, spark.read.parquet(f"{corpus}/labels.parquet")).where("predicted = 1")
    assert sorted(str(r[0]) for r in collected(stages["quality classifier"](spark, table, corpus))) == sorted(str(r[0]) for r in collected(good))
    mixed = Counter(collected(stages["mixing"](spark, table, corpus)))
    assert all(0 < n <= 2 * Counter(given)[r] for r, n in mixed.items())
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, none, corpus).count() == 0, name
    empty = spark.createDataFrame([], "item_id string, text string")
    assert not collected(positional_index.contaminated_documents(table.select("doc_id", "text"), empty).where("contaminated"))


def test_pipeline(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("size", F.lit("clash"))
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, d)
        if name != "sharding":
            assert docs.columns == before.columns
    assert docs.count() > 0


def test_labels_are_bounded_by_hash_before_texts_are_read(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("quality"))
    usable = {i for i in range(4000) if i % 3 < 2 and zlib.crc32(str(i).encode()) % 4 != 2}
    few = {r.of for r in rule_ensemble.lessons(docs, labels, "quality", sample=500).collect()}
    assert few < usable and 500 <= len(few) <= 800
    assert {r.of for r in rule_ensemble.lessons(docs, labels, "quality").collect()} == usable
    assert rule_ensemble.lessons(docs.limit(0), labels, "quality", sample=0).join(docs.limit(0), F.col("of") == F.col("doc_id")).count() == 0
