"""Resampling, hard negatives and SimHash against brute force: nulls, empties, long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trackloom.llm import gated_recurrent, hard_negatives, hash_forest, importance_resampling, mixing, simhash_index
from trackloom.llm.packing import Texts

SCHEMA = "doc_id long, text string, key_score int, key_row string, n_words string, fp string, label int, part int, list string, mask int, bucket int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcXÉé9_") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    out = [None, "", " \t\n", "One", "two, words", " ".join(base), "\n".join(base), " ".join(base).upper()]
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words = list(base)
            words[rng.randrange(300)] = rng.choice(vocabulary)
        out.append(" ".join(words))
    out.append(" ".join(rng.choice(vocabulary) for _ in range(60_000)))
    return out


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text); the last ones repeat a doc_id, a whole row, and null."""
    found = list(enumerate(texts()))
    return [*found, (20, "another text of document twenty " * 9), found[11], found[11], (None, found[13][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", 3, 4, "l", 5, 6) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def drawn(rows, target, percent, least, buckets, longest):
    """Brute force: Counter of (doc_id, n_features, weight, score), and the drawn ones in order."""
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(), Counter()
    for side, some in ((s, [x for _, x in rows]), (t, target)):
        for x in some:
            side.update(map(bucket, runs(x, longest)[1]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    every, able = [], []
    for i, x in rows:
        words, found = runs(x, longest)
        weight = sum(gain[bucket(w)] for w in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = (i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))))
        every.append(row)
        if len(words) >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], -(2**63) if r[0] is None else r[0]))
    return every, able[: len(able) * percent // 100]


@pytest.mark.parametrize(("percent", "longest", "finish"), [(10, 1, 4096), (50, 2, 3), (0, 1, 5)])
def test_resampled(spark, docs, none, rows, percent, longest, finish):
    target = [None, "", rows[8][1], rows[9][1]]
    items = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance_resampling.resampled(docs, items, percent, 20, 500, longest, finish=finish).collect()
    every, want = drawn(rows, target, percent, 20, 500, longest)
    assert Counter(tuple(r)[:4] for r in got) == Counter(every)
    wins = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in wins] == list(range(1, len(want) + 1))
    assert [(r["score"], r["doc_id"]) for r in wins] == [(r[3], r[0]) for r in want]
    assert Counter(tuple(r)[:4] for r in wins if r["doc_id"] != 20) == Counter(r for r in want if r[0] != 20)
    assert importance_resampling.resampled(none, items).count() == 0


def test_resampling_towards_nothing(docs, none, rows):
    got = importance_resampling.resampled(docs, none).collect()
    every, want = drawn(rows, [], 10, 20, 10_000, 1)
    assert Counter(tuple(r)[:4] for r in got) == Counter(every)
    assert sum(r["rank"] is not None for r in got) == len(want) > 0


@pytest.mark.parametrize("n", [1, 700, 2000])
def test_cutoff(spark, n):
    rng = random.Random(n)
    keys = [(rng.randint(-3, 3), rng.choice([-(2**63), 2**62, 5]), i) for i in range(2000)]
    table = spark.createDataFrame(keys, "key_score long, key_doc long, key_row long").repartition(7)
    for finish in (1, 100):
        assert importance_resampling.cutoff(table, n, finish) == sorted(keys)[n - 1]


def vectors(kind):
    """(vec_id, embedding, label) with ties, copies, nulls and vectors of two lengths."""
    rng = np.random.default_rng(kind)
    out = []
    for i in range(160):
        v = rng.normal(size=4 if i % 9 == 0 else 12)
        if kind == 1:
            v = np.round(v) / 256 + 0.001  # many equal scores
        elif i % 4 == 0:
            v = 1 + v / 40  # a dense group
        out.append((i, [float(x) for x in v], int(rng.integers(0, 3))))
    out += [out[20], (161, None, 1), (162, [1.0, None, 2.0], 1), (163, [float("nan")] * 12, 1), (164, [float("inf")] * 12, 0)]
    return [*out, (165, [0.0] * 12, 1), (166, [], 1), (None, [1.0] * 12, 1), (168, [1.0] * 12, None), (170, [-1.0] * 12, 2), (171, [3e3] * 12, 1)]


def hard(rows, positives, negatives):
    fine = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for a, q, label in {(i, tuple(v), c) for i, v, c in fine if i % 10 == 0}:
        near = sorted((-sum(x * y for x, y in zip(q, v)), i, c) for i, v, c in fine if i != a and len(v) == len(q))
        for p, i, _ in [r for r in near if r[2] == label][:positives]:
            some = [r for r in near if r[2] != label and 80 * -p <= 100 * -r[0] <= 100 * -p][:negatives]
            found |= {(a, i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(some)}
    return found


@pytest.mark.parametrize(("kind", "shard_rows"), [(0, 8192), (0, 40), (1, 7)])
def test_hard_negatives(spark, kind, shard_rows):
    rows = vectors(kind)
    table = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "vec_id long, embedding array<double>, label int, v string, shard int, window int, anchor_row string")
    got = hard_negatives.mined(table, table.where("vec_id % 10 = 0"), 5, 5, shard_rows=shard_rows).collect()
    want = hard(rows, 5, 5)
    assert {tuple(r) for r in got} == want
    assert len(want) > 50
    assert len(got) == len(want)
    assert hard_negatives.mined(table.limit(0), table.limit(0)).count() == 0
    assert hard_negatives.mined(table, table.limit(0)).count() == 0


def test_scores_of_any_size():
    q, x = np.array([[2**62, 3], [2**31, 1], [-(2**62), 1]]), np.array([[4, 1], [2**31, 1], [4, 0]])
    assert hard_negatives.exact(q, x).tolist() == [2**63 - 1, 2**62 + 1, -(2**63)]


def test_a_score_at_the_lower_end_of_a_window_of_large_scores():
    q = np.array([[-625974631, 515467214]])
    x = np.array([[-389594054, -457930399], [130970582, -443165318], [-604213037, 337478606], [895249259, -702835237], [-978602027, -357745762], [808230910, -1040350193], [1030607241, -44908887], [247476552, -198605742]])
    low = 552181189700888031  # the third row's score; doubles near it lie 64 apart
    found = list(hard_negatives.best(x, np.arange(8), q, np.ones((1, 8), bool), [(0, low, 663963986038946688)], 5))
    assert [(w, ids.tolist(), s.tolist()) for w, ids, s in found] == [(0, [2], [low])]


@pytest.mark.parametrize("share", [0.0, 0.2, 0.9])
def test_pruning_loses_no_pair(share):
    rng = np.random.default_rng(5)
    x, q = rng.integers(-200, 200, (300, 20)).astype(float), rng.integers(-200, 200, (40, 20)).astype(float)
    least = share * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    reach = (least / np.linalg.norm(q, axis=1)).min()
    index = hard_negatives.Postings(x, reach)
    allowed = rng.random((40, 300)) < 0.7
    pairs = set(zip(*(a.tolist() for a in index.candidates(q, least, allowed))))
    want = set(zip(*(a.tolist() for a in np.nonzero(allowed & (q @ x.T >= least[:, None])))))
    assert want <= pairs
    if share == 0.9:
        assert sum(index.lengths) < x.size  # tails are left out


def simhash(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    some = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in some]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def reachable(fps, bits):
    """Brute force: the root of each fingerprint's component."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    some = sorted(root)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    return {f: find(f) for f in some}


@pytest.mark.parametrize("limit", [1024, 2])
def test_simhash(docs, none, rows, limit):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_index.near_duplicates(docs, limit=limit).collect())
    fps = [simhash(t) for _, t in rows]
    root = reachable(fps, 2)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[root[f]] = min(low.get(root[f], 2**63), i)
    assert got == Counter((i, f"{f:016x}", low.get(root[f])) for (i, _), f in zip(rows, fps))
    assert len(set(root.values())) < len(root)  # some different fingerprints are linked
    assert simhash_index.near_duplicates(none).count() == 0


@pytest.mark.parametrize("limit", [60, 4])
def test_links_of_dense_fingerprints(spark, limit):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for base in list(fps)[:4]:
        chain = base
        for _ in range(150):
            chain ^= 1 << rng.randrange(64) if rng.random() < 0.8 else 0b101 << rng.randrange(62)
            fps.add(chain)
        fps |= {base ^ rng.getrandbits(16) for _ in range(300)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    found = simhash_index.links(spark.createDataFrame([(int(f),) for f in signed], "fp long"), limit).collect()
    root, place = reachable(fps, 2), {int(f): i for i, f in enumerate(signed)}
    got = simhash_index.forest(len(signed), np.array([place[r.a] for r in found]), np.array([place[r.b] for r in found]))
    groups = {}
    for f, g in zip(signed.view(np.uint64).tolist(), got.tolist()):
        groups.setdefault(root[f], set()).add(g)
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert len(found) < 3 * len(fps) * 6


def test_nearest_of_few_rows(spark):
    """Lengths of vectors keep tables of 2 to 300 rows apart in one run; each equals brute force, with a clashing column beside."""
    rng = np.random.default_rng(6)
    sizes = {3: 2, 4: 5, 5: 8, 6: 12, 7: 20, 8: 30, 9: 257}
    rows = [(100 * width + i, rng.normal(size=width)) for width, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in rows], "vec_id long, embedding array<double>, shard int, width string")
    got = {}
    for r in hash_forest.nearest(table, table.where("vec_id % 100 < 3"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, v in rows:
        if q % 100 < 3:
            near = sorted((np.sqrt(((w - v) ** 2).sum()), i) for i, w in rows if i != q and len(w) == len(v))[:10]
            assert sorted(got[q]) == [(k + 1, i) for k, (_, i) in enumerate(near)]


@pytest.mark.parametrize("sf", ["0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = hash_forest.nearest(table, table.where("vec_id % 100 = 0"), 10).collect()
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want |= {(ids[q], ids[i]) for i in [i for i in np.lexsort((ids, d)) if i != q][:10]}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_mixing_hands_clashing_columns_on(spark):
    rows = [(i, f"s{i % 3}", "word " * (i % 7), i, f"w{i}", 2.5, "t", "k") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, bound long, whole string, want double, target string, mix_key string")
    plain = mixing.mixed(docs.select("doc_id", "source", "text"), [3.0, 1.0], 1.5, 2.0)
    found = mixing.mixed(docs, [3.0, 1.0], 1.5, 2.0)
    assert found.columns == ["doc_id", "source", "text", "bound", "whole", "want", "mix_key", "size", "source_size", "target", "copies"]
    assert sorted((r.doc_id, r.target, r.copies) for r in found.collect()) == sorted((r.doc_id, r.target, r.copies) for r in plain.collect())
    assert all((r.bound, r.whole, r.want, r.mix_key) == (r.doc_id, f"w{r.doc_id}", 2.5, "k") for r in found.collect())


def area_under_curve(score, y):
    return np.mean([(a > b) + (a == b) / 2 for a in score[y == 1] for b in score[y == 0]])


def test_toxicity_of_few_labels_beats_naive_bayes(spark):
    """The given tables at sf0.01: 37 toxic documents teach, 14 are held out. The bar is the largest shrunk log-odds of a word."""
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    rows = table("documents").join(table("labels").where("toxic IN (0, 1)"), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    y, held = np.array([r.toxic for r in rows]), np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows])
    texts = [r.text or "" for r in rows]
    found = [set(re.findall(r"[^\x20\x09-\x0D]+", t.lower())) for t in texts]
    seen = [Counter(w for s, k, h in zip(found, y, held) if k == kind and not h for w in s) for kind in (0, 1)]
    n = [int(((y == k) & ~held).sum()) for k in (0, 1)]

    def odds(w):
        total = seen[0][w] + seen[1][w]
        return (math.log((seen[1][w] + 0.5) / (n[1] + 1)) - math.log((seen[0][w] + 0.5) / (n[0] + 1))) * total / (total + 3) if total >= 3 else 0.0

    bar = area_under_curve(np.array([max(map(odds, s), default=0.0) for s in found])[held], y[held])
    model = gated_recurrent.train([t for t, h in zip(texts, held) if not h], y[~held])
    score = model.scores(Texts.of(pa.array([t for t, h in zip(texts, held) if h])))
    assert area_under_curve(score, y[held]) > bar > 0.7
