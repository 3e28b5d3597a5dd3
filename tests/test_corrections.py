"""Consolidation of tracks and edits replayed in order, against hand-worked results and a replay in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import consolidation, edits as ed, groups, replay

ROWS = "movie_id long, frame long, track_id long, pos_x double, pos_y double, parent_id long, outcome string, continuous_label long"
PIXELS = "movie_id long, frame long, y long, x long, label long"


def block(label, frame, y, x, h, w, movie=0):
    return [(movie, frame, y + i, x + j, label) for i in range(h) for j in range(w)]


def consolidated(spark, rows, pixels, targets=((0, 1),)):
    rows = [(m, f, t, x, y, p, o, t) for m, f, t, x, y, p, o in rows]
    out, mask = consolidation.consolidated(spark.createDataFrame(rows, ROWS), spark.createDataFrame(pixels, PIXELS), spark.createDataFrame(list(targets), "movie_id long, track_id long"))
    got = {(r.movie_id, r.frame, r.track_id): (r.pos_x, r.pos_y, r.parent_id, r.outcome) for r in out.collect()}
    assert out.count() == len(got)
    assert all(r.continuous_label == r.track_id for r in out.collect())
    return got, {tuple(r) for r in mask.collect()}


def test_a_torn_label_goes_back_to_its_owner(spark):
    # frame 0: 1 lies on the small piece, 2 on the large one; frame 1: nobody else is there, the largest piece stays
    pixels = block(1, 0, 0, 0, 3, 3) + block(1, 0, 8, 8, 2, 2) + block(1, 1, 0, 0, 2, 2) + block(1, 1, 8, 8, 3, 3) + block(1, 1, 4, 4, 3, 3)
    rows = [(0, 0, 1, 8.9, 8.2, 7, "Exit"), (0, 0, 2, 1.0, 1.0, 7, "Mitosis"), (0, 1, 1, 0.0, 0.0, 7, "Exit"), (0, 1, 3, float("nan"), 4.0, -1, ""), (0, 1, 4, None, 4.0, -1, "")]
    got, mask = consolidated(spark, rows, pixels)
    assert got[0, 0, 1] == (1.0, 1.0, -1, "") and got[0, 0, 2] == (8.9, 8.2, -1, "")
    assert got[0, 1, 1] == (5.0, 5.0, 7, "Exit")
    assert mask == set(block(1, 0, 0, 0, 3, 3) + block(2, 0, 8, 8, 2, 2) + block(1, 1, 4, 4, 3, 3))


def test_absorbed_mothers_leave_their_daughters_to_the_track(spark):
    pixels = block(1, 0, 0, 0, 3, 3) + block(1, 2, 0, 0, 3, 3) + block(5, 3, 0, 0, 1, 3) + block(5, 1, 7, 7, 1, 1, movie=1)
    rows = [(0, 0, 1, 1.0, 1.0, 9, "Exit"), (0, 0, 5, -0.9, 2.9, 8, "Mitosis"), (0, 1, 5, 40.0, 40.0, 8, "Mitosis"), (0, 3, 6, 9.0, 9.0, 5, ""), (0, 3, 1, 30.0, 30.0, 5, "Exit"), (1, 0, 5, 1.0, 1.0, 3, "Mitosis"), (1, 1, 6, 1.0, 1.0, 5, "")]
    got, mask = consolidated(spark, rows, pixels)  # -0.9 is truncated to 0
    assert got[0, 0, 1] == (1.0, 1.0, 9, "Exit")  # where both have a row, its own stays
    assert got[0, 1, 1] == (40.0, 40.0, -1, "")  # an absorbed row without pixels
    assert got[0, 2, 1] == (1.0, 1.0, -1, "")  # a new row
    assert got[0, 3, 1] == (1.0, 0.0, -1, "Exit")  # once its own mother: nobody's daughter
    assert got[0, 3, 6] == (9.0, 9.0, 1, "")
    assert got[1, 0, 5] == (1.0, 1.0, 3, "Mitosis") and got[1, 1, 6] == (1.0, 1.0, 5, "")  # another movie
    assert len(got) == 7
    assert {r[-1] for r in mask if r[0] == 0} == {1} and {r[-1] for r in mask if r[0] == 1} == {5}


def test_targets_that_absorb_each_other_go_on_as_the_smallest(spark):
    pixels = block(4, 0, 0, 0, 2, 2) + block(3, 1, 0, 0, 2, 2) + block(2, 2, 0, 0, 2, 2)
    rows = [(0, 0, 3, 0.0, 0.0, -1, ""), (0, 0, 4, 1.0, 1.0, -1, ""), (0, 1, 2, 0.0, 0.0, -1, ""), (0, 2, 9, 0.0, 0.0, -1, "")]
    got, mask = consolidated(spark, rows, pixels, [(0, 4), (0, 3), (0, 2), (0, 77)])
    assert {k[2] for k in got} == {2} and {r[-1] for r in mask} == {2}


def test_clusters_of_a_long_chain(spark):
    chain = spark.range(300).select(F.lit(0).cast("long").alias("movie_id"), ((F.col("id") * 7) % 301).alias("a"), (((F.col("id") + 1) * 7) % 301).alias("b"))
    assert {r.root for r in groups.clusters(chain).collect()} == {0}
    assert groups.clusters(chain.limit(0)).count() == 0


class Movie:
    """The rules of the edits one by one: rows of [track, frame, parent, outcome] and pixels of (frame, label)."""

    def __init__(self, rows, labels):
        self.rows, self.labels = [list(r) for r in rows], list(labels)
        self.dissolve()

    def of(self, t):
        return [r for r in self.rows if r[0] == t]

    def first(self):
        out = {}
        for t, f, *_ in self.rows:
            out[t] = min(f, out.get(t, f))
        return out

    def links(self):
        return {(p, t) for t, _, p, _ in self.rows if p > 0}

    def parent(self, t):
        linked = [(f, p) for _, f, p, _ in self.of(t) if p > 0]
        return max(linked)[1] if linked else None

    def clear(self, mothers):
        for r in self.rows:
            if r[0] in mothers and r[3] == "Mitosis":
                r[3] = ""

    def dissolve(self):
        first = self.first()
        bad = {p for p, c in self.links() if p != c and (p not in first or first[c] <= first[p])}
        for r in self.rows:
            if r[2] in bad or r[2] == r[0]:
                r[2] = -1
        self.clear(bad)

    def flag(self, a, b, frame, flag):
        for r in self.of(a):
            r[3] = flag or ""

    def unlink(self, a, b, frame, flag):
        mothers = {r[2] for r in self.of(a) if r[2] > 0}
        for r in self.of(a):
            r[2] = -1
        self.clear(mothers - {p for p, _ in self.links()})

    def link(self, a, b, frame, flag):
        first = self.first()
        if a == b or a not in first or b not in first or sum(p == a for p, _ in self.links()) >= 2 or self.parent(b) not in (None, a) or first[b] <= first[a]:
            return
        for r in self.of(b):
            r[2] = a
        for r in self.of(a):
            r[3] = "Mitosis"

    def merge(self, a, b, frame, flag):
        if not self.of(a) or a == b:
            return
        pa, pb = self.parent(a), self.parent(b)
        mother = a if pb == a else b if pa == b else None
        if mother is None:
            heir = max((r[2] for r in self.of(b)), default=-1)
            for r in self.of(a):
                r[2] = heir
                r[0] = b
            for r in self.rows:
                if r[2] == a:
                    r[2] = -1 if r[0] == b else b
        else:
            grand = (pa if mother == a else pb) or -1
            grand = -1 if grand == b else grand
            sisters = {c for p, c in self.links() if p == mother and c != a}
            for r in self.rows:
                if r[0] in sisters or r[2] in (mother, a):
                    r[2] = -1
                r[0] = b if r[0] == a else r[0]
            for r in self.of(b):
                r[2] = grand
            self.clear({b})
        self.labels = [(f, b if x == a else x) for f, x in self.labels]
        self.dissolve()

    def swap(self, a, b, frame, flag, there=False):
        first, other = self.first(), {a: b, b: a}
        here = lambda f: f == frame if there else f >= frame
        for r in self.rows:
            if not there and r[2] in other and first[r[0]] >= frame:
                r[2] = other[r[2]]
        for r in self.rows:
            if r[0] in other and here(r[1]):
                r[0], r[2], r[3] = other[r[0]], -1, ""
        self.labels = [(f, other.get(x, x) if here(f) else x) for f, x in self.labels]
        self.dissolve()

    def swap_there(self, a, b, frame, flag):
        self.swap(a, b, frame, flag, True)

    def delete(self, a, b, frame, flag):
        self.drop(a, lambda f: True)

    def delete_there(self, a, b, frame, flag):
        self.drop(a, lambda f: f == frame)

    def drop(self, a, gone):
        had = bool(self.of(a))
        self.rows = [r for r in self.rows if not (r[0] == a and gone(r[1]))]
        self.labels = [(f, x) for f, x in self.labels if not (x == a and gone(f))]
        if had and not self.of(a):
            for r in self.rows:
                r[2] = -1 if r[2] == a else r[2]
        self.dissolve()


EDITS = "movie_id long, seq long, kind string, a long, b long, frame long, flag string"
SPARSE = "movie_id long, track_id long, frame long, parent_id long, outcome string"


def replayed(spark, movies, edits):
    """Rows and labels of all movies by Spark and by plain Python, and the number of levels."""
    rows = [(m, t, f, p, o) for m, found in movies.items() for t, f, p, o in found]
    labels = [(m, f, 0, 0, t) for m, t, f, _, _ in rows]
    df, mask, table = spark.createDataFrame(rows, SPARSE), spark.createDataFrame(labels, PIXELS), spark.createDataFrame(edits, EDITS)
    out, pix = replay.replayed(df, mask, table)
    got = sorted((r.movie_id, r.track_id, r.frame, r.parent_id, r.outcome) for r in out.collect()), sorted((r.movie_id, r.frame, r.label) for r in pix.collect())
    want_rows, want_labels = [], []
    for m, found in movies.items():
        movie = Movie(found, [(f, t) for t, f, _, _ in found])
        for _, _, kind, a, b, frame, flag in sorted(e for e in edits if e[0] == m):
            getattr(movie, kind)(a, b, frame, flag)
        want_rows += [(m, *r) for r in movie.rows]
        want_labels += [(m, f, x) for f, x in movie.labels]
    return got, (sorted(want_rows), sorted(want_labels)), replay.levels(df, table).agg(F.max("level")).first()[0]


def test_merges_chain(spark):
    rows = [(t, f, -1, "") for t in (1, 2, 3, 8) for f in range(t * 3, t * 3 + 3)] + [(4, 20, 1, ""), (5, 30, 8, "")]
    edits = [(0, 7, "merge", 1, 2, None, None), (0, 9, "merge", 2, 3, None, None), (0, 3, "merge", 8, 9, None, None), (0, 11, "merge", 1, 8, None, None)]
    got, want, levels = replayed(spark, {0: rows}, edits)
    assert got == want and levels == 4  # the last one finds no track 1
    assert {r[1] for r in got[0]} == {3, 4, 5, 9}


@pytest.mark.parametrize("seed", [1])
def test_mixed_edits_equal_a_replay_one_by_one(spark, seed):
    rng = random.Random(seed)
    movies, edits = {}, []
    for m in (0, 1):
        rows = []
        for family in range(150):
            mother = family * 4 + 1
            rows += [(mother, f, -1, "Mitosis") for f in range(4)]
            for child in range(1, rng.randint(1, 4)):
                rows += [(mother + child, f, mother if rng.random() < 0.9 else -1, rng.choice(["", "Exit", "Mitosis"])) for f in range(4 if rng.random() < 0.9 else 0, 8)]
        movies[m] = rows
        tracks = sorted({r[0] for r in rows})
        for seq in range(100):
            a = rng.choice(tracks)
            near = [t for t in tracks if (t - 1) // 4 == (a - 1) // 4]
            b = rng.choice(near)
            kind = rng.choice(["flag", "unlink", "link", "merge", "swap", "swap_there", "delete", "delete_there"])
            edits.append((m, 3 * seq, kind, a, b if kind in ("link", "merge", "swap", "swap_there") and a != b else None if kind not in ("link", "merge", "swap", "swap_there") else a + 1, rng.randint(0, 8), rng.choice(["Exit", None])))
    got, want, levels = replayed(spark, movies, edits)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert 2 < levels < 9


@pytest.mark.parametrize("seed", [3])
def test_edits_see_other_mothers_and_sisters(spark, seed):
    """Tracks with several mothers over time, in long lines: an edit must not touch what lies beyond its relatives."""
    rng = random.Random(seed)
    movies, edits = {}, []
    for m in (0, 1):
        rows = [(t, f, rng.choice([-1, *range(max(1, t - 5), t)]), rng.choice(["", "Mitosis"])) for t in range(1, 121) for f in range(t // 2, t // 2 + 4)]
        movies[m] = rows
        for seq in range(12):
            a = rng.randint(1, 120)
            kind = rng.choice(["flag", "unlink", "link", "merge", "swap", "swap_there", "delete", "delete_there"])
            b = max(1, a + rng.choice([-4, -1, 1, 3])) if kind in ("link", "merge", "swap", "swap_there") else None
            edits.append((m, seq, kind, a, b, a // 2 + rng.randint(0, 3), rng.choice(["Exit", None])))
    got, want, _ = replayed(spark, movies, edits)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_edits_write_only_rows_of_their_relatives(spark, monkeypatch):
    written = []
    kept = replay.stored
    monkeypatch.setattr(replay, "stored", lambda df, name: (lambda out: (written.append((name, out.count())), out)[1])(kept(df, name)))
    rows = [(t, f, -1, "") for t in range(1, 301) for f in range(5)] + [(t, f, t - 400, "") for t in range(401, 421) for f in range(10, 12)]
    edits = [(0, 1, "merge", 1, 2, None, None), (0, 2, "flag", 2, None, None, "Exit"), (0, 3, "delete", 2, None, None, None), (0, 4, "unlink", 403, None, None, None)]
    got, want, levels = replayed(spark, {0: rows}, edits)
    assert got == want and levels == 3
    tables = sum(n for name, n in written if n >= len(rows) // 2)
    assert tables == 3 * len(rows)  # the observations as given and without invalid divisions, and the pixels; before, each edit wrote one or both again


def test_tracks_without_a_mother_do_not_meet_in_one_task(spark):
    rows = [(0, 5, 3, -1, ""), (0, 6, 3, 5, ""), (0, 7, 9, 5, ""), (0, -5, 1, -1, "Exit"), (0, None, 1, -1, "Exit"), (0, 8, 1, -1, "Mitosis"), (0, 9, 2, 8, ""), (0, 10, 2, 99, ""), (0, 11, 2, 11, ""), (0, 12, 2, 0, "")]
    out = ed.dissolve_invalid(spark.createDataFrame(rows, SPARSE))
    got = {r.track_id: (r.parent_id, r.outcome) for r in out.collect()}
    assert got == {5: (-1, ""), 6: (-1, ""), 7: (-1, ""), -5: (-1, "Exit"), None: (-1, "Exit"), 8: (-1, "Mitosis"), 9: (8, ""), 10: (-1, ""), 11: (-1, ""), 12: (0, "")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(movie_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(movie_id" in x and ", parent_id#" in x.split("hashpartitioning")[1]]
