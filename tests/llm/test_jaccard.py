import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import jaccard


def brute(rows, percent=90):
    def shingles(text):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (text or "").split()]
        return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows = []
    for n in (1, 2, 3, 4, 5, 9, 12, 20, 35, 60, 110, 200, 700):
        base = [word() for _ in range(n)]
        for k in range(8):  # a drifting family, alike step by step, and stretched copies
            rows.append((len(rows), " ".join(base)))
            if k % 2 and n > 20:
                base = base + [word() for _ in range(n // 25)]
            else:
                base[rng.randrange(n)] = word()
    many = [word() for _ in range(80)]
    for _ in range(60):
        now = list(many)
        now[rng.randrange(80)] = word()
        rows.append((len(rows), " ".join(now)))
    template = [word() for _ in range(40)]
    rows += [(len(rows) + i, " ".join([word() for _ in range(rng.randint(1, 12))] + template)) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, rows[70][1].upper()), (None, rows[71][1]), (None, None), (5, rows[5][1]), (5, rows[90][1]), (1004, "zz " * 30000), (1005, "zz zz"), (None, "nobody else says this")]
    return rows


@pytest.mark.parametrize("tile,heads,remembered", [(4096, 256, 500_000), (7, 2, 10)])
def test_against_brute_force(spark, monkeypatch, tile, heads, remembered):
    monkeypatch.setattr(jaccard, "HEADS", heads)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, _class string, rep int, size int")
    got = jaccard.jaccard_classes(df, tile=tile)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_lower_similarity(spark):
    rows = corpus()[:160]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 80)


def test_empty(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_shard():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        take, more = int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
        b = np.unique(np.r_[a[take:], rng.integers(0, 1 << 63, more).astype(np.uint64)])
        a = np.unique(a)
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 90 * (len(a) + len(b) - same):
            assert np.intersect1d(jaccard.shard_keys(a, 90), jaccard.shard_keys(b, 90)).size
            n = min(len(jaccard.point(a)), len(jaccard.point(b)))
            assert jaccard.enough(np.minimum(jaccard.coarse(jaccard.point(a), n), jaccard.coarse(jaccard.point(b), n)).sum(), len(a) + len(b), 90)


def test_tree_finds_what_the_bound_lets_through():
    rng = np.random.default_rng(3)
    base = rng.poisson(rng.integers(2, 30, (40, 1)), (40, jaccard.GROUPS))
    points = np.maximum(0, np.repeat(base, 25, axis=0) + rng.integers(-1, 2, (1000, jaccard.GROUPS))).astype(np.int64)
    sizes = np.maximum(1, points.sum(axis=1))
    tree = jaccard.CountTree(points, sizes)
    got = set(zip(*(x.tolist() for x in tree.within(points, sizes, 90)), strict=True))
    want = {(i, j) for i in range(1000) for j in np.flatnonzero(jaccard.enough(np.minimum(points[i], points).sum(axis=1), sizes[i] + sizes, 90)).tolist()}
    assert got == want and len(want) < 1000 * 200


def test_finer_points_add_up():
    h = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 5000).astype(np.uint64))
    fine = jaccard.point(h)
    assert len(fine) == 2048 and fine.sum() == len(h) and len(jaccard.point(h[:100])) == 32
    assert (jaccard.coarse(fine, 32) == fine.reshape(32, 64).sum(axis=1)).all()
    fine[3] = jaccard.MOST
    assert jaccard.coarse(fine, 32)[0] == jaccard.UNBOUNDED


def test_members_keep_components_apart():
    rows = pd.DataFrame({"shard": 1, "i": 0, "j": 0, "rep": range(40), "part": 0, "root": [0] * 38 + [38, 39], "size": 32, "point": [np.ones(jaccard.GROUPS, np.uint16).tobytes()] * 40})
    m = jaccard.Members(rows)
    assert len(np.unique(m.tree(0, 40, 90, False), axis=0)) == 38 * 2 + 1
    first = m.one_leaf(np.array([0]), np.array([40]), 90, True)
    assert sorted(map(tuple, first.tolist())) == [(38, 0), (39, 0)]
