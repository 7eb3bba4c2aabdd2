import random

import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components


def brute(rows):
    def fp(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and group[i] != group[j]:
                    low = min(group[i], group[j])
                    group[i] = group[j] = low
                    changed = True
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    rows = []
    for k in range(12):
        base = [word() for _ in range(120)]
        for _ in range(4):
            rows.append((len(rows), " ".join(base)))
            base[rng.randrange(120)] = word()
    return rows + [(100, None), (101, ""), (102, "  \n"), (103, "One"), (104, "one"), (105, "two words"), (106, "naïve Ünïcode words é"), (None, "one"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (200, "zz " * 30000)]


@pytest.mark.parametrize("agree,tile", [(1, 4096), (2, 4096), (1, 2)])
def test_against_brute_force(spark, agree, tile):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, _fp string, root int")
    got = simhash.near_duplicates(df, agree=agree, tile=tile)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masks_find_every_link():
    rng = random.Random(1)
    for agree in (1, 2, 3):
        kinds = simhash.masks(3, agree)
        for _ in range(2000):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 3):
                b ^= 1 << bit
            assert any(a & m == b & m for m in kinds)


def test_tree_matches_scan():
    rng = random.Random(2)
    values = list({rng.getrandbits(64) & 0xFFFF0000FFFF for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert {values[i] for i in tree.within(v ^ 5, 8)} == {w for w in values if bin(w ^ v ^ 5).count("1") <= 8}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {(x, root(x)) for x in up if root(x) != x}
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {tuple(r) for r in got.collect()} == want
