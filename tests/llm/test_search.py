import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in counts) + 1))) for t in want}
        scored = []
        for d, c, n in counts:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in want if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeñ0") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    pick = lambda n: " ".join(words[min(149, int(rng.expovariate(0.03)))] for _ in range(n))
    docs = [(i, pick(rng.randint(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [docs[5]] * 3
    docs += [(None, docs[7][1]), (None, None), (2000, None), (2001, ""), (2002, "-- ,."), (2003, "Abc ABC a-b " * 20000)]
    items = [(i, pick(20)) for i in range(12)] + [(20, docs[3][1]), (21, None), (22, ""), (23, "unheard Ofterms"), (None, pick(5)), (0, "abc"), (24, words[0])]
    return docs, items


@pytest.mark.parametrize("k,block,cells,round_terms", [(50, 16, 1 << 23, 20000), (5, 3, 5000, 20000), (1, 1, 1, 40)])
def test_against_brute_force(spark, k, block, cells, round_terms):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, 1, 2.0) for r in docs], "doc_id long, text string, score int, item_id double")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = search.search(d, q, k=k, block=block, cells=cells, round_terms=round_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, k)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(docs, items).count() == 0
    assert search.search(items.select("item_id", "text"), items.limit(0), id_col="item_id").count() == 0


def test_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        ids = np.sort(rng.choice(40, 8, replace=False)) + 40 * (i % 10)  # ten kinds of documents
        rows.append((i, 30, ids.astype(np.int32), rng.integers(1, 4, 8)))
    shard = search.Shard(pd.DataFrame(rows, columns=["doc_id", "n", "ids", "tfs"]).astype({"doc_id": "Int64"}), rng.integers(1, 9000, 400), 400, 12000, 16)
    every = np.arange(400)
    for t in range(0, 400, 37):
        p = search.Postings(shard.vectors, shard.labels, t, every, 16)
        if len(p.docs):
            scores = shard.weights @ shard.vectors.astype(np.int64)
            for b, bound in enumerate(p.bounds(every, shard.weights)):
                assert (scores[p.docs[p.starts[b] : p.ends[b]]] <= bound).all() and p.ends[b] - p.starts[b] <= 16
    looked = []
    item = search.Item(list(range(0, 40, 3)), 3)
    offer = item.offer
    item.offer = lambda s, n, i: (looked.extend(i), offer(s, n, i))
    shard.search(item, {t: item.terms for t in item.terms.tolist()})
    assert 0 < len(looked) < 40 and len(set(looked)) == len(looked)
