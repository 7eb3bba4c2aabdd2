import random
import re
from collections import Counter

import pytest

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    rows = [(lang or "", source or "", [lower(t) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, counts = Counter(), Counter()
        sources = {}
        for _, source, terms in (r for r in rows if r[0] == lang):
            docs.update(set(terms))
            counts.update(terms)
            sources.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in docs.items() if n >= 10]

        def prices(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: prices(c) for s, c in sources.items()}, prices(counts)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["It", "IT", "it's", "x1y", "İ"]
    rows = []
    for k in range(160):
        mine = words[k % 7 * 5 :]
        rows.append(("en" if k % 3 else "fr", f"s{k % 7}", " ".join(rng.choice(mine) for _ in range(40))))
    rows += [("en", None, "ab " * 20000), (None, "s1", None), (None, None, ""), ("de", "only", "nothing is kept here"), ("de", "other", ""), ("", "s2", "12 34")]
    return rows + [rows[0]] * 12


@pytest.mark.parametrize("block,tile", [(4096, 32), (7, 32), (16, 2), (5, 1)])
def test_against_brute_force(spark, block, tile):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "lang string, source string, text string, n int, term binary")
    got = divergence.audit(df, block=block, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_counts_drain_between_batches(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 1)
    import pandas as pd

    batch = pd.DataFrame({"lang": ["a", "a"], "source": ["s", "s"], "text": [b"One one two", b""]})
    found = pd.concat(divergence.count_terms(iter([batch, batch])))
    assert found.groupby("term")[["n", "docs"]].sum().to_dict("index") == {b"": {"n": 0, "docs": 0}, b"one": {"n": 4, "docs": 2}, b"two": {"n": 2, "docs": 2}}
