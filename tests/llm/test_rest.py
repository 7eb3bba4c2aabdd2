"""Mixing, BPE, repetition rules, licences, neighbours and perspectives on small fixtures."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe, licences, mixing, neighbours, perspectives, repetition

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def brute_mix(rows):
    size = lambda t: len((t or "").encode().split())
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {n: sum(size(t) for _, t, s in rows if s == n) for n in names}
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, float(sum(total.values())), list(names)
    while open_:
        w = sum(weight[n] for n in open_)
        over = [n for n in open_ if weight[n] * left / w > 3 * total[n]]
        if not over:
            target |= {n: weight[n] * left / w for n in open_}
            break
        for n in over:
            target[n] = 3.0 * total[n]
        left -= sum(3 * total[n] for n in over)
        open_ = [n for n in open_ if n not in over]
    out = []
    for n in names:
        mine = sorted(((hashlib.md5((str(d) if d is not None else hashlib.md5((t or "").encode()).hexdigest()).encode()).hexdigest(), d is not None, d or 0, size(t)) for d, t, s in rows if s == n))
        epochs, rest = divmod(math.floor(target[n] + 1e-9), total[n]) if total[n] else (0, 0)
        for _, has, d, z in mine:
            part = max(0, min(z, rest))
            rest -= part
            out.append((d if has else None, z, total[n], round(target[n], 6), epochs * z + part))
    return sorted(out, key=repr)


def mix_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "a", "b", "c", "é", None])) for i in range(150)]
    return [*rows, (500, None, "a"), (501, "", None), (None, "x y\tz", "b"), (3, "twice the same id", "c"), (3, "twice the same id", "c"), (502, "", "empty source"), (503, "long " * 5000, "b")]


def test_mix(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, source string, size int, _source string")
    got = [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.mix(df).collect()]
    assert sorted(got, key=repr) == brute_mix(rows)
    drawn = mixing.draw(df.select("doc_id", "text", "source"))
    assert drawn.columns == ["doc_id", "text", "source"]
    taken = sum(r[4] for r in got)
    assert sum(len(r["text"].split()) for r in drawn.collect()) == taken
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.draw(empty).count() == 0


def tokens_of(text):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1024), (64, 16), (40, 3)])
def test_bpe(spark, chunk, overlap):
    rng = random.Random(2)
    texts = ["", None, "Hello world's  end \n\n x", " " * 300, "a" * 500, "日本語テキスト" * 30, "<|endoftext|> 12345 !!??", "é  \t\r\n'll 've"]
    texts += ["".join(rng.choice("ab 1\n'.,é  \t") for _ in range(400)) for _ in range(10)] + [texts[2], "word " * 20000]
    rows = [(i if i != 4 else None, t, 7) for i, t in enumerate(texts)] + [(None, "a" * 500, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"])) for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=overlap).collect()), key=repr)
    assert got == sorted(((i, *tokens_of(t)) for i, t, _ in rows), key=repr)
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_rules(text):
    words = (text or "").encode().split()
    n = len(words)

    def cover(m):
        seen = {}
        for i in range(n - m + 1):
            seen.setdefault(tuple(words[i : i + m]), []).append(i)
        return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + m)})

    longest = next((m for m in range(n, 0, -1) if len({tuple(words[i : i + m]) for i in range(n - m + 1)}) < n - m + 1), 0)
    lines = (text or "").split("\n")
    dup = sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines))
    rep = cover(8)
    failed = n < 20 or 100 * rep > 30 * n
    kept = not failed and 100 * cover(5) <= 35 * n and longest <= 50
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, rep, cover(5), longest, failed, kept


def test_repetition(spark):
    rng = random.Random(6)
    words = lambda k, n: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, k))) for _ in range(n))
    base = words(6, 60)
    texts = [None, "", " \n", "one", base, base + " " + base, base + "\n" + words(6, 300) + "\n" + base, words(1, 80), words(2, 200), "a b # $ | <x>\nline\nline\nline\n", "x " * 150, words(9, 400), "\x0b\x0c\tq"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (4, base)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    got = sorted((tuple(r) for r in repetition.repetition_rules(df).collect()), key=repr)
    assert got == sorted(((i, *brute_rules(t)) for i, t in rows), key=repr)
    assert repetition.repetition_rules(df.limit(0)).count() == 0
    assert repetition.repetition_rules(spark.createDataFrame([(1, "w%d " * 5000 % tuple(range(5000)))], "doc_id long, text string")).first()["longest_repeat"] == 0


def test_licences(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubcdmnrst") for _ in range(rng.randint(2, 8)))
    filler = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i, (family, templates) in enumerate(licences.TEMPLATES.items()):
        for j, t in enumerate(templates):
            rows.append((100 * i + j, f"{filler(40)}\n{t}\n{filler(20)}"))
            want[100 * i + j] = family
    plain = [(5000 + i, f"{filler(60)}\nthe licence of the {filler(3)}") for i in range(60)]
    odd = [(9000, None), (9001, ""), (None, "All rights reserved."), (9002, "MIT License. " + filler(20000)), (0, rows[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows + plain + odd], "doc_id long, text string, licences string")
    got = licences.scan(df).collect()
    found = {r["doc_id"]: r["licences"] for r in got}
    assert len(got) == len(rows) + len(plain) + len(odd)
    assert all(found[d] == "" for d, _ in plain) and found[9000] == found[9001] == ""
    assert sum(found[d] == f for d, f in want.items()) >= 0.95 * len(want)
    assert found[None] == "proprietary"
    assert licences.scan(df.limit(0)).count() == 0


def brute_near(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 5 == 0:
            scored = sorted(((-float(w @ v), i) for i, w in ok if i != q))[:k]
            out[q] = [i for _, i in scored]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours(spark, scale, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 150)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)) * (rng.uniform(0.5, 2, (600, 1)) if scale else 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[10] = (10, rows[11][1])
    odd = [(1000, None), (1005, [0.0] * 16), (1010, [float("nan")] * 16), (1015, [1.0] * 3), (1020, [None] * 16), (1025, [float("inf")] * 16), (None, rows[0][1]), (1030, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(df, lambda i: i % 5 == 0).collect()
    want = brute_near(rows + odd, 20)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want)
    vec = dict(rows)
    for q, found in by.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(s - float(np.dot(vec[q], vec[i]))) < 1e-9 for _, i, s in found)
    hits = sum(len(set(want[q]) & {i for _, i, _ in found}) for q, found in by.items())
    assert hits >= 0.9 * 20 * len(want)
    few = spark.createDataFrame(rows[:4] + [(4, rows[1][1])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"]) for r in neighbours.nearest(few, lambda i: i == 0).collect()] == [(0, k) for k in range(1, 5)]
    assert neighbours.nearest(df.limit(0), lambda i: i % 5 == 0).count() == 0


def test_repeated_queries(spark):
    """A query row that is repeated asks once; another vector under its id has ranks of its own."""
    x = np.random.default_rng(5).normal(size=(120, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    twice = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in neighbours.nearest(twice, lambda i: i == 0).collect()]
    want = sorted(range(1, 120), key=lambda i: (-float(x[i] @ x[0]), i))[:20]
    assert sorted(r for r, _ in got) == list(range(1, 21)) and len({i for _, i in got}) == 20
    assert len({i for _, i in got} & set(want)) >= 18
    other = spark.createDataFrame([*rows, (0, rows[7][1])], "vec_id long, embedding array<double>")
    ranks = sorted(r["rank"] for r in neighbours.nearest(other, lambda i: i == 0).collect())
    assert ranks == sorted([*range(1, 21)] * 2)


def brute_perspectives(rows):
    """Rows without null turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2] or ""))
        for me in {r for _, r, _ in said if r not in (None, "system")}:
            text, spans = "", []
            for _, role, words in said:
                text += "<|assistant|>\n" if role == me else "<|system|>\n" if role == "system" else f"<|user name={role or 'unknown'}|>\n"
                begin = len(text)
                text += (words or "") + "<|end|>\n"
                if role == me:
                    spans.append(f"{begin}-{len(text)}")
            out[conv, me] = (len(said), len(spans), text, ",".join(spans))
    return out


def test_perspectives(spark):
    rng = random.Random(4)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "ho"), (1, 2, "bob", "ho"), (1, 2, "ann", "tie"), (1, 3, None, None), (1, 300, "bob", "late"), (2, 0, "system", "alone"), (3, 0, "ann", "long " * 20000)]
    rows += [(4, i, "system" if i == 0 else rng.choice(["ann", "bob"]), f"turn {i}") for i in range(600)]
    df = spark.createDataFrame([(*r, "c") for r in [*rows, (None, 0, "ann", "x"), (None, 0, "bob", "y"), (5, 1, "ann", "a"), (5, None, "bob", "b"), (5, None, "ann", "c")]], "conv_id long, turn long, role string, text string, rendered string")
    every = perspectives.rotate(df).collect()
    got = {(r["conv_id"], r["perspective"]): (r["n_turns"], r["n_trained"], r["rendered"], r["spans"]) for r in every}
    assert len(every) == len(got)
    assert {k: v for k, v in got.items() if k[0] not in (None, 5)} == brute_perspectives(rows)
    assert got[None, "ann"] == (1, 1, "<|assistant|>\nx<|end|>\n", "14-23") and got[None, "bob"][0] == 1
    assert got[5, "ann"][:2] == (3, 2) and got[5, "ann"][2].startswith("<|assistant|>\na<|end|>\n")
    assert perspectives.rotate(df.limit(0)).count() == 0
