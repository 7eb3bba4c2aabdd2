import random
from collections import Counter

import corpus_pipeline
from tidemark.llm import quality

from .test_lines import brute as brute_lines
from .test_rest import brute_mix, tokens_of
from .test_simhash import brute as brute_simhash


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeiouhtnrs") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = line(15)
    rows = [(i, "\n".join([line(25), shared, line(40)] if i % 3 else [line(60)]), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(6)] + [(200 + i, rows[i][1].replace(" ", " x ", 1), "s1") for i in range(6)]
    rows += [(300 + i, " | ".join(["##" + word() for _ in range(50)]), "s2") for i in range(30)]
    return rows + [(400, None, "s0"), (401, "", None)]


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, int(not 300 <= d < 400)) for d, _, _ in rows if d % 5], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    net = quality.fit(docs, labels)
    stages = [f for _, f in corpus_pipeline.STAGES]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def step(k, df):
        out = stages[k](spark, df, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    plain = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    now = step(0, now)
    scores = net.score([(t or "").encode() for _, t, _ in rows])
    kept = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    assert Counter(plain(now)) == Counter(kept) and sum(300 <= d < 400 for d, _, _ in kept) < 5 and len(kept) > 60

    first = brute_lines([(d, t) for d, t, _ in kept])
    want = []
    for d, t, s in kept:
        lines = None if t is None else [x for i, x in enumerate(t.split("\n")) if first.get((d, i), (d, i)) == (d, i)]
        want.append((d, None if lines is None else "\n".join(lines), s))
    now = step(1, now)
    assert Counter(plain(now)) == Counter(want)

    comp = {d: c for d, _, c in brute_simhash([(d, t) for d, t, _ in want])}
    now = step(2, now)
    want = [r for r in want if comp[r[0]] == r[0]]
    assert Counter(plain(now)) == Counter(want)

    taken = {r[0]: r[4] for r in brute_mix(want)}
    now = step(3, now)
    got = Counter()
    for d, t, _ in plain(now):
        got[d] += len(t.split())
    assert got == Counter({d: n for d, n in taken.items() if n})

    want = Counter((d, *tokens_of(t)[:3]) for d, t, _ in plain(now))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in step(4, now).collect()) == want
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
