import random
import zlib

import numpy as np

from tidemark.llm import quality


def corpus(n=400):
    rng = random.Random(4)
    good = ["the", "river", "was", "calm", "and", "we", "rowed", "over", "to", "mill"]
    rows = []
    for i in range(n):
        y = i % 2
        words = [rng.choice(good) + ("" if y else rng.choice("#$%&") * 3) for _ in range(rng.randint(20, 300))]
        rows.append((i, " ".join(words), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(None, None, "x", 0.1), (9001, "", "y", 0.1), (9002, "#$%& " * 40000, "y", 0.2), (7, "again", "z", 0.2)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*truth, 9001, 9002] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    scored = [r for r in held if r["doc_id"] in truth and truth[r["doc_id"]] == r["predicted"]]
    assert len(scored) >= 0.97 * sum(r["doc_id"] in truth for r in held)
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect() if r["doc_id"] != 7}
    assert all(again[r["doc_id"]] == r["score"] for r in got if r["doc_id"] != 7)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 0


def test_gradients_match_differences():
    texts = [t.encode() for _, t, _ in corpus(6)] + [b"", b"a" * 1500]
    chunks, counts = quality.chunked(texts)
    y = np.array([0, 1, 0, 1, 0, 1, 1, 0], np.float32)
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.gradients(chunks, counts, y)

    def loss():
        p = net.score(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    rng = np.random.default_rng(0)
    for k in net.p:
        flat, gf = net.p[k].reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in [int(np.abs(gf).argmax()), *rng.integers(0, len(flat), 2)]:
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - gf[i]) < 1e-3 * max(1, abs(gf[i])), k


def test_chunks_cover_every_window():
    for n in (0, 5, 512, 513, 1019, 5000):
        s = quality.chunk_starts(n)
        covered = {p for a in s for p in range(a, a + quality.CHUNK - quality.WIDTH + 1)}
        assert covered >= set(range(max(0, n - quality.WIDTH + 1)))


def test_long_texts_are_learnt_block_by_block(monkeypatch):
    """Gradients are the same however many chunks are convolved at once, and texts of any length count."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (200_000, 10, 5_000)]
    chunks, counts = quality.chunked(texts)
    made = []
    for block in (7, 1 << 20):
        monkeypatch.setattr(quality, "LEARN_BLOCK", block)
        made.append(quality.Network().gradients(chunks, counts, np.array([1, 0, 1], np.float32)))
    for k, g in made[0].items():
        assert np.array_equal(g, made[1][k]), k
