import random

from pyspark.sql import functions as F

from tidemark.llm import lines


def shingles(line):
    """Every 9 UTF-16 units."""
    units = line.encode("utf-16-be")
    return {units[i : i + 18] for i in range(0, max(1, len(units) - 16), 2)}


def test_sketches_count_sets_and_differences(spark):
    """Sizes are of sets, not of sequences; shared shingles, however many, leave the bits of the others as they are."""
    rng = random.Random(4)
    made = []
    for n in (5, 9, 60, 500, 1500):
        base = "".join(rng.choice("abcdefgh ") for _ in range(n))
        made += [base, base[: n // 2] + "Z" + base[n // 2 + 1 :], base + base]
    made += ["-" * 400, "日本語の文章です。" * 40 + "\U0001f600"]
    texts = spark.createDataFrame(list(enumerate(made)), "_key long, _line string")
    got = {r["_key"]: r for r in lines.sketches(texts).collect()}
    assert {k: r["_n"] for k, r in got.items()} == {k: len(shingles(x)) for k, x in enumerate(made)}
    for a, x in enumerate(made):
        for b, y in enumerate(made[:a]):
            apart = sum(((got[a][f"_x{i}"] ^ got[b][f"_x{i}"]) & (2**64 - 1)).bit_count() for i in range(lines.SKETCH))
            different = len(shingles(x) ^ shingles(y))
            assert apart <= different and (different - apart) % 2 == 0
            if different <= 100:
                assert apart >= 0.8 * different


def test_similar_pairs(spark):
    """Exactly the pairs of at least SIMILARITY, each side's shingles with repeats counted once."""
    rng = random.Random(6)
    made = []
    for n in (30, 90, 200, 400):
        base = "".join(rng.choice("abcdefgh ") for _ in range(n))
        made += [base, base[: n // 2] + "Z" + base[n // 2 + 1 :], "Z" + base[1:-1] + "Z", base + base[-40:] * 3]
    texts = spark.createDataFrame(list(enumerate(made)), "_key long, _line string")
    n = lines.sketches(texts).select("_key", "_n")
    u, v = (texts.join(n, "_key").select(F.col("_key").alias(c), F.col("_line").alias(c + "_line"), F.col("_n").alias(c + "_n")) for c in "uv")
    got = {(r["u"], r["v"]) for r in lines.similar(u.join(v, F.col("u") > F.col("v")), "u", "v").collect()}
    sets = [shingles(x) for x in made]
    assert got == {(a, b) for a in range(len(made)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 4 <= len(got) < len(made) * (len(made) - 1) // 2
