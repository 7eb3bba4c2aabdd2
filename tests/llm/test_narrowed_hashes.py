import random

from pyspark.sql import functions as F

from tidemark.llm import lines


def test_narrowed_signatures_are_those_of_all_shingles(spark):
    """Lines of few and many shingles, and long ones of repeats, in whose narrowed hashes bins are missed."""
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (1, 9, 40, 80, 81, 200, 1000, 9000)]
    made += ["-" * 3000, "ab" * 2000, "".join(rng.choice("xyz") for _ in range(150)) * 40, "日本語の文章です。" * 90]
    df = spark.createDataFrame([(x,) for x in made], "_line string").select(F.xxhash64("_line").alias("_key"), "_line")
    least = [f"_m{i}" for i in range(lines.BINS)]
    whole = {r["_key"]: r for r in lines.least_hashes(df, None).collect()}
    first = {r["_key"]: r for r in lines.least_hashes(df, lines.NARROWED).collect()}
    assert len(whole) == len(first) == len(made)
    assert any(first[k][m] != whole[k][m] for k in whole for m in least)
    assert all(first[k][m] == whole[k][m] for k in whole for m in least if first[k][m] is not None and first[k][m] <= first[k]["_top"])
    signed, held = lines.signatures(df)
    got = {tuple(r) for r in signed.collect()}
    lines.forget(*held)
    bands = [F.when(F.coalesce(*[f"_m{i}" for i in band]).isNotNull(), F.xxhash64(F.lit(k), *[f"_m{i}" for i in band])) for k, band in enumerate(lines.BANDS)]
    assert got == {tuple(r) for r in lines.least_hashes(df, None).select("_key", *bands).collect()}
