import random

from pyspark.sql import functions as F

from tidemark.llm import lines


def shingles(line):
    """Every 9 UTF-16 units."""
    units = line.encode("utf-16-be")
    return {units[i : i + 18] for i in range(0, max(1, len(units) - 16), 2)}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def brute(rows):
    all_lines = {}
    for d, t in set(rows):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                all_lines.setdefault(line, []).append((d, i))
    names = sorted(all_lines)
    up = {x: x for x in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if root(a) != root(b) and similar(a, b):
                up[root(a)] = root(b)
    first = {}
    for x in names:
        for d, i in all_lines[x]:
            first[root(x)] = min(first.get(root(x), (float("inf"), 0)), (-1 if d is None else d, i))
    return {(d, i): first[root(x)] for x in names for d, i in all_lines[x]}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    made = []
    for _ in range(15):
        base = [word() for _ in range(rng.choice([4, 8, 30, 60]))]
        for _ in range(4):
            made.append(" ".join(base))
            base[rng.randrange(len(base))] = word()
    rng.shuffle(made)
    rows = [(i, "\n".join(made[3 * i : 3 * i + 3])) for i in range(20)]
    return [*rows, (50, None), (51, ""), (52, "\n \n\t"), (None, made[0]), (53, "ab"), (54, "ab\nab"), (55, "x" * 60000), (56, made[5] + "\n"), (3, rows[3][1]), (3, "another text of this id"), (57, "日本語の文章です。これは長い行です。\r")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, line_no int, kept string")
    got = lines.dedup_lines(df).collect()
    want = brute(rows)
    ids = {(r["doc_id"], r["line_no"]): (-1 if r["first_id"] is None else r["first_id"], r["first_line_no"]) for r in got if r["doc_id"] != 3}
    assert ids == {k: v for k, v in want.items() if k[0] != 3}
    for r in got:
        here = (-1 if r["doc_id"] is None else r["doc_id"], r["line_no"])
        assert r["kept"] == (here == (-1 if r["first_id"] is None else r["first_id"], r["first_line_no"])) or r["doc_id"] == 3


def test_clean(spark):
    rows = [(1, "the first line of all\nshared line with some words in it"), (2, "shared line with some words in it\n\nits own line"), (3, "shared line with some words in it"), (4, None), (5, "")]
    out = lines.clean(spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string"))
    assert out.columns == ["doc_id", "text", "source"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "\nits own line", 3: "", 4: None, 5: ""}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(df).count() == 0 and lines.clean(df).count() == 0


def test_large_bucket_without_its_links_at_the_pivots(spark, monkeypatch):
    """Many families in one bucket, and a drift chain that no pivot reaches as a whole."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    made = []
    for _ in range(15):
        base = [word() for _ in range(30)]
        made += [" ".join(base), " ".join([*base[:7], word(), *base[8:]])]
    base = [word() for _ in range(30)]
    for i in range(21):
        made.append(" ".join(base))
        base[i] = word()
    rng.shuffle(made)
    rows = list(enumerate(made))
    one = F.lit(1).cast("long").alias("_band")

    def buckets(signed):
        n = signed.count()
        shared = signed.select(one).distinct().withColumn("_n", F.lit(n).cast("long"))
        return lines.cut_lineage(signed.select("_key", one, F.lit(n).cast("long").alias("_n"))), lines.cut_lineage(shared)

    monkeypatch.setattr(lines, "buckets", buckets)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(set(want.values())) == 16
    for tile in (1024, 8):
        monkeypatch.setattr(lines, "TILE", tile, raising=False)
        assert {(r["doc_id"], r["line_no"]): (r["first_id"], r["first_line_no"]) for r in lines.dedup_lines(df).collect()} == want


def test_near_copies_by_characters(spark):
    """Near copies of many words that only shingles from every character hold similar, against brute force by these."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    made = []
    for _ in range(5):
        plain = [word(10) for _ in range(15)]
        urls = [f"https://example.org/{word(20)}/{word(9)}" for _ in range(14)]
        phrases = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(30)) for _ in range(12)]
        made += [" ".join(plain), " ".join([*plain[:6], "Z" + plain[6][1:], *plain[7:]])]
        made += [" ".join(urls), " ".join([urls[0] + "x", *urls[1:9], urls[9] + "y", *urls[10:]])]
        made += [" ".join(phrases), " ".join(["\U0001f600" + phrases[0][1:], *phrases[1:5], "z" + phrases[5][1:], *phrases[6:]])]
    made += ["-" * 300, "-" * 301, "=-" * 150]
    rows = list(enumerate(made))

    want = brute(rows)
    assert len(set(want.values())) == 17
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line_no"]): (r["first_id"], r["first_line_no"]) for r in got} == want


def test_drifting_families(spark):
    """Families of 25 lines, each line two words from the last: pivots alone don't hold them together."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    made = []
    for _ in range(12):
        base = [word() for _ in range(40)]
        for i in range(25):
            base[(2 * i) % 40], base[(2 * i + 1) % 40] = word(), word()
            made.append(" ".join(base))
    rng.shuffle(made)
    rows = list(enumerate(made))
    want = brute(rows)
    got = {r["doc_id"]: r["first_id"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    family = {d: first for (d, _), (first, _) in want.items()}
    assert len(set(family.values())) == 12 and all(family[got[d]] == family[d] for d in got)
    assert len(set(got.values())) <= 12 + 0.02 * len(made)  # what banding loses of 288 links of similarity 0.83


def test_recall_of_pairs(spark):
    """Of all pairs of lines that are similar by brute force, at least 0.9 are in one component; no others are joined."""
    rng = random.Random(33)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz     ")
    made = []
    for _ in range(150):
        base = [letter() for _ in range(rng.choice([30, 60, 120, 400]))]
        other = list(base)
        for _ in range(max(1, len(base) // 90)):
            other[rng.randrange(len(base))] = "Z"
        made += ["".join(base), "".join(other)]
    rows = list(enumerate(made))
    got = {r["doc_id"]: r["first_id"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(2 * i, 2 * i + 1) for i in range(150) if similar(made[2 * i], made[2 * i + 1])]
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) >= 80 and found >= 0.9 * len(pairs)
    assert all(got[i] >= i - i % 2 for i in got)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a line of some words here", 7, 8), (2, "a line of some words here", 7, 8)], "doc_id long, text string, _key int, _part int")
    assert {(r["doc_id"], r["first_id"]) for r in lines.dedup_lines(df).collect()} == {(1, 1), (2, 1)}
    assert lines.clean(df).columns == df.columns
