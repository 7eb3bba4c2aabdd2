"""Row patterns as set operations, against the row-by-row matcher on the same rows."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark import sqlfront
from tidemark.operators import match
from tidemark.operators.rowpattern import RowPattern, recognize

T0 = datetime(2024, 1, 1)


def history(seed, keys=4, n=60, step=40_000):
    rng = random.Random(seed)
    rows, at = [], {k: 0 for k in range(keys)}
    for i in range(keys * n):
        k = rng.choice([0, 0, 0, *range(keys)])
        at[k] += rng.choice([1, 5, step])
        rows.append((i, None if k == 1 else f"k{k}", T0 + timedelta(seconds=at[k]), rng.randint(0, 5), rng.choice("aabc")))
    return rows


def brute(rows, pattern, define, measures, after="PAST LAST ROW", within=None):
    out = []
    for key in {r[1] for r in rows}:
        mine = [dict(zip(("id", "k", "ts", "v", "c"), r, strict=True)) for r in rows if r[1] == key]
        mine.sort(key=lambda r: (r["ts"], r["id"]))
        for m in match.matches(mine, pattern, define, after, within):
            out.append((key, *[f(m) for f in measures]))
    return sorted(out, key=repr)


def back(m, name, n):
    """LAST(name.v, n) with the row under test counted, as in SQL."""
    found = m.of(name)
    return found[-1 - n]["v"] if len(found) > n else None


FIRST_LAST = ({"a": "FIRST(%s.id)", "z": "LAST(%s.id)", "n": "COUNT(*)"}, lambda a, z: [lambda m: m.of(a)[0]["id"], lambda m: m.of(z)[-1]["id"], lambda m: len(m.rows)])
CASES = [
    ("A+ B", {"A": "A.c IN ('a', 'b')", "B": "B.c <> 'a'"}, {"A": lambda m: m.row["c"] in "ab", "B": lambda m: m.row["c"] != "a"}, "A", "B", None),
    ("A B? C+", {"A": "A.c = 'a'", "B": "B.v > A.v", "C": "C.v >= LAST(C.v, 1) OR LAST(C.v, 1) IS NULL"}, {"A": lambda m: m.row["c"] == "a", "B": lambda m: m.row["v"] > m.last("A", "v"), "C": lambda m: back(m, "C", 1) is None or m.row["v"] >= back(m, "C", 1)}, "A", "C", None),
    (
        "S D+ U", {"D": "(LAST(D.v, 1) IS NULL AND D.v < S.v) OR D.v < LAST(D.v, 1)", "U": "U.v > LAST(D.v, 1)"},
        {"D": lambda m: m.row["v"] < (back(m, "D", 1) if back(m, "D", 1) is not None else m.last("S", "v")), "U": lambda m: back(m, "D", 1) is not None and m.row["v"] > back(m, "D", 1)}, "S", "U", None,
    ),
    ("A B", {"A": "true", "B": "B.c <> A.c"}, {"B": lambda m: m.row["c"] != m.last("A", "c")}, "A", "B", ("INTERVAL '5' SECOND", timedelta(seconds=5))),
    ("A{2,3} B*  C", {"A": "A.v < 4", "B": "B.c = 'a'", "C": "C.v > FIRST(A.v) AND C.c <> 'x.y'"}, {"A": lambda m: m.row["v"] < 4, "B": lambda m: m.row["c"] == "a", "C": lambda m: m.row["v"] > m.first("A", "v")}, "A", "C", None),
]


@pytest.mark.parametrize("case", [0, 1, 2, 3])
@pytest.mark.parametrize("after", ["PAST LAST ROW", "TO NEXT ROW", "TO LAST {z}", "TO FIRST {z}"])
def test_against_the_matcher(spark, case, after):
    pattern, define, tests, a, z, within = CASES[case]
    after, rows = after.format(z=z), history(case)
    df = spark.createDataFrame([(*r[:3], r[3], r[4]) for r in rows], "id long, k string, ts timestamp, v int, c string")
    measures = {"a": f"FIRST({a}.id)", "z": f"{z}.id", "n": "COUNT(*)"}
    spec = RowPattern(["k"], ["ts", "id"], pattern, define, measures, after, within and within[0])
    got = sorted((tuple(r) for r in recognize(df, spec, slice_s=36_000).collect()), key=repr)
    want = brute(rows, pattern, tests, FIRST_LAST[1](a, z), after, within and ("ts", within[1]))
    assert got == want and len(want) > 3


def test_far_references_stop_the_query(spark):
    pattern, define, tests, a, z, _ = CASES[4]
    df = spark.createDataFrame(history(9), "id long, k string, ts timestamp, v int, c string")
    with pytest.raises(Exception, match="no fixed distance"):
        recognize(df, RowPattern(["k"], ["ts", "id"], pattern, define, {"a": "A.id"})).collect()


def test_clauses_from_sql(spark):
    rows = history(5)
    spark.createDataFrame(rows, "id long, k string, ts timestamp, v int, c string").createOrReplaceTempView("hist")
    got = sqlfront.sql(
        spark,
        """SELECT k, total, mean, hours FROM hist MATCH_RECOGNIZE (
             PARTITION BY k ORDER BY ts, id
             MEASURES SUM(A.v * 2) AS total, AVG(A.v) + MAX(B.v) AS mean, AVG(TIMESTAMPDIFF(HOUR, A.ts, A.ts + INTERVAL 3 HOURS)) AS hours
             ONE ROW PER MATCH AFTER MATCH SKIP PAST LAST ROW
             -- one or more, then another
             PATTERN (A+ B) DEFINE A AS A.c = 'a', B AS B.c = 'b'
           ) AS m WHERE total > 2""",
    )
    tests = {"A": lambda m: m.row["c"] == "a", "B": lambda m: m.row["c"] == "b"}
    want = brute(rows, "A+ B", tests, [lambda m: 2.0 * sum(r["v"] for r in m.of("A")), lambda m: m.mean("A", lambda r: r["v"]) + m.last("B", "v"), lambda m: 3.0])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [w for w in want if w[1] > 2]


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "id long, k string, ts timestamp, v int, c string")
    out = recognize(df, RowPattern(["k"], ["ts"], *CASES[0][:2], {"a": "A.id"}))
    assert out.count() == 0 and out.columns == ["k", "a"]
    assert "Python" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("bad", [dict(pattern="A B A"), dict(pattern="A* B*"), dict(after="TO LAST C"), dict(define={"A": "X.v > 1"}), dict(pattern="A{2,40} B")])
def test_what_is_refused(spark, bad):
    df = spark.createDataFrame([], "id long, k string, ts timestamp, v int, c string")
    spec = dict(pattern="A+ B", define={"A": "A.v > 1"}, measures={"a": "A.id"}) | bad
    with pytest.raises(ValueError):
        recognize(df, RowPattern(["k"], ["ts"], **spec))
