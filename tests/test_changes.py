"""Keyed change streams and star joins."""

import os
from datetime import datetime, timedelta

import pytest

from tidemark.operators.joins import VersionedTable, star_join
from tidemark.sources import changes
from tidemark.streaming.run import stepwise
from tidemark.streaming.star import Dimension, Role, assembled, resolved

T0 = datetime(2024, 1, 1)


def sec(n):
    return T0 + timedelta(seconds=n)


def test_records_come_back(spark):
    rows = spark.createDataFrame([(1, "a", 2.5, False), (2, None, None, False), (3, "c", 1.0, True)], "k long, name string, v double, gone boolean")
    for raw in (True, False):
        records = changes.encoded(rows, ["k"], deleted="gone", raw_key=raw)
        assert records.where("value is null").count() == 1
        back = changes.decoded(records, "k long", "name string, v double", raw_key="k" if raw else None)
        assert sorted(tuple(r) for r in back.collect()) == [(1, False, "a", 2.5), (2, False, None, None), (3, True, None, None)]
    assert changes.decoded(spark.createDataFrame([(None, "{}")], "key string, value string"), "k long", "v int").count() == 0
    with pytest.raises(ValueError):
        changes.encoded(rows, ["k", "name"], raw_key=True)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string, n long"
    keep = changes.bucketed_upsert(path, ["k"], ["n"], buckets=8)
    batch = lambda *rows: spark.createDataFrame(rows, schema + ", deleted boolean")
    table = lambda: sorted((r["k"], r["v"]) for r in changes.read_bucketed(spark, path, schema).collect())
    assert table() == []
    keep(batch(*[(k, "a", 1, False) for k in range(40)]), 0)
    before = {d: sorted(os.listdir(f"{path}/epoch=0/{d}")) for d in os.listdir(f"{path}/epoch=0") if d.startswith("bucket")}
    change = batch((3, "b", 2, False), (3, "c", 3, False), (5, None, 4, True), (99, "new", 5, False), (98, None, 6, True))
    want = sorted([(k, "a") for k in range(40) if k not in (3, 5)] + [(3, "c"), (99, "new")])
    keep(change, 1)
    assert table() == want
    keep(change, 1)  # the batch runs again
    assert table() == want
    written = [d for d in os.listdir(f"{path}/epoch=1") if d.startswith("bucket")]
    assert 0 < len(written) <= 4 and all(sorted(os.listdir(f"{path}/epoch=0/{d}")) == files for d, files in before.items())
    keep(batch(*[(k, None, 7, True) for k in [*range(40), 99]]), 2)
    assert table() == []
    keep(batch((1, "z", 8, False)), 3)
    assert table() == [(1, "z")]
    keep(spark.createDataFrame([], schema + ", deleted boolean"), 4)
    assert table() == [(1, "z")]


def test_deletes_close_versions(spark):
    log = spark.createDataFrame([("a", sec(0), 1, False), ("a", sec(10), None, True), ("a", sec(20), 3, False), ("b", sec(5), None, True), ("c", sec(5), None, True), ("c", sec(5), 9, False)], "k string, at timestamp, v int, deleted boolean")
    left = spark.createDataFrame([(i, k, sec(s)) for i, (k, s) in enumerate([("a", 5), ("a", 10), ("a", 15), ("a", 25), ("b", 6), ("c", 6), (None, 1)])], "id int, k string, ts timestamp")
    for how, want in (("left", [(0, 1), (1, None), (2, None), (3, 3), (4, None), (5, 9), (6, None)]), ("inner", [(0, 1), (3, 3), (5, 9)])):
        got = changes.asof_changes(left, log, "k", "ts", key="k", change_ts="at", how=how, slice_s=7)
        assert sorted((r["id"], r["v"]) for r in got.collect()) == want


def star_data():
    facts = [(i, f"k{i % 3}", f"k{(i * 7) % 4}", sec(i * 5)) for i in range(40)]
    one = [(f"k{i % 3}", sec(i * 11), i, f"v{i}") for i in range(18)]
    two = [(f"k{i % 4}", sec(i * 17 + 3), float(i)) for i in range(11)]
    return facts, one, two


def brute_star(facts, one, two):
    last = lambda rows, k, t: max((r for r in rows if r[0] == k and r[1] <= t), key=lambda r: r[1], default=None)
    pick = lambda r, c: r[c] if r else None
    return sorted((i, pick(last(one, a, t), 3), pick(last(one, b, t), 3), pick(last(two, b, t), 2)) for i, a, b, t in facts)


def test_star_join_in_batch(spark):
    facts, one, two = star_data()
    f = spark.createDataFrame(facts, "id int, a string, b string, ts timestamp")
    d1, d2 = spark.createDataFrame(one, "k string, at timestamp, n int, v string"), spark.createDataFrame(two, "k string, at timestamp, w double")
    roles = {"a": (VersionedTable(d1, "k", "at"), "a"), "b": (VersionedTable(d1, "k", "at"), "b"), "x": (VersionedTable(d2, "k", "at"), "b")}
    got = star_join(f, "ts", roles, slice_s=20).select("id", "a_v", "b_v", "x_w")
    assert sorted((tuple(r) for r in got.collect())) == brute_star(facts, one, two)


def test_star_join_of_streams(spark):
    facts, one, two = star_data()
    rows = [("f", i, a, b, ts, None, None) for i, a, b, ts in facts] + [("1", n, k, None, ts, v, None) for k, ts, n, v in one] + [("2", None, k, None, ts, None, w) for k, ts, w in two]
    rows += [("f", 99, None, "k1", sec(190), None, None), ("f", 100, "k0", None, None, None, None), ("2", None, "k9", None, sec(1000), None, 0.0)]
    schema = "kind string, id int, a string, b string, ts timestamp, v string, w double"

    def build(s):
        dims = {"one": Dimension(s.where("kind = '1'").selectExpr("a AS k", "ts", "id AS n", "v"), "k", "ts"), "two": Dimension(s.where("kind = '2'").selectExpr("a AS k", "ts", "w"), "k", "ts")}
        return resolved(s.where("kind = 'f'").select("id", "a", "b", "ts"), "ts", dims, {"a": Role("one", "a"), "b": Role("one", "b"), "x": Role("two", "b")}, delay_s=30)

    parts = [[r for r in rows if r[4] and lo <= (r[4] - T0).total_seconds() < hi] for lo, hi in ((0, 60), (60, 130), (130, 2000))]
    parts[1].append(parts[0].pop())  # one comes late, in time
    facts.append((77, "k1", "k2", sec(50)))  # waits at the watermark when the first step ends
    parts[0].append(("f", 77, "k1", "k2", sec(50), None, None))
    parts[0].append(("2", None, "k9", None, sec(80), None, 0.0))
    out = stepwise([spark.createDataFrame(p, schema) for p in parts], build)["out"]
    got = assembled(out, "id int, ts timestamp", {"a": "n int, v string", "b": "v string", "x": "w double"})
    assert {r["ts"] for r in got.collect()} >= {sec(0), sec(5)}
    want = brute_star([*facts, (99, None, "k1", sec(190))], one, two)
    assert sorted((r["id"], r["a"] and r["a"]["v"], r["b"] and r["b"]["v"], r["x"] and r["x"]["w"]) for r in got.collect()) == want
