"""Streams that arrive in steps: refiring windows, changelogs, sorting, aggregates, expiry, restart."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tidemark.operators.incremental import Held, LastReadings, WeightedMean, incremental, incremental_stream
from tidemark.sources.sinks import fold
from tidemark.streaming import processors as P
from tidemark.streaming.late import late_windows
from tidemark.streaming.order import in_order
from tidemark.streaming.run import shared_folder, stepwise
from tidemark.streaming.topn import top_counts

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, v double, d int"


def sec(n):
    return T0 + timedelta(seconds=n)


def steps(spark, *lists):
    return [spark.createDataFrame(x, SCHEMA) for x in lists]


def shuffled(n, late, seed=1):
    """Four steps of 100 seconds; some rows come one or two steps late."""
    rng = random.Random(seed)
    out = [[] for _ in range(4)]
    for i in range(n):
        at = rng.randrange(400)
        out[min(3, at // 100 + rng.choice([0] * 8 + [1, 2][:late]))].append((i, rng.choice("abc"), sec(at), float(rng.randint(0, 9)), 1))
    return out


def test_windows_refire_and_late_rows_go_aside(spark):
    data = shuffled(300, 2)
    out = stepwise(steps(spark, *data), lambda s: late_windows(s, "k", "v", "ts", size_s=10, lateness_s=120, delay_s=5), outputs=None)["out"].collect()
    mark, state, want_late, refired = None, {}, [], set()
    for rows in data:
        for i, k, ts, v, _ in rows:
            start = int((ts - T0).total_seconds()) // 10 * 10
            if mark is not None and start + 10 + 120 <= mark:
                want_late.append((k, ts, v))
                continue
            if mark is not None and start + 10 <= mark:
                refired.add((k, start))
            n, low, high, total = state.get((k, start), (0, v, v, 0.0))
            state[k, start] = (n + 1, min(low, v), max(high, v), total + v)
        mark = max([mark or 0, *[(ts - T0).total_seconds() - 5 for _, _, ts, _, _ in rows]])
    assert sorted((r["key"], r["ts"], r["highest"]) for r in out if r["kind"] == "late") == sorted(want_late) and want_late
    last, fired = {}, Counter()
    for r in sorted((r for r in out if r["kind"] != "late"), key=lambda r: r["epoch"]):
        last[r["key"], r["window_start_ms"]] = (r["n"], r["lowest"], r["highest"], r["total"])
        fired[r["key"], r["window_start_ms"], r["kind"]] += 1
    base = min(w for _, w in last)
    zero = base - min(s for _, s in state) * 1000
    done = {(k, s * 1000 + zero): x for (k, s), x in state.items() if s + 10 <= mark}
    assert last == done
    assert {(k, w) for k, w, kind in fired if kind == "refired"} >= {(k, s * 1000 + zero) for k, s in refired}
    assert all(n == 1 for (_, _, kind), n in fired.items() if kind == "fired")


def test_changes_fold_to_the_top(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), sec(i), 0.0, 1) for i in range(120)]
    items = [rng.randrange(12) for _ in rows]
    takes = [(r[0], r[1], r[2], float(items[i]), 1) for i, r in enumerate(rows)]
    back = [(*r[:4], -1) for r in takes[:50]]
    data = [takes[:60], takes[60:] + back[:20], back[20:]]
    out = stepwise(steps(spark, *data), lambda s: top_counts(s, "k", "v", 3, delta="d"), mode="update")["out"]
    epochs = sorted({r["epoch"] for r in out.collect()})
    for k, epoch in enumerate(epochs):
        counts = {}
        for r in [r for part in data[: k + 1] for r in part]:
            counts.setdefault(r[1], Counter())[r[3]] += r[4]
        want = {(key, rank + 1, item, n) for key, c in counts.items() for rank, (item, n) in enumerate(sorted(((i, n) for i, n in c.items() if n), key=lambda x: (-x[1], x[0]))[:3])}
        got = fold(out.where(out.epoch <= epoch), ["key", "rank"], ["epoch", "seq"])
        assert {(r["key"], r["rank"], r["item"], r["n"]) for r in got.collect()} == want
    assert len(epochs) == 3 and {r["op"] for r in out.collect()} >= {"+I", "-U", "+U"}


def test_rows_that_leave_the_top_are_deleted(spark):
    data = [[(1, "a", T0, 1.0, 1), (2, "a", T0, 2.0, 1)], [(3, "a", T0, 1.0, -1)], [(4, "a", T0, 2.0, -1), (5, None, T0, 2.0, 1)]]
    out = stepwise(steps(spark, *data), lambda s: top_counts(s, "k", "v", 5, delta="d"), mode="update")["out"]
    got = [(r["epoch"], r["op"], r["rank"], r["item"]) for r in out.orderBy("epoch", "seq").collect()]
    assert [x[1:] for x in got] == [("+I", 1, 1.0), ("+I", 2, 2.0), ("-U", 1, 1.0), ("+U", 1, 2.0), ("-D", 2, 2.0), ("-D", 1, 2.0)]
    assert fold(out, ["key", "rank"], ["epoch", "seq"]).count() == 0


def test_stream_comes_in_order(spark):
    data = shuffled(200, 1, seed=8)
    out = stepwise(steps(spark, *data), lambda s: in_order(s, "ts", delay_s=205, range_s=20))["out"].collect()
    rows = [r for part in data for r in part]
    end = max((r[2] - T0).total_seconds() for r in rows) - 205
    want = sorted((r[2], r[0]) for r in rows if (r[2] - T0).total_seconds() // 20 * 20 + 20 <= end)
    assert sorted((r["ts"], r["id"]) for r in out) == want and want
    spans = {}
    for r in out:
        low, high = spans.get(r["epoch"], (r["ts"], r["ts"]))
        spans[r["epoch"]] = (min(low, r["ts"]), max(high, r["ts"]))
    ordered = [spans[e] for e in sorted(spans)]
    assert len(ordered) > 1 and all(a[1] < b[0] for a, b in zip(ordered, ordered[1:], strict=False))


def test_incremental_aggregates(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), sec(i % 7), rng.choice([None, 1.0, 2.5, 4.0]), rng.choice([1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumnRenamed("v", "value").withColumnRenamed("d", "weight")
    got = {(r["k"], r["ts"]): (r["mean"], r["n"]) for r in incremental(df, ["k", "ts"], ["value", "weight"], WeightedMean(), "mean double, n long", held=2).collect()}
    for (k, ts), (mean, n) in got.items():
        mine = [(v, d) for _, a, b, v, d in rows if (a, b) == (k, ts) and v is not None]
        assert n == len(mine) and abs(mean - sum(v * d for v, d in mine) / sum(d for _, d in mine)) < 1e-9
    assert set(got) == {(r[1], r[2]) for r in rows}
    assert incremental(df.limit(0), ["k"], ["value", "weight"], WeightedMean(), "mean double, n long").count() == 0


def test_accumulators_of_different_keys_do_not_merge():
    one, other = Held(("a",), (1.0, 2.0, 1)), Held(("b",), (1.0, 2.0, 1))
    assert one.merged(Held(("a",), (3.0, 1.0, 2)), WeightedMean()).acc == (4.0, 3.0, 3)
    with pytest.raises(ValueError, match="different keys"):
        one.merged(other, WeightedMean())


def test_row_by_row_and_by_arrays_agree():
    import pandas as pd

    rows = pd.DataFrame({"value": [1.0, None, 3.0], "weight": [2.0, 1.0, 5.0]})
    by_row = WeightedMean().create()
    for r in rows.itertuples(index=False):
        by_row = WeightedMean().add(by_row, r)
    assert by_row == WeightedMean().add_rows(WeightedMean().create(), rows) == (17.0, 7.0, 2)


def test_stop_and_go_on_equals_one_run(spark):
    """The query stops after each step; a copy of its checkpoint, taken in between, goes on alike."""
    data = shuffled(120, 1, seed=3)
    build = lambda s: incremental_stream(s, ["k"], ["ts", "v"], Renamed(), "n long, lowest double, highest double, last double")
    last = lambda out: {r["k"]: (r["n"], r["lowest"], r["highest"]) for r in sorted(out.collect(), key=lambda r: r["epoch"])}
    whole = last(stepwise(steps(spark, [r for part in data for r in part]), build, mode="update")["out"])
    folder = shared_folder(spark)
    stepwise(steps(spark, *data[:2]), build, mode="update", folder=folder)
    state = spark.read.format("statestore").option("stateVarName", "acc").load(f"{folder}/state")
    assert {r["key"][0] for r in state.select("key").collect()} == {"a", "b", "c"}
    copied(spark, f"{folder}/state", f"{folder}/snapshot")
    first = last(stepwise(steps(spark, *data[2:]), build, mode="update", folder=folder)["out"])
    assert first == whole
    again = stepwise(steps(spark, []), build, mode="update", folder=folder, checkpoint="snapshot")["out"]  # finds the later steps' files
    assert last(again) == whole


class Renamed(LastReadings):
    def add(self, acc, row):
        return super().add(acc, type("R", (), {"ts": row.ts, "value": row.v}))


def copied(spark, source, target):
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = path(source).getFileSystem(conf)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(source), fs, path(target), False, conf)


def test_windows_after_a_restart(spark):
    """A processor with timers, stopped between the rows and the timer."""
    data = shuffled(100, 1, seed=5)
    build = lambda s: late_windows(s, "k", "v", "ts", size_s=10, lateness_s=200, delay_s=5)
    rows = lambda out: sorted((r["key"], r["window_start_ms"], r["n"], r["total"]) for r in out.collect() if r["kind"] == "fired")
    folder = shared_folder(spark)
    stepwise(steps(spark, *data[:3]), build, folder=folder)
    assert rows(stepwise(steps(spark, data[3]), build, folder=folder)["out"]) == rows(stepwise(steps(spark, *data), build)["out"])


def test_state_expires(spark):
    """A value that is older than its time to live raises no alert, and its state is gone."""
    schema = "key string, ts timestamp, before double, value double"
    build = lambda ttl: lambda s: P.apply(s, ["k"], P.ChangeAlert("v", 1.7, ttl_ms=ttl), schema, "update", "processingTime")
    folder, kept = shared_folder(spark), shared_folder(spark)
    for ttl, where in ((3000, folder), (3_600_000, kept)):
        stepwise(steps(spark, [(1, "a", sec(1), 10.0, 0)]), build(ttl), mode="update", once=True, folder=where)
    time.sleep(4)
    other = [(2, "b", sec(2), 0.0, 0)]
    for ttl, where in ((3000, folder), (3_600_000, kept)):
        stepwise(steps(spark, other), build(ttl), mode="update", once=True, folder=where)
    left = lambda where: {r["key"][0] for r in spark.read.format("statestore").option("stateVarName", "state").load(f"{where}/state").select("key").collect()}
    assert "a" not in left(folder) and "a" in left(kept)
    for ttl, where, alerts in ((3000, folder, []), (3_600_000, kept, [(10.0, 50.0)])):
        out = stepwise(steps(spark, [(3, "a", sec(3), 50.0, 0)]), build(ttl), mode="update", once=True, folder=where)["out"]
        assert [(r["before"], r["value"]) for r in out.collect()] == alerts


def test_rising_timer_fires_once(spark):
    """Processing time passes between the steps: one alert after a rise that lasts, none after a fall."""
    build = lambda s: P.apply(s, ["k"], P.RisingAlert("v", 1500), "key string, message string, at long", "append", "processingTime")
    folder = shared_folder(spark)
    run = lambda *rows: stepwise(steps(spark, list(rows)), build, once=True, folder=folder)["out"].collect()
    run((1, "up", sec(1), 1.0, 0), (2, "down", sec(1), 1.0, 0))
    assert run((3, "up", sec(2), 2.0, 0), (4, "down", sec(2), 2.0, 0)) == []
    run((5, "down", sec(3), 0.5, 0))
    time.sleep(2)
    run((6, "other", sec(4), 0.0, 0))
    time.sleep(2)
    assert [r["key"] for r in run((7, "other", sec(5), 0.0, 0))] == ["up"]
