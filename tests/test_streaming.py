import time
import uuid
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import windows
from tidemark.sources import sinks
from tidemark.sources.fake import FakeDataSource
from tidemark.sources.topics import Topic
from tidemark.streaming import packed as packed_rows
from tidemark.streaming import processors as P
from tidemark.streaming.run import finish

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, v double, tag string, version string, for_ms long, threshold double"


def sec(n):
    return T0 + timedelta(seconds=n)


@pytest.fixture
def feed(spark, tmp_path):
    """Steps of rows, a micro-batch each."""

    def make(*steps):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for i, rows in enumerate(steps):
            full = [tuple(r.get(c) for c in names) for r in rows]
            spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/s={i:03}")
        return spark.readStream.schema(SCHEMA + ", s string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")

    return make


def rows(*values):
    return [{"id": i, "k": "a", "ts": sec(s), "v": float(v)} for i, s, v in values]


def test_late_tag_and_split(feed):
    stream = feed(rows((1, 10, 1), (2, 100, 1)), rows((3, 20, 1), (4, 105, 1)), rows((5, 30, 1), (6, 300, 1))).withWatermark("ts", "5 seconds")
    query = P.apply(stream, ["k"], P.LateTag(["id"]), "id long, watermark_ms long, late boolean", "append", "processingTime")
    got = {}
    q = query.writeStream.foreachBatch(lambda df, _: got.update({r["id"]: r["late"] for r in df.collect()})).outputMode("append").start()
    deadline = time.time() + 90
    while len(got) < 6 and time.time() < deadline:  # a query on processing time never idles
        time.sleep(0.5)
    q.stop()
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_change_alert_keeps_state_between_batches(feed):
    out = finish(P.apply(feed(rows((1, 1, 10), (2, 2, 11)), rows((3, 3, 15), (4, 4, 16))), ["k"], P.ChangeAlert("v", 1.7), "key string, ts timestamp, before double, value double", "update"))
    assert {(r["before"], r["value"]) for r in out.collect()} == {(11.0, 15.0)}


def test_idle_state_is_forgotten(feed):
    steps = [rows((1, 10, 10)), rows((2, 5000, 50)) + [{"id": 9, "k": "b", "ts": sec(9000), "v": 0.0}], [{"id": 10, "k": "b", "ts": sec(20000), "v": 0.0}], rows((3, 20001, 99))]
    stream = feed(*steps).withWatermark("ts", "0 seconds")
    out = finish(P.apply(stream, ["k"], P.ChangeAlert("v", 1.7, idle_ms=3_600_000), "key string, ts timestamp, before double, value double", "append", "eventTime"))
    assert {(r["key"], r["value"]) for r in out.collect()} == {("a", 50.0)}


def test_count_windows_and_sums(feed):
    steps = [rows((1, 1, 1), (2, 2, 2), (3, 3, 3)), rows((4, 4, 4), (5, 5, 5))]
    out = finish(P.apply(feed(*steps), ["k"], P.CountWindow("v", 2), "key string, bucket long, n int, total double", "update"))
    assert {(r["bucket"], r["total"]) for r in out.collect()} == {(0, 3.0), (1, 7.0)}


def test_rolling_sum(feed):
    out = finish(P.apply(feed(rows((1, 1, 2), (2, 2, 3)), rows((3, 3, 4))), ["k"], P.RunningSum("v"), "key string, ts timestamp, total double", "update"))
    assert sorted(r["total"] for r in out.collect()) == [2.0, 5.0, 9.0]


def test_rules(feed):
    rule = lambda s, t: {"k": "a", "ts": sec(s), "tag": "rule", "threshold": t}
    reading = lambda s, v: {"k": "a", "ts": sec(s), "tag": "reading", "v": float(v)}
    stream = feed([reading(1, 0), rule(2, 5.0), reading(3, 9)], [rule(4, 0.0), reading(5, 99)]).withColumnRenamed("v", "value")
    out = finish(P.apply(stream, ["k"], P.RuleAlert(), "key string, ts timestamp, value double, threshold double", "update"))
    assert {(r["value"], r["threshold"]) for r in out.collect()} == {(9.0, 5.0)}


def test_switch(feed):
    on = {"k": "a", "ts": sec(10), "tag": "switch", "for_ms": 5000}
    item = lambda s: {"k": "a", "ts": sec(s), "tag": "item", "v": float(s)}
    stream = feed([item(9), on, item(12)], [item(14), item(15)]).withColumnRenamed("v", "value")
    out = finish(P.apply(stream, ["k"], P.Switch(), "key string, ts timestamp, value double", "update"))
    assert sorted(r["value"] for r in out.collect()) == [12.0, 14.0]


def test_streaming_asof(feed):
    version = lambda s, v: {"k": "a", "ts": sec(s), "tag": "version", "version": v}
    row = lambda i, s: {"id": i, "k": "a", "ts": sec(s), "tag": "row"}
    stream = feed([row(1, 5), version(10, "x"), row(2, 12)], [version(11, "y"), row(3, 10), row(4, 13)], [row(5, 100)], [row(6, 200)]).withWatermark("ts", "5 seconds")
    out = finish(P.apply(stream, ["k"], P.AsOf(), "key string, ts timestamp, id long, version_ts timestamp, version string", "append", "eventTime"))
    got = {r["id"]: r["version"] for r in out.collect()}
    assert {i: got[i] for i in (2, 3, 4)} == {2: "y", 3: "x", 4: "y"} and got.get(1) is None


def test_early_windows(feed):
    stream = feed(rows((1, 1, 1), (2, 3, 1)), rows((3, 14, 1)), rows((4, 40, 1))).withWatermark("ts", "0 seconds")
    out = finish(P.apply(stream, ["k"], P.EarlyWindow("v", 10_000, 1_000), "key string, window_start_ms long, n long, total double, final boolean", "append", "eventTime"))
    got = out.collect()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert {(r["window_start_ms"] - base, r["n"]) for r in got if r["final"]} >= {(0, 2)}
    assert any(not r["final"] for r in got)


def test_pattern_stream(feed):
    step = lambda i, s, v: {"id": i, "k": "a", "ts": sec(s), "v": float(v)}
    stream = feed([step(1, 1, 5), step(3, 3, 3), step(2, 2, 4)], [step(4, 4, 6), step(5, 5, 2)], [step(6, 60, 7)], [step(7, 200, 1)], [step(8, 400, 1)]).withWatermark("ts", "1 second")
    down = {"D": lambda m: m.row["v"] < (m.last("D", "v", 1) if len(m.of("D")) > 1 else m.last("S", "v")), "U": lambda m: m.row["v"] > m.last("D", "v")}
    measures = {"first": lambda m: m.first("S", "id"), "last": lambda m: m.last("U", "id")}
    out = finish(P.apply(stream, ["k"], P.PatternMatch("id long, ts timestamp, v double", "S D+ U", down, measures, ["ts", "id"], after="TO LAST U"), "key string, first long, last long", "append", "eventTime"))
    assert {(r["first"], r["last"]) for r in out.collect()} == {(1, 4), (4, 6)}


def test_rising_timer_rules():
    """Set on a rise, unchanged on a further one, cleared on a fall; never by a first value."""
    step = lambda *v: P.RisingAlert.step(*v, now=100, wait=50)
    assert [step(None, 0, 65.0), step(65.0, 0, 75.0), step(75.0, 150, 85.0), step(85.0, 150, 75.0), step(85.0, 0, 75.0)] == [0, 150, 150, 0, 0]


def test_cumulative_after_windows(feed):
    stream = feed(rows((1, 1, 5), (2, 2, 5)), rows((3, 61, 5)), rows((4, 200, 5)), rows((5, 400, 5))).withWatermark("ts", "0 seconds")
    per = windows.spread(stream.groupBy("k", windows.tumble("ts", "1 minute")).agg(F.count("*").alias("n"), F.sum("v").alias("total")))
    out = finish(P.apply(per, ["k"], P.Cumulative(), "key string, window_start timestamp, n long, total double"))
    assert sorted((r["n"], r["total"]) for r in out.collect())[:2] == [(2, 10.0), (3, 15.0)]


def test_fake_stream_upsert_commit_and_topic(spark, tmp_path):
    spark.dataSource.register(FakeDataSource)
    fake = spark.readStream.format("fake").schema("k string, n int, at timestamp").option("fields.k", "#{Options.option 'a','b'}").option("fields.n", "#{number.numberBetween '0','9'}").option("fields.at", "#{date.past '9','DAYS'}")
    stream = fake.option("number-of-rows", 50).option("rows-per-second", 20).load()
    q = stream.writeStream.foreachBatch(sinks.upsert(f"{tmp_path}/up", ["k"], ["at"])).option("checkpointLocation", f"{tmp_path}/c1").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    files = sorted((tmp_path / "up").iterdir(), key=lambda p: int(p.name[1:]))
    assert {r["k"] for r in spark.read.parquet(str(files[-1])).collect()} == {"a", "b"}

    spark.createDataFrame([(1, "x", sec(0)), (2, "y", sec(10_000))], "id long, p string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/src")
    src = spark.readStream.schema("id long, p string, ts timestamp").parquet(f"{tmp_path}/src")
    sinks.commit_partitions(src, f"{tmp_path}/out", ["p"], "ts", delay="1 hour", checkpoint=f"{tmp_path}/c2").awaitTermination()
    assert (tmp_path / "out/p=x/_SUCCESS").exists() and not (tmp_path / "out/p=y/_SUCCESS").exists()

    topic = Topic("t", directory=str(tmp_path / "topics"))
    topic.write(src, keys=["id"], checkpoint=f"{tmp_path}/c3").awaitTermination()
    assert topic.rows(spark, "id long, p string").count() == 2


def test_each_batch_is_computed_once(feed, tmp_path):
    """A look whether a batch is empty would run a stateful step a second time, and break it off."""

    def marked(batches):
        for b in batches:
            for _ in range(len(b)):
                (tmp_path / uuid.uuid4().hex).touch()
            yield b

    stream = feed(rows((1, 1, 10), (2, 2, 11)), rows((3, 3, 15)))
    out = finish(stream.mapInPandas(marked, stream.schema))
    assert len(list(tmp_path.glob("?" * 32))) == 3 == out.count()


def test_early_windows_by_one_timer_a_key():
    """Every firing of a key's windows at one timer, however many rows and windows it has."""

    class State:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: self.rows[0] if self.value else iter(self.rows)
        update = lambda self, v: setattr(self, "rows", [v])
        put = lambda self, v: setattr(self, "rows", list(v))
        clear = lambda self: setattr(self, "rows", [])

    class Handle:
        timers: set = set()

        def getValueState(self, *_):
            s = State()
            s.value = True
            return s

        def getListState(self, *_):
            s = State()
            s.value = False
            return s

        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    p, handle = P.EarlyWindow("v", 10_000, 1_000), Handle()
    p.init(handle)
    base = int(T0.timestamp() * 1000)
    given = [Row(ts=sec(s), v=1.0) for s in (12, 1, 1, 3, 14, 40)]
    list(p.handleInputRows(("a",), iter(given), At(0)))
    assert handle.timers == {base + 2_000}
    out = list(p.handleExpiredTimer(("a",), At(base + 14_000), None))
    assert [(r["window_start_ms"] - base, r["n"], r["final"]) for r in sorted(out, key=lambda r: (r["window_start_ms"], r["final"]))] == [(0, 3, False), (0, 3, False), (0, 3, True), (10_000, 2, False)]
    assert handle.timers == {base + 2_000, base + 15_000}  # Spark itself deletes the one that expired
    assert len(list(p.handleExpiredTimer(("a",), At(base + 60_000), None))) == 4 and not p.windows.exists() and not p.alarm.exists()


def test_rows_come_packed_by_key(spark):
    """A processor without timers takes a key's rows as a few rows of arrays; times, nulls and null keys are kept."""
    given = StructType.fromDDL("k string, ts timestamp, v double, n int")
    at = [sec(s).replace(tzinfo=timezone.utc) for s in range(5)]
    values = [("b", at[0], 1.0, 1), (None, at[1], None, 2), ("a", None, 2.0, None), ("b", at[3], 3.0, 4), (None, at[4], 4.0, 5)]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*values), (pa.string(), pa.timestamp("us", "UTC"), pa.float64(), pa.int32()))], given.names)
    packed = pa.Table.from_batches(packed_rows._packer(["k"])(iter(table.to_batches(max_chunksize=2)))).to_pylist()
    assert len(packed) == 3
    unpacked = packed_rows.Packed(None, given, ["k"], given)._rows(Row(**p) for p in packed)
    assert sorted(map(repr, map(tuple, unpacked))) == sorted(map(repr, values))


def test_rules_and_switches_write_state_that_changes(feed):
    """Rules are one state a key; across batches a rule, a reading and a removal come to what they did."""
    row = lambda s, tag, v=None, t=None: {"id": s, "k": "a", "ts": sec(s), "tag": tag, "v": v, "threshold": t}
    stream = feed([row(1, "rule", t=5.0)], [row(2, "reading", 1.0)], [row(3, "reading", 9.0), row(4, "rule", t=0.0)], [row(5, "reading", 90.0)]).withColumnRenamed("v", "value")
    out = finish(P.apply(stream, ["k"], P.RuleAlert(), "key string, ts timestamp, value double, threshold double", "update"))
    assert [(r["value"], r["threshold"]) for r in out.collect()] == [(9.0, 5.0)]
