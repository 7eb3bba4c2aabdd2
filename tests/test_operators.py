import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import joins, match, rank, sets, windows
from tidemark.plans import pipelines
from tidemark.sources import sinks
from tidemark.sources.fake import fill, regexify
from tidemark.sources.tables import Catalog, TableDef, load_properties
from tidemark.sources.topics import Topic, security_options

T0 = datetime(2024, 1, 1)


def sec(n):
    return T0 + timedelta(seconds=n)


def test_asof_join_matches_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", None]), sec(rng.randrange(0, 400_000))) for i in range(200)] + [(900, "c", sec(5)), (901, "a", None)]
    right = sorted({(rng.choice(["a", "b"]), sec(rng.randrange(0, 400_000))) for _ in range(40)})
    right = [(k, t, i) for i, (k, t) in enumerate(right)]
    ldf = spark.createDataFrame(left, "id long, k string, ts timestamp")
    versions = joins.VersionedTable(spark.createDataFrame(right, "key string, vts timestamp, v long"), "key", "vts")
    for how in ("left", "inner"):
        for slice_s in (86_400, 3600):
            got = {r["id"]: r["v"] for r in joins.asof_join(ldf, versions, "k", "ts", how=how, slice_s=slice_s).collect()}
            want = {}
            for i, k, t in left:
                found = [(vt, v) for vk, vt, v in right if vk == k and t is not None and vt <= t]
                if found or how == "left":
                    want[i] = max(found)[1] if found else None
            assert got == want


def test_versions(spark):
    v = joins.VersionedTable(spark.createDataFrame([("a", sec(1), 1), ("a", sec(5), 2), ("b", sec(2), 3)], "k string, ts timestamp, v int"), "k", "ts")
    assert {(r["k"], r["v"], r["valid_to"]) for r in v.intervals().collect()} == {("a", 1, sec(5)), ("a", 2, None), ("b", 3, None)}
    assert {(r["k"], r["v"]) for r in v.current().collect()} == {("a", 2), ("b", 3)}


def brute_find(text, pattern):
    import re

    return [(m.start(), m.end()) for m in re.finditer(pattern, text) if m.end() > m.start()]


@settings(max_examples=200, deadline=None)
@given(st.text("abx", max_size=25), st.sampled_from([("A+ B", "a+b"), ("A B? A", "ab?a"), ("A{2,3} B", "a{2,3}b"), ("A* B", "a*b"), ("A B+ A{2}", "ab+a{2}")]))
def test_matcher_against_regular_expressions(text, patterns):
    rows = [{"c": c, "i": i} for i, c in enumerate(text)]
    define = {"A": lambda m: m.row["c"] == "a", "B": lambda m: m.row["c"] == "b"}
    got = [(m.rows[0][1]["i"], m.rows[-1][1]["i"] + 1) for m in match.matches(rows, patterns[0], define)]
    assert got == brute_find(text, patterns[1])


def test_matcher_skips_and_bounds():
    rows = [{"v": v, "t": sec(i)} for i, v in enumerate([5, 4, 3, 6, 2, 7])]
    down = {"D": lambda m: m.row["v"] < (m.last("D", "v", 1) if len(m.of("D")) > 1 else m.last("S", "v")), "U": lambda m: m.row["v"] > m.last("D", "v")}
    found = lambda **k: [[r["v"] for _, r in m.rows] for m in match.matches(rows, "S D+ U", down, **k)]
    assert found(after="TO LAST U") == [[5, 4, 3, 6], [6, 2, 7]]
    assert found(after="PAST LAST ROW") == [[5, 4, 3, 6]]
    assert found(after="TO NEXT ROW") == [[5, 4, 3, 6], [4, 3, 6], [6, 2, 7]]
    assert found(after="TO LAST U", within=("t", timedelta(seconds=2))) == [[4, 3, 6], [6, 2, 7]]
    long = [{"v": 0}] * 5000 + [{"v": 1}]
    assert len(next(match.matches(long, "A+ B", {"A": lambda m: m.row["v"] == 0, "B": lambda m: m.row["v"] == 1})).rows) == 5001


def test_rank_and_sets(spark):
    df = spark.createDataFrame([("a", 3, sec(1)), ("a", 5, sec(2)), ("b", 4, sec(1)), ("a", 1, sec(3))], "k string, v int, ts timestamp")
    assert {(r["k"], r["v"]) for r in rank.top_n(df, ["k"], [F.desc("v")], 2).collect()} == {("a", 5), ("a", 3), ("b", 4)}
    assert {(r["k"], r["v"]) for r in rank.deduplicate(df, ["k"], ["ts"]).collect()} == {("a", 3), ("b", 4)}
    assert {(r["k"], r["v"]) for r in rank.latest_by_key(df, "k", ["ts"]).collect()} == {("a", 1), ("b", 4)}
    out = sets.split_outputs(df, {"low": F.col("v") < 4}, exclusive=True)
    assert (out["low"].count(), out["main"].count()) == (2, 2)
    assert sets.split_outputs(df, {"low": F.col("v") < 4})["main"].count() == 4
    assert windows.count_windows(df, ["k"], ["ts"], 2).count() == 2


def test_json_functions(spark):
    df = spark.createDataFrame([('{"a":{"b":"x"},"n":null,"xs":[{"y":1}]}',), ("not json",), (None,)], "j string")
    j = F.col("j")
    got = df.select(S.is_json(j), S.json_exists(j, "$.n"), S.json_exists(j, "$.q"), S.json_value(j, "$.a.b"), S.json_query(j, "$.xs[*].y"), S.json_query(j, "$.a")).collect()
    assert [tuple(r) for r in got] == [(True, True, False, "x", "[1]", '{"b":"x"}'), (False, False, False, None, None, None), (False, False, False, None, None, None)]
    S.register(spark)
    assert spark.sql("""SELECT json_value('{"a":1}', '$.a'), is_json('x'), json_exists('{"a":1}', '$.a')""").first()[:] == ("1", False, True)


def test_flights(spark):
    """Future flights are kept, past ones dropped; both airlines meet in one schema; statistics per minute and cumulated."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    sky = "email_address string, flight_departure_time timestamp, iata_departure_code string, flight_arrival_time timestamp, iata_arrival_code string, flight_number string, confirmation string, ticket_price int"
    sun = "customer_email_address string, departure_time timestamp, departure_airport string, arrival_time timestamp, arrival_airport string, flight_id string, reference_number string, total_price int"
    row = lambda who, at, ref: (who, sec(at), "AAA", sec(at + 3600), "BBB", "F1", ref, 100)
    skyone = spark.createDataFrame([row("u@x", 10, "s1"), row("u@x", -9000, "old")], sky)
    sunset = spark.createDataFrame([row("v@x", 20, "t1"), row("v@x", -9000, "old"), row("u@x", 75, "t2")], sun)
    flights = pipelines.import_flights(skyone, sunset, now)
    assert {(r["confirmation"], r["source"]) for r in flights.collect()} == {("s1", "skyone"), ("t1", "sunset"), ("t2", "sunset")}
    per = pipelines.user_statistics(flights, "departure_time")
    assert {(r["email_address"], r["window_start"], r["total_flight_duration"], r["number_of_flights"]) for r in per.collect()} == {("u@x", sec(0), 60, 1), ("v@x", sec(0), 60, 1), ("u@x", sec(60), 60, 1)}
    assert {(r["email_address"], r["number_of_flights"], r["total_flight_duration"]) for r in pipelines.cumulative_statistics(per).collect()} == {("u@x", 1, 60), ("u@x", 2, 120), ("v@x", 1, 60)}


def test_sensors(spark):
    rows = [(1, 0, sec(0)), (1, 0, sec(0) + timedelta(milliseconds=100)), (1, 100, sec(1)), (2, 20, sec(0)), (2, 100, sec(0))]
    sensors = pipelines.readings(spark.createDataFrame(rows, "id int, rn int, log_time timestamp"))
    got = {(r["id"], r["window_start"], r["num_records"], r["mean"], r["low"], r["high"]) for r in pipelines.sensor_windows(sensors).collect()}
    assert got == {("sensor_1", sec(0), 2, 65.0, 65.0, 65.0), ("sensor_1", sec(1), 1, 85.0, 85.0, 85.0), ("sensor_2", sec(0), 2, 77.0, 69.0, 85.0)}
    level = lambda rn: spark.createDataFrame([(sec(0), None)], "level_from timestamp, level_to timestamp").withColumn("level", pipelines.smoke_level(F.lit(rn)))
    assert pipelines.fire_alerts(sensors, level(20)).count() == 0
    assert {r["message"] for r in pipelines.fire_alerts(sensors, level(100)).collect()} == {"Risk of fire from sensor_1", "Risk of fire from sensor_2"}
    assert sets.split_outputs(sensors, {"freezing": F.col("temperature") < 70})["freezing"].count() == 3


def test_quarters(spark):
    out = pipelines.quarterly_statistics(spark.createDataFrame([("s", 1, 2, 3, 4)], "seller_id string, q1 int, q2 int, q3 int, q4 int")).first()
    assert (out["total"], out["mean"], out["stdev"]) == (10, 2.5, 1.29)


def test_catalog(spark, tmp_path):
    spark.range(5).write.json(f"{tmp_path}/a")
    spark.range(7).write.json(f"{tmp_path}/b")
    t = TableDef("nums", "id long", "json", {"path": f"{tmp_path}/a"}, {"twice": "id * 2"}, primary_key=("id",))
    c = Catalog(spark)
    c.create(t)
    c.create(t.like("others", excluding_options=True).with_options(path=f"{tmp_path}/b"))
    assert c.show() == ["nums", "others"] and spark.table("nums").count() == 5 and c.table("nums", path=f"{tmp_path}/b").count() == 7
    c.alter("nums", path=f"{tmp_path}/b")
    assert spark.table("nums").agg(F.max("twice")).first()[0] == 12
    c.set("execution.runtime-mode", "streaming")
    assert spark.table("nums").isStreaming
    c.drop("nums")
    with pytest.raises(KeyError):
        c.drop("nums")
    c.drop("nums", if_exists=True)
    assert load_properties([{"PropertyGroupId": "g", "PropertyMap": {"topic": "x"}}], "g") == {"topic": "x"}


def test_topics(spark, tmp_path):
    topic = Topic("t", directory=str(tmp_path))
    topic.write(spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string"), keys=["id"])
    assert {tuple(r) for r in topic.rows(spark, "id long, s string, missing int").collect()} == {(1, "a", None), (2, "b", None)}
    assert {(r["key"], r["topic"]) for r in topic.records(spark).collect()} == {('{"id":1}', "t"), ('{"id":2}', "t")}
    assert security_options("broker:9092") == {} and security_options("broker:9098")["kafka.security.protocol"] == "SASL_SSL"


def test_fake_grammar():
    rng = random.Random(0)
    assert regexify("(A|B){1}-[x-z]{2}", rng)[1] == "-"
    assert fill("user_#{number.numberBetween '3','4'}", rng, T0) == "user_3"
    assert fill("#{date.past '10','5','SECONDS'}", rng, T0).startswith("2023-12-31 23:59:5")
    assert len(fill("#{Internet.uuid}", rng, T0)) == 36


def test_statement_set_and_sinks(spark, tmp_path):
    got = {}
    keep = lambda name: (lambda df: got.__setitem__(name, df.count()))
    sinks.statement_set(spark.range(10), [(lambda df: df.where("id > 4"), keep("a")), (lambda df: df, keep("b")), (lambda df: df, sinks.blackhole())])
    assert got == {"a": 5, "b": 10}
    sinks.text_files(f"{tmp_path}/t")(spark.createDataFrame([("x",)], "value string"))
    assert spark.read.text(f"{tmp_path}/t").count() == 1
