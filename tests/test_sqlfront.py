from datetime import datetime, timedelta

import pytest

from tidemark import sqlfront
from tidemark.operators.joins import VersionedTable
from tidemark.sources.fake import FakeDataSource
from tidemark.sources.tables import Catalog

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def t(spark):
    rows = [(i, "ab"[i % 2], T0 + timedelta(seconds=s), [1, 2]) for i, s in enumerate([0, 1, 4, 6, 11, 30])]
    spark.createDataFrame(rows, "id long, k string, ts timestamp, xs array<int>").createOrReplaceTempView("t")
    return lambda sql: sorted(tuple(r) for r in sqlfront.sql(spark, sql).collect())


def at(s):
    return T0 + timedelta(seconds=s)


def test_window_functions(t):
    assert t("SELECT window_start, count(*) FROM TABLE(TUMBLE(TABLE t, DESCRIPTOR(ts), INTERVAL '5' SECOND)) GROUP BY window_start, window_end") == [(at(0), 3), (at(5), 1), (at(10), 1), (at(30), 1)]
    assert t("SELECT window_start, count(*) FROM TABLE(HOP(TABLE t, DESCRIPTOR(ts), INTERVAL '5' SECOND, INTERVAL '10' SECOND)) WHERE id = 4 GROUP BY window_start") == [(at(5), 1), (at(10), 1)]
    assert t("SELECT window_end, count(*) FROM TABLE(CUMULATE(TABLE t, DESCRIPTOR(ts), INTERVAL '5' SECOND, INTERVAL '10' SECOND)) WHERE id < 4 GROUP BY window_end") == [(at(5), 3), (at(10), 4)]
    assert t("SELECT TUMBLE_START(ts, INTERVAL '5' SECOND) AS s, count(*) FROM t GROUP BY TUMBLE(ts, INTERVAL '5' SECOND)")[0] == (at(0), 3)
    assert t("SELECT SESSION_END(ts, INTERVAL '5' SECOND) AS e, count(*) FROM t GROUP BY SESSION(ts, INTERVAL '5' SECOND)") == [(at(16), 5), (at(35), 1)]


def test_syntax(t):
    assert t("SELECT id FROM t WHERE k SIMILAR TO '(a|c)%' AND FLOOR(ts TO MINUTE) = timestamp'2024-01-01'") == [(0,), (2,), (4,)]
    assert len(t("SELECT id, x FROM t CROSS JOIN UNNEST(xs) AS u (x)")) == 12


def test_similar_to_takes_other_signs_literally(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.scalar import similar_to

    words = ["a.b", "axb", "^a$", "a\\b", "ab", "cb", "x1"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    df.createOrReplaceTempView("similar_words")
    cases = {"a.b": ["a.b"], "a_b": ["a.b", "axb", "a\\b"], "^a$": ["^a$"], "a%": ["a.b", "axb", "a\\b", "ab"], "[^a]b": ["cb"], "(a|c)b": ["ab", "cb"], "x[0-9]+": ["x1"]}
    for pattern, want in cases.items():
        assert [r["w"] for r in df.where(similar_to(F.col("w"), pattern)).collect()] == want
        assert [r["w"] for r in sqlfront.sql(spark, f"SELECT w FROM similar_words WHERE w SIMILAR TO '{pattern}'").collect()] == want


def test_json_exists_of_a_null(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import scalar

    scalar.register(spark)
    df = spark.createDataFrame([('{"a": null}',), ('{"b": 1}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in df.select(scalar.json_exists(F.col("j"), "$.a")).collect()] == [True, False, False, False]
    df.createOrReplaceTempView("json_rows")
    assert [r[0] for r in spark.sql("SELECT json_exists(j, '$.a') FROM json_rows").collect()] == [True, False, False, False]


def test_jdbc_upsert(spark):
    from tidemark.sources.sinks import jdbc_upsert, merge_sql

    url = "jdbc:derby:memory:counts;create=true"
    jvm = spark._jvm
    connection = jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().executeUpdate("CREATE TABLE area_counts (area INT PRIMARY KEY, n INT, seq INT)")
    put = jdbc_upsert(url, "area_counts", ["area"], ["seq"])
    batches = [[(1, 5, 1), (1, 6, 2), (2, 1, 1)], [(2, 9, 3), (3, 3, 3)]]
    for epoch, rows in enumerate([*batches, batches[1]]):
        put(spark.createDataFrame(rows, "area int, n int, seq int"), epoch)
    got = spark.read.format("jdbc").options(url=url, dbtable="area_counts").load()
    assert sorted(map(tuple, got.select("AREA", "N").collect())) == [(1, 6), (2, 9), (3, 3)]
    connection.close()
    assert merge_sql("jdbc:mysql://h/d", "t", "s", ["k"], ["k", "v"]) == "INSERT INTO t (k, v) SELECT `k`, `v` FROM s ON DUPLICATE KEY UPDATE v = VALUES(v)"
    assert "ON CONFLICT (k) DO UPDATE SET v = excluded.v" in merge_sql("jdbc:postgresql://h/d", "t", "s", ["k"], ["k", "v"])


def test_asof(spark, t):
    rates = VersionedTable(spark.createDataFrame([("a", at(0), 1.5), ("a", at(4), 2.5)], "code string, rate_time timestamp, rate double"), "code", "rate_time")
    query = "SELECT x.id, r.rate FROM t AS x {}JOIN rates FOR SYSTEM_TIME AS OF x.ts AS r ON x.k = r.code"
    got = lambda how: {tuple(r) for r in sqlfront.sql(spark, query.format(how), {"rates": rates}).collect()}
    assert got("") == {(0, 1.5), (2, 2.5), (4, 2.5)}
    assert got("LEFT ") == {(0, 1.5), (2, 2.5), (4, 2.5), (1, None), (3, None), (5, None)}


def test_ddl(spark):
    spark.dataSource.register(FakeDataSource)
    table = sqlfront.create_table(Catalog(spark), """
      CREATE TABLE probes (probe STRING, depth_m DECIMAL(8, 1) NOT NULL, unit VARCHAR(2), seen TIMESTAMP(3), depth_cm AS depth_m * 100,
        WATERMARK FOR seen AS seen - INTERVAL '30' SECONDS, PRIMARY KEY (probe) NOT ENFORCED)
      WITH ('connector' = 'faker', 'number-of-rows' = '12', 'fields.probe.expression' = '#{Internet.uuid}', 'fields.seen.expression' = '#{date.past ''90'',''SECONDS''}',
        'fields.depth_m.expression' = '#{Number.randomDouble ''1'',''3'',''40''}', 'fields.unit.expression' = '#{regexify ''(km|m|ft){1}''}')
    """)  # fmt: skip
    assert table.watermark == ("seen", "30 seconds") and table.primary_key == ("probe",) and table.computed == {"depth_cm": "depth_m * 100"}
    got = spark.table("probes").collect()
    assert len(got) == 12 and {r["unit"] for r in got} <= {"km", "m", "ft"} and all(r["depth_cm"] == 100 * r["depth_m"] and 3 <= r["depth_m"] <= 40 for r in got)
    assert spark.table("probes").columns == ["probe", "depth_m", "unit", "seen", "depth_cm"]


def test_statements(spark, tmp_path):
    from tidemark.streaming.run import shared_folder

    spark.createDataFrame([(i, "ab"[i % 2], at(i)) for i in range(6)], "id long, k string, ts timestamp").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(99, "z", at(9))], "id long, k string, ts timestamp").write.parquet(f"{tmp_path}/other")
    catalog = Catalog(spark)
    run = lambda text, **k: sqlfront.run(catalog, text, **k)
    run(f"CREATE TABLE src (id BIGINT, k STRING, ts TIMESTAMP(3), twice AS id * 2, WATERMARK FOR ts AS ts - INTERVAL '5' SECOND, PRIMARY KEY (id) NOT ENFORCED) WITH ('connector' = 'filesystem', 'path' = '{tmp_path}/in')")
    run(f"CREATE TABLE dst (name STRING, n BIGINT) PARTITIONED BY (name) WITH ('connector' = 'filesystem', 'path' = '{tmp_path}/out');")
    run("CREATE TABLE hole (id BIGINT) WITH ('connector' = 'blackhole')")
    assert [r["name"] for r in run("SHOW TABLES").collect()] == ["dst", "hole", "src"]
    assert [tuple(r) for r in run("DESCRIBE src").collect()] == [("id", "bigint", True, False, False), ("k", "string", False, False, False), ("ts", "timestamp", False, False, True), ("twice", "bigint", False, True, False)]
    assert run("DESCRIBE hole").count() == 1 and "Scan" in run("EXPLAIN PLAN FOR SELECT * FROM src").first()["plan"]
    assert run(f"SELECT * FROM src /*+ OPTIONS('path'='{tmp_path}/other') */ WHERE src.id > 5;").count() == 1
    assert run(f"SELECT x.id FROM src /*+ OPTIONS('path'='{tmp_path}/other') */ AS x").count() == 1 and run("SELECT * FROM src").count() == 6
    for _ in range(2):
        run("INSERT INTO dst SELECT k, count(*) FROM src GROUP BY k")
    assert sorted((r["name"], r["n"]) for r in run("SELECT name, n FROM dst").collect()) == [("a", 3), ("a", 3), ("b", 3), ("b", 3)]
    run("INSERT OVERWRITE dst SELECT k, sum(twice) FROM src GROUP BY k")
    assert sorted((r["name"], r["n"]) for r in run("SELECT name, n FROM dst").collect()) == [("a", 12), ("b", 18)]
    with pytest.raises(ValueError, match="2 columns"):
        run("INSERT INTO dst SELECT k FROM src")
    run("SET 'execution.runtime-mode' = 'streaming'")
    run(f"CREATE TABLE live (name STRING, n BIGINT) WITH ('connector' = 'filesystem', 'path' = '{tmp_path}/live')")
    q = run("INSERT INTO live SELECT k, id FROM src", checkpoint=shared_folder(spark))
    q.processAllAvailable()
    q.stop()
    run("SET 'execution.runtime-mode' = 'batch'")
    assert run("SELECT * FROM live").count() == 6
    run(f"ALTER TABLE live SET ('path' = '{tmp_path}/other')")
    assert catalog.tables["live"].options["path"].endswith("other")
    run("DROP TABLE hole")
    run("DROP TABLE IF EXISTS hole")
    with pytest.raises(KeyError):
        run("DROP TABLE hole")


def test_time_columns_of_group_windows(t):
    assert t("SELECT TUMBLE_ROWTIME(ts, INTERVAL '5' SECOND) AS r, count(*) FROM t GROUP BY TUMBLE(ts, INTERVAL '5' SECOND)")[0] == (at(5) - timedelta(milliseconds=1), 3)
    assert t("SELECT HOP_ROWTIME(ts, INTERVAL '5' SECOND, INTERVAL '10' SECOND) AS r FROM t WHERE id = 4 GROUP BY HOP(ts, INTERVAL '5' SECOND, INTERVAL '10' SECOND)") == [(at(15) - timedelta(milliseconds=1),), (at(20) - timedelta(milliseconds=1),)]
    assert t("SELECT SESSION_ROWTIME(ts, INTERVAL '5' SECOND) AS e FROM t GROUP BY SESSION(ts, INTERVAL '5' SECOND)") == [(at(16) - timedelta(milliseconds=1),), (at(35) - timedelta(milliseconds=1),)]
    made = t("SELECT TUMBLE_PROCTIME(ts, INTERVAL '5' SECOND) AS p FROM t GROUP BY TUMBLE(ts, INTERVAL '5' SECOND)")
    assert len(made) == 4 and len(set(made)) == 1 and made[0][0] > at(0)
