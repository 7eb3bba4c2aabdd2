"""Sources, sinks and table definitions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sqlfront
from ..operators import rank
from ..sources import changes, sinks
from ..sources.fake import FakeDataSource
from ..sources.rolling import RollingSource
from ..sources.tables import Catalog, TableDef
from ..sources.topics import Topic
from ..streaming.run import shared_folder
from .registry import query, table


@query()
def s_fake(spark: SparkSession, d: str) -> DataFrame:
    """Seeded fake rows: numbers, dates, options, patterns, ids and arrays."""
    spark.dataSource.register(FakeDataSource)
    fields = {
        "id": "#{Internet.uuid}", "code": "#{regexify '(EUR|USD|CHF){1}'}", "price": "#{Number.randomDouble '2','1','150'}", "n": "#{number.numberBetween '0','1000'}",
        "at": "#{date.past '30','SECONDS'}", "who": "#{numerify 'user_##'}", "ip": "#{Internet.publicIpV4Address}", "kind": "#{Options.option 'a','b','c'}", "tags": "#{harry_potter.spell}",
    }
    reader = spark.read.format("fake").schema("id string, code string, price double, n int, at timestamp, who string, ip string, kind string, tags array<string>")
    for name, expression in fields.items():
        reader = reader.option(f"fields.{name}", expression)
    return reader.option("fields.tags.length", 3).option("fields.kind.null-rate", 0.1).option("number-of-rows", 1000).load()


@query("SELECT event_id AS id, event_id * 2 AS twice, event_type FROM events")
def s_datagen(spark: SparkSession, d: str) -> DataFrame:
    """A bounded sequence generator, as long as the events' ids reach, joined to them."""
    events = table(spark, d, "events").select("event_id", "event_type")
    end = events.agg(F.max("event_id")).first()[0]
    sequence = spark.range(0 if end is None else end + 1).select("id", (F.col("id") * 2).alias("twice"))
    return sequence.join(events, F.col("id") == F.col("event_id")).select("id", "twice", "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 10 <> 0")
def s_json_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """JSON records through a topic; every tenth is broken and left out."""
    topic = Topic("events", directory=shared_folder(spark))
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    record = topic.encode(e, ["event_id"])
    broken = record.withColumn("value", F.when(F.get_json_object("key", "$.event_id").cast("long") % 10 == 0, F.substring("value", 1, 9)).otherwise(F.col("value")))
    broken.write.json(f"{topic.directory}/{topic.name}")
    return topic.rows(spark, "event_id long, user_id long, value double")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def s_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An upsert table: the last row of each key."""
    return rank.latest_by_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_type")


_CHANGES = "SELECT o_custkey AS k, o_orderdate AS ts, o_orderkey AS n, o_orderstatus = 'F' AS deleted, round(o_totalprice, 2) AS price FROM orders"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a customer's change records: a tombstone for each finished one."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("n"), (F.col("o_orderstatus") == "F").alias("deleted"), F.round("o_totalprice", 2).alias("price"))
    return changes.encoded(o, ["k"], deleted="deleted", raw_key=True, beside=["ts", "n"])


@query(f"WITH c AS ({_CHANGES}) SELECT k, n, price FROM (SELECT k, arg_max(deleted, (ts, n)) AS deleted, arg_max(n, (ts, n)) AS n, arg_max(price, (ts, n)) AS price FROM c GROUP BY k) WHERE NOT deleted")
def s_upsert_deletes(spark: SparkSession, d: str) -> DataFrame:
    """A keyed change stream with tombstones, kept as a table in two batches that rewrite only the buckets of their keys."""
    rows = changes.decoded(_records(spark, d), "k long", "price double", raw_key="k")
    path, half = shared_folder(spark), F.col("ts") < "1995-06-01"
    keep = changes.bucketed_upsert(path, ["k"], ["ts", "n"], buckets=16)
    for epoch, part in enumerate([rows.where(half), rows.where(~half)]):
        keep(part, epoch)
    return changes.read_bucketed(spark, path, "k long, price double, ts timestamp, n long").select("k", "n", "price")


@query(f"""
WITH c AS (SELECT k, ts, max(n) FILTER (NOT deleted) AS n FROM ({_CHANGES}) GROUP BY k, ts), l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate FROM lineitem)
SELECT l_orderkey, l_linenumber, c.n FROM l ASOF JOIN c ON l.l_suppkey = c.k AND l.l_shipdate >= c.ts WHERE c.n IS NOT NULL
""")
def s_upsert_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same change stream as a versioned table: a deletion ends a version."""
    rows = changes.decoded(_records(spark, d), "k long", "price double", raw_key="k")
    latest = rows.groupBy("k", "ts").agg(F.bool_and("deleted").alias("deleted"), F.max(F.when(~F.col("deleted"), F.col("n"))).alias("n"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    out = changes.asof_changes(line, latest, "l_suppkey", "l_shipdate", key="k", change_ts="ts", slice_s=90 * 86_400)
    return out.select("l_orderkey", "l_linenumber", "n")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def s_csv(spark: SparkSession, d: str) -> DataFrame:
    """One CSV file with a header, written and read with its schema."""
    path = shared_folder(spark)
    sinks.csv_file(path)(table(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal")))
    return spark.read.csv(path, header=True, schema="s_suppkey long, s_name string, s_acctbal double")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS dt FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05'")
def s_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Partitioned files, and a read that opens one partition only."""
    path = shared_folder(spark)
    rows = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.date_format("ts", "HH").alias("hour"))
    sinks.partitioned(path, ["dt", "hour"])(rows.repartition("dt", "hour"))
    return spark.read.schema("event_id long, dt string, hour string").parquet(path).where("dt = '2024-01-05'").select("event_id", "dt")


@query("""
SELECT 'a' AS sink, event_type, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'b', event_type, count(DISTINCT user_id) FROM events GROUP BY 2
""")
def k_statement_set(spark: SparkSession, d: str) -> DataFrame:
    """Two inserts of one source as one job."""
    path = shared_folder(spark)
    insert = lambda name, agg: (lambda e: e.groupBy("event_type").agg(agg.alias("n")).select(F.lit(name).alias("sink"), "event_type", "n"), lambda df: df.write.mode("append").parquet(path))
    sinks.statement_set(table(spark, d, "events"), [insert("a", F.count("*")), insert("b", F.count_distinct("user_id"))])
    return spark.read.schema("sink string, event_type string, n long").parquet(path)


_COUNTS = "SELECT user_id, count(*) AS n FROM events {0} GROUP BY user_id"


@query(f"""
WITH o AS ({_COUNTS.format("WHERE ts < TIMESTAMP '2024-01-15'")}), w AS ({_COUNTS.format("WHERE event_type <> 'error'")})
SELECT '+I' AS op, w.user_id, w.n FROM w LEFT JOIN o USING (user_id) WHERE o.user_id IS NULL
UNION ALL SELECT '-D', o.user_id, o.n FROM o LEFT JOIN w USING (user_id) WHERE w.user_id IS NULL
UNION ALL SELECT '-U', o.user_id, o.n FROM o JOIN w USING (user_id) WHERE o.n <> w.n
UNION ALL SELECT '+U', w.user_id, w.n FROM o JOIN w USING (user_id) WHERE o.n <> w.n
""")
def k_changelog(spark: SparkSession, d: str) -> DataFrame:
    """What changes between two states of a keyed result."""
    e = table(spark, d, "events")
    count = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"))
    return sinks.changelog(count(e.where("event_type <> 'error'")), count(e.where("ts < timestamp_ntz'2024-01-15'")), ["user_id"])


@query("""SELECT '{"data":[{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}],"type":"INSERT"}' AS value FROM nation""")
def k_canal_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.canal_json(table(spark, d, "nation").select(F.lit("+I").alias("op"), "n_nationkey", "n_name"))


@query("""SELECT '{"index":{"_index":"nations","_id":"' || n_nationkey || '"}}' || chr(10) || '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def k_bulk(spark: SparkSession, d: str) -> DataFrame:
    return sinks.bulk_lines(table(spark, d, "nation").select("n_nationkey", "n_name"), "nations", ["n_nationkey"])


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, '{"Item":{"n_nationkey":{"N":"' || n_nationkey || '"},"n_name":{"S":"' || n_name || '"}}}' AS value FROM nation""")
def k_put_item(spark: SparkSession, d: str) -> DataFrame:
    return sinks.put_item(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("SELECT event_id, user_id, event_type, user_id * 2 AS twice FROM events")
def d_table_def(spark: SparkSession, d: str) -> DataFrame:
    """A declared table with a computed column, read through the catalogue."""
    c = Catalog(spark)
    c.create(TableDef("declared_events", "event_id long, user_id long, event_type string", options={"path": f"{d}/events.parquet"}, computed={"twice": "user_id * 2"}))
    return spark.sql("SELECT * FROM declared_events")


@query("SELECT event_id, user_id FROM events")
def k_rolling_files(spark: SparkSession, d: str) -> DataFrame:
    """A text sink whose parts are closed after so many rows, read back."""
    spark.dataSource.register(RollingSource)
    path = shared_folder(spark)
    lines = table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id")).alias("value"))
    lines.write.format("rolling").options(path=path, prefix="events", suffix=".json", maxrows=1000).mode("append").save()
    return spark.read.schema("event_id long, user_id long").json(f"{path}/events-*.json")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * 2, 2) AS doubled FROM lineitem WHERE l_returnflag = 'R'")
def d_statements(spark: SparkSession, d: str) -> DataFrame:
    """Tables declared, altered, described and filled by statements alone."""
    catalog, path = Catalog(spark), shared_folder(spark)
    statements = [
        f"CREATE TABLE lines (l_orderkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, l_returnflag STRING, doubled AS round(l_extendedprice * 2, 2)) WITH ('connector' = 'filesystem', 'path' = '{d}/lineitem.parquet', 'format' = 'parquet')",
        f"CREATE TABLE returned (okey BIGINT, line INT, doubled DOUBLE, PRIMARY KEY (okey, line) NOT ENFORCED) WITH ('connector' = 'filesystem', 'path' = '{path}/nowhere', 'format' = 'json')",
        f"ALTER TABLE returned SET ('path' = '{path}/returned')",
        "CREATE TABLE nothing (n BIGINT) WITH ('connector' = 'blackhole')",
        "INSERT INTO nothing SELECT l_orderkey FROM lines",
        "DROP TABLE IF EXISTS nothing",
        f"INSERT OVERWRITE returned SELECT l_orderkey, l_linenumber, doubled FROM lines /*+ OPTIONS('path' = '{d}/lineitem.parquet') */ WHERE l_returnflag SIMILAR TO 'R'",
    ]
    for text in statements:
        sqlfront.run(catalog, text)
    return sqlfront.run(catalog, "SELECT okey AS l_orderkey, line AS l_linenumber, doubled FROM returned")


@query("SELECT c_custkey, upper(c_mktsegment) AS segment, CAST(len(c_name) AS INTEGER) AS n FROM customer")
def s_text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text files, split into fields: written a line a customer, read as a static set of files."""
    path = shared_folder(spark)
    sinks.text_files(path)(table(spark, d, "customer").select(F.concat_ws("\t", "c_custkey", "c_mktsegment", "c_name").alias("value")))
    fields = F.split("value", "\t")
    return spark.read.text(path, lineSep="\n").select(fields[0].cast("long").alias("c_custkey"), F.upper(fields[1]).alias("segment"), F.length(fields[2]).alias("n"))


@query("SELECT user_id, 1 AS tasks FROM events GROUP BY user_id")
def s_parallelism(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt by key to a set number of tasks: each key meets in one."""
    dealt = table(spark, d, "events").select("user_id").repartition(16, "user_id").withColumn("task", F.spark_partition_id())
    return dealt.groupBy("user_id").agg(F.count_distinct("task").cast("int").alias("tasks"))
