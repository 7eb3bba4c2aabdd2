"""Scalar functions, user functions and word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import udfs
from ..operators.incremental import LastReadings, WeightedMean, incremental
from .registry import query, table


@query("SELECT page_id, nullif(regexp_extract(url, '[a-z]+://[^/]+'), '') AS origin FROM pages")
def f_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.regexp_extract(F.col("url"), "[a-z]+://[^/]+").alias("origin"))


@query("SELECT page_id, replace(url, 'https://', 'http://') AS url, 'page ' || CAST(page_id AS VARCHAR) AS title, upper(substr(url, 1, 5)) AS head FROM pages")
def f_replace_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.replace("url", F.lit("https://"), F.lit("http://")).alias("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.upper(F.substring("url", 1, 5)).alias("head"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def f_strmap(spark: SparkSession, d: str) -> DataFrame:
    """Columns packed as text and read back as a map."""
    packed = F.concat(F.lit("kind:"), F.col("event_type"), F.lit(";who:"), F.col("user_id").cast("string"))
    m = table(spark, d, "events").select("event_id", S.str_to_map(packed).alias("m"))
    return m.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["who"].alias("who"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f_json_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.json_value(F.col("props"), "$.k").alias("k"))


@query("SELECT event_id, coalesce(json_exists(props, '$.k'), false) AS has_k, coalesce(json_exists(props, '$.none'), false) AS has_none FROM events")
def f_json_exists(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return table(spark, d, "events").select("event_id", S.json_exists(p, "$.k").alias("has_k"), S.json_exists(p, "$.none").alias("has_none"))


@query("SELECT event_id, coalesce(json_valid(props), false) AS valid, coalesce(json_valid(event_type), false) AS word_valid FROM events")
def f_is_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.is_json(F.col("props")).alias("valid"), S.is_json(F.col("event_type")).alias("word_valid"))


@query("""SELECT event_id, '[{"a":' || CAST(user_id AS VARCHAR) || '}]' AS found FROM events""")
def f_json_query(spark: SparkSession, d: str) -> DataFrame:
    """Objects found by a wildcard path, wrapped even when there is one."""
    doc = F.concat(F.lit('{"xs":[{"in":{"a":'), F.col("user_id").cast("string"), F.lit("}}]}"))
    return table(spark, d, "events").select("event_id", S.json_query(doc, "$.xs[*].in").alias("found"))


@query("""SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS object, '["' || n_name || '","' || n_regionkey || '"]' AS list FROM nation""")
def f_json_object(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.json_object(key=F.col("n_nationkey"), name=F.col("n_name")).alias("object"), S.json_array(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("list"))


@query("""
SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS by_name, '["' || string_agg(n_name, '","' ORDER BY n_name) || '"]' AS names
FROM nation GROUP BY n_regionkey
""")
def f_json_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(S.json_objectagg(F.col("n_name"), F.col("n_nationkey")).alias("by_name"), S.json_arrayagg(F.col("n_name")).alias("names"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, CAST(extract(year FROM ts) AS INTEGER) AS year, CAST(extract(month FROM ts) AS INTEGER) AS month, CAST(extract(day FROM ts) AS INTEGER) AS day FROM events")
def f_datefmt(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("dt"), F.date_format(ts, "HH").alias("hour"), F.date_format(ts, "mm").alias("minute"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"))


@query("SELECT event_id, strftime(ts, '%G%V') AS year_week FROM events")
def f_yearweek(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.year_week(F.col("ts")).alias("year_week"))


@query("SELECT o_orderkey, l_linenumber, CAST(date_sub('day', o_orderdate, l_shipdate) AS BIGINT) AS days, CAST(date_sub('hour', o_orderdate, l_shipdate) AS BIGINT) AS hours FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def f_tsdiff(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", "l_linenumber", F.timestamp_diff("DAY", F.col("o_orderdate"), F.col("l_shipdate")).alias("days"), F.timestamp_diff("HOUR", F.col("o_orderdate"), F.col("l_shipdate")).alias("hours"))


@query("SELECT event_id, ts + INTERVAL 90 MINUTE AS later, ts - INTERVAL 3 DAY AS earlier FROM events")
def f_tsadd(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.timestamp_add("MINUTE", F.lit(90), F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("later"), (F.col("ts") - F.expr("INTERVAL '3' DAY")).alias("earlier"))


@query("""
SELECT event_id, strftime(timezone(CASE WHEN user_id % 2 = 0 THEN 'Europe/Berlin' ELSE 'America/New_York' END, ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM events
""")
def f_tz(spark: SparkSession, d: str) -> DataFrame:
    """Local times of each row's own zone, in UTC."""
    zone = F.when(F.col("user_id") % 2 == 0, "Europe/Berlin").otherwise("America/New_York")
    return table(spark, d, "events").select("event_id", S.convert_tz(F.col("ts"), zone, F.lit("UTC")).alias("utc"))


@query("SELECT event_id, strftime(make_timestamp(CAST(1704067200 + event_id AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS at, make_timestamp(CAST(1704067200 + event_id AS BIGINT) * 1000000) AS ts FROM events")
def f_unixtime(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("event_id") + 1704067200
    return table(spark, d, "events").select("event_id", F.from_unixtime(s).alias("at"), F.timestamp_millis(s * 1000).cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id, CAST('2024-03-05 01:02:03' AS TIMESTAMP) + to_seconds(event_id) AS ts, DATE '2024-03-05' AS day FROM events")
def f_to_timestamp(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_timestamp(F.lit("05/03/2024 01:02:03"), "dd/MM/yyyy HH:mm:ss")
    return table(spark, d, "events").select("event_id", F.timestamp_add("SECOND", F.col("event_id"), at).cast("timestamp_ntz").alias("ts"), F.to_date(F.lit("2024-03-05")).alias("day"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) // 7 AS q FROM lineitem")
def f_intdiv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.int_div(F.floor("l_extendedprice"), F.lit(7)).cast("long").alias("q"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS whole, abs(l_discount - 0.05) < 0.011 AS near, round(abs(l_tax - l_discount), 2) AS gap, l_orderkey % 7 AS rest FROM lineitem")
def f_round(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("whole"), (F.abs(F.col("l_discount") - 0.05) < 0.011).alias("near"), F.round(F.abs(F.col("l_tax") - F.col("l_discount")), 2).alias("gap"), (F.col("l_orderkey") % 7).alias("rest"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS text, CAST(l_extendedprice AS DECIMAL(12, 2)) AS price, TRY_CAST(l_returnflag AS INTEGER) AS no FROM lineitem")
def f_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("text"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_returnflag").try_cast("int").alias("no"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) AS key, user_id AS who, strftime(make_timestamp(CAST(1704067200000 + event_id AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events""")
def f_decode_record(spark: SparkSession, d: str) -> DataFrame:
    """Base64 keys and values of topic records, decoded."""
    key = F.base64(F.col("event_id").cast("string").cast("binary"))
    value = F.base64(F.to_json(F.struct(F.col("user_id").alias("who"))).cast("binary"))
    r = table(spark, d, "events").select("event_id", S.decode_record(key, value, F.col("event_id") + 1704067200000, "who long").alias("r"))
    return r.select("event_id", "r.key", F.col("r.value.who").alias("who"), F.col("r.ts").alias("at"))


@query("SELECT c_custkey, s.x.name AS name, s.x.balance AS balance FROM (SELECT c_custkey, {'x': {'name': c_name, 'balance': c_acctbal}} AS s FROM customer)")
def f_fields(spark: SparkSession, d: str) -> DataFrame:
    s = F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("x")).alias("s")
    return table(spark, d, "customer").select("c_custkey", s).select("c_custkey", "s.x.name", "s.x.balance")


# user functions

_CITY = "CASE WHEN user_id % 3 = 0 THEN 'Chicago' WHEN user_id % 3 = 1 THEN 'Seattle' ELSE 'Berlin' END"
_LON, _LAT = "(-74.1 + (event_id % 500) * 0.001)", "(40.4 + (user_id % 700) * 0.001)"


@query(f"SELECT event_id, round(CASE WHEN {_CITY} IN ('Chicago', 'Portland', 'Seattle', 'New York') THEN value * 9 / 5 + 32 ELSE value END, 6) AS shown FROM events")
def n_to_fahr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(udfs.to_fahr(F.expr(_CITY), F.col("value")), 6).alias("shown"))


@query(f"SELECT event_id, round(CASE WHEN {_CITY} IN ('Chicago', 'Portland', 'Seattle', 'New York') THEN value * 9 / 5 + 32 ELSE value END, 6) AS shown, 'NYCTAXI' AS source FROM events WHERE value IS NOT NULL")
def n_registered(spark: SparkSession, d: str) -> DataFrame:
    """The same through the registered functions, from SQL."""
    udfs.register(spark)
    table(spark, d, "events").createOrReplaceTempView("events_for_udf")
    return spark.sql(f"SELECT event_id, round(to_fahr({_CITY}, value), 6) AS shown, add_source() AS source FROM events_for_udf WHERE value IS NOT NULL")


@query("SELECT p_partkey, word, CAST(length(word) AS INTEGER) AS length FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def n_udtf_split(spark: SparkSession, d: str) -> DataFrame:
    udfs.register(spark)
    table(spark, d, "part").createOrReplaceTempView("part_for_udtf")
    return spark.sql("SELECT p_partkey, w.word, w.length FROM part_for_udtf, LATERAL split_words(p_name) w")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def n_udaf_mean(spark: SparkSession, d: str) -> DataFrame:
    """A weighted mean from built-in aggregates, which combine before the shuffle."""
    total = F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(total, 4).alias("mean"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value * event_id) / sum(event_id), 6) AS mean, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def n_incremental_mean(spark: SparkSession, d: str) -> DataFrame:
    """A user's own aggregate, by event type and day: accumulators combine in each task and merge after the shuffle."""
    rows = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value", F.col("event_id").alias("weight"))
    out = incremental(rows, ["event_type", "day"], ["value", "weight"], WeightedMean(), "mean double, n long")
    return out.select("event_type", "day", F.round("mean", 6).alias("mean"), "n")


@query("SELECT 'all' AS key, count(*) AS n, min(value) AS lowest, max(value) AS highest, arg_max(value, ts) AS last FROM events WHERE value IS NOT NULL")
def n_incremental_one_key(spark: SparkSession, d: str) -> DataFrame:
    """The same of one key that holds every row."""
    rows = table(spark, d, "events").select(F.lit("all").alias("key"), "ts", "value")
    return incremental(rows, ["key"], ["ts", "value"], LastReadings(), "n long, lowest double, highest double, last double")


@query(f"""
SELECT event_id, NOT ({_LON} > -73.7 OR {_LON} < -74.05) AND NOT ({_LAT} > 41.0 OR {_LAT} < 40.5) AS inside,
       CAST(floor((74.05 - abs({_LON})) / 0.0014) + floor((41.0 - {_LAT}) / 0.00125) * 250 AS INTEGER) AS cell FROM
(SELECT event_id, user_id FROM events)
""".replace("-74.1 +", "CAST(-74.1 AS DOUBLE) +").replace("40.4 +", "CAST(40.4 AS DOUBLE) +").replace("0.001)", "CAST(0.001 AS DOUBLE))").replace("74.05 - abs", "CAST(74.05 AS DOUBLE) - abs").replace("/ 0.0014", "/ CAST(0.0014 AS DOUBLE)").replace("/ 0.00125", "/ CAST(0.00125 AS DOUBLE)").replace("(41.0 -", "(CAST(41.0 AS DOUBLE) -"))
def n_geo_cell(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.lit(-74.1) + (F.col("event_id") % 500) * F.lit(0.001), F.lit(40.4) + (F.col("user_id") % 700) * F.lit(0.001)
    return table(spark, d, "events").select("event_id", udfs.in_nyc(lon, lat).alias("inside"), udfs.area_id(lon, lat).alias("cell"))


@query("""
SELECT p_partkey, round(CAST(-(74.05::DOUBLE - (p_partkey % 250) * 0.0014::DOUBLE - 0.0007::DOUBLE) AS FLOAT), 3) AS lon,
       round(CAST(41.0::DOUBLE - ((p_partkey - p_partkey % 250) / 250) * 0.00125::DOUBLE - 0.000625::DOUBLE AS FLOAT), 3) AS lat FROM part
""")
def n_geo_coords(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select("p_partkey", udfs.area_coords(F.col("p_partkey")).alias("c"))
    return c.select("p_partkey", F.round("c.lon", 3).alias("lon"), F.round("c.lat", 3).alias("lat"))


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM documents) GROUP BY word")
def wc_wordcount(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(S.words(F.lower("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts <= now()::TIMESTAMP AS past, true AS in_range, CAST(floor(value) AS BIGINT) AS whole FROM events")
def f_now_rand(spark: SparkSession, d: str) -> DataFrame:
    """The clock and random numbers: by what must hold of them in each row."""
    r = F.rand(7)
    e = table(spark, d, "events").withColumn("_r", r)
    return e.select("event_id", (F.col("ts") <= F.current_timestamp()).alias("past"), ((F.col("_r") >= 0) & (F.col("_r") < 1)).alias("in_range"), F.floor("value").alias("whole"))
