"""Time windows, count windows and analytic functions over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sqlfront
from ..operators import rank, windows
from .registry import query, table, views


@query("""
SELECT event_type, time_bucket(INTERVAL '10 minutes', ts) AS window_start,
       time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end,
       count(*) AS n, round(sum(value), 6) AS total, count(DISTINCT user_id) AS users
FROM events GROUP BY 1, 2, 3
""")
def w_tumble(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "events").groupBy("event_type", windows.tumble("ts", "10 minutes"))
    return windows.spread(grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.count_distinct("user_id").alias("users")))


@query("""
SELECT event_id, time_bucket(INTERVAL '1 minute', ts) AS window_start, time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS window_end,
       time_bucket(INTERVAL '1 minute', ts) + INTERVAL '59.999 seconds' AS window_time FROM events
""")
def w_tvf_rows(spark: SparkSession, d: str) -> DataFrame:
    return windows.with_window(table(spark, d, "events").select("event_id", "ts"), F.window("ts", "1 minute")).drop("ts")


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' - INTERVAL '1 millisecond' AS window_time, count(*) AS n
FROM events GROUP BY 1, 2
""")
def w_window_time(spark: SparkSession, d: str) -> DataFrame:
    out = windows.spread(table(spark, d, "events").groupBy(windows.tumble("ts", "1 hour")).agg(F.count("*").alias("n")))
    return out.select("window_start", (F.col("window_end") - F.expr("INTERVAL '0.001' SECOND")).alias("window_time"), "n")


@query("""
SELECT time_bucket(INTERVAL '20 minutes', ts) - i * INTERVAL '20 minutes' AS window_start,
       time_bucket(INTERVAL '20 minutes', ts) - i * INTERVAL '20 minutes' + INTERVAL '60 minutes' AS window_end, event_type, count(*) AS n
FROM events, (VALUES (0), (1), (2)) s(i) GROUP BY 1, 2, 3
""")
def w_hop(spark: SparkSession, d: str) -> DataFrame:
    return windows.spread(table(spark, d, "events").groupBy(windows.hop("ts", "20 minutes", "60 minutes"), "event_type").agg(F.count("*").alias("n")))


_SESSIONS = """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events {where} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM m)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '1 hour' AS window_end, count(*) AS n FROM s GROUP BY user_id, sid
"""


@query(_SESSIONS.format(where=""))
def w_session(spark: SparkSession, d: str) -> DataFrame:
    return windows.spread(table(spark, d, "events").groupBy("user_id", windows.session("ts", "1 hour")).agg(F.count("*").alias("n")))


@query(_SESSIONS.format(where="WHERE event_type = 'error'"))
def w_prefilter_session(spark: SparkSession, d: str) -> DataFrame:
    errors = table(spark, d, "events").where("event_type = 'error'")
    return windows.spread(errors.groupBy("user_id", windows.session("ts", "1 hour")).agg(F.count("*").alias("n")))


@query("""
SELECT time_bucket(INTERVAL '20 minutes', t) AS window_start, time_bucket(INTERVAL '20 minutes', t) + INTERVAL '20 minutes' AS window_end,
       CAST(sum(n) AS BIGINT) AS n, count(*) AS parts
FROM (SELECT time_bucket(INTERVAL '10 minutes', ts) AS t, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1, 2
""")
def w_chained(spark: SparkSession, d: str) -> DataFrame:
    """Ten-minute counts in windows of twenty."""
    ten = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(windows.tumble("ts", "10 minutes"), "event_type").agg(F.count("*").alias("n"))
    twenty = ten.groupBy(F.window(F.window_time("w"), "20 minutes").alias("w")).agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    return windows.spread(twenty).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT date_trunc('second', ts) AS second, count(*) AS n FROM events GROUP BY 1")
def w_floor_second(spark: SparkSession, d: str) -> DataFrame:
    second = F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("second")
    return table(spark, d, "events").groupBy(second).agg(F.count("*").alias("n"))


@query("""
SELECT user_id, CAST(b AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 6) AS total
FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 2 AS b FROM events) GROUP BY 1, 2 HAVING count(*) = 2
""")
def w_count_window(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.count_windows(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 2)
    return rows.groupBy("user_id", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""
SELECT window_start, window_end, count(*) AS n FROM (
  SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' + i * INTERVAL '6 hours' AS window_end
  FROM events, (VALUES (0), (1), (2), (3)) s(i)) WHERE window_end <= window_start + INTERVAL '1 day' GROUP BY 1, 2
""")
def w_cumulate(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.cumulate(table(spark, d, "events").select("ts"), "ts", "6 hours", "1 day")
    return rows.groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@query("""
SELECT '5 minutes' AS size, time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT '1 hour', time_bucket(INTERVAL '1 hour', ts), count(*) FROM events GROUP BY 2
""")
def w_multi_output(spark: SparkSession, d: str) -> DataFrame:
    """Two window sizes over one source."""
    e = table(spark, d, "events")
    sized = lambda s: windows.spread(e.groupBy(windows.tumble("ts", s)).agg(F.count("*").alias("n"))).select(F.lit(s).alias("size"), "window_start", "n")
    return sized("5 minutes").union(sized("1 hour"))


@query("""
SELECT sensor, window_start, count(*) AS n, round(avg(t), 6) AS mean, round(min(t), 6) AS low, round(max(t), 6) AS high
FROM (SELECT 'sensor_' || CAST(user_id % 10 AS VARCHAR) AS sensor, time_bucket(INTERVAL '1 hour', ts) AS window_start, 65 + value / 100 * 20 AS t FROM events WHERE value IS NOT NULL) GROUP BY 1, 2
""")
def w_process(spark: SparkSession, d: str) -> DataFrame:
    """All a window function sees, as incremental aggregates with the window's bounds."""
    rows = table(spark, d, "events").where("value is not null").select("ts", F.concat(F.lit("sensor_"), (F.col("user_id") % 10).cast("string")).alias("sensor"), (65 + F.col("value") / 100 * 20).alias("t"))
    out = rows.groupBy("sensor", windows.tumble("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean"), F.round(F.min("t"), 6).alias("low"), F.round(F.max("t"), 6).alias("high"))
    return windows.spread(out).drop("window_end")


@query("""
SELECT window_start, event_type, n FROM (
  SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) ORDER BY window_start, n DESC
""")
def t_sorted_window(spark: SparkSession, d: str) -> DataFrame:
    out = windows.spread(table(spark, d, "events").groupBy(windows.tumble("ts", "1 day"), "event_type").agg(F.count("*").alias("n")))
    return out.drop("window_end").orderBy("window_start", F.desc("n"))


# analytic functions


@query("""
SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS high, round(min(value) OVER w, 6) AS low
FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW)
""")
def o_range_frame(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "events")
    return spark.sql("""
      SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS high, round(min(value) OVER w, 6) AS low
      FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW)
    """)


@query("""
SELECT event_type, user_id, n, CAST(r AS INTEGER) AS rownum FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r <= 2
""")
def o_topn(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return rank.top_n(counts, ["event_type"], [F.desc("n"), F.col("user_id")], 2)


_DEDUP = "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts {0}, event_id {0}) AS r FROM events) WHERE r = 1"


@query(_DEDUP.format("ASC"))
def o_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return rank.deduplicate(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


@query(_DEDUP.format("DESC"))
def o_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return rank.deduplicate(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], keep="last")


@query("""
SELECT window_start, window_end, user_id, n, CAST(r AS INTEGER) AS rownum FROM (
  SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, user_id) AS r FROM (
    SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, user_id, count(*) AS n FROM events GROUP BY 1, 2, 3)) WHERE r <= 3
""")
def o_window_topn(spark: SparkSession, d: str) -> DataFrame:
    counts = windows.spread(table(spark, d, "events").groupBy(windows.tumble("ts", "1 day"), "user_id").agg(F.count("*").alias("n")))
    return rank.window_top_n(counts, [F.desc("n"), F.col("user_id")], 3)


@query("""
SELECT event_id, CASE WHEN value > p THEN 'up' WHEN value < p THEN 'down' WHEN value = p THEN 'same' END AS trend
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
""")
def o_lag_trend(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "events")
    return spark.sql("""
      SELECT event_id, CASE WHEN value > p THEN 'up' WHEN value < p THEN 'down' WHEN value = p THEN 'same' END AS trend
      FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    """)


@query("""
SELECT event_type, count(*) AS users FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) GROUP BY event_type
""")
def o_latest_then_agg(spark: SparkSession, d: str) -> DataFrame:
    """Users by their last event."""
    last = rank.latest_by_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return last.groupBy("event_type").agg(F.count("*").alias("users"))


@query("""
SELECT event_id, round(sum(value) OVER w, 6) AS total, round(max(value) OVER w, 6) AS high FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def a_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Rolling sum and running maximum, a row for each row."""
    out = windows.running(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], total=F.sum("value"), high=F.max("value"))
    return out.select("event_id", F.round("total", 6).alias("total"), F.round("high", 6).alias("high"))


@query("""
SELECT user_id, window_start, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far
FROM (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2)
""")
def a_cumulative_over_windows(spark: SparkSession, d: str) -> DataFrame:
    counts = windows.spread(table(spark, d, "events").groupBy("user_id", windows.tumble("ts", "1 day")).agg(F.count("*").alias("n")))
    return windows.running(counts, ["user_id"], ["window_start"], so_far=F.sum("n")).drop("window_end")


@query("""
SELECT event_type, b AS started, b + INTERVAL '10 minutes' AS ended, b + INTERVAL '599.999 seconds' AS at, count(*) AS n
FROM (SELECT *, time_bucket(INTERVAL '10 minutes', ts) AS b FROM events) GROUP BY event_type, b
""")
def w_legacy_tumble(spark: SparkSession, d: str) -> DataFrame:
    """Group windows as statements write them, with their start, end and time columns."""
    views(spark, d, "events")
    size = "INTERVAL '10' MINUTE"
    return sqlfront.sql(spark, f"SELECT event_type, TUMBLE_START(ts, {size}) AS started, TUMBLE_END(ts, {size}) AS ended, TUMBLE_ROWTIME(ts, {size}) AS at, count(*) AS n FROM events GROUP BY event_type, TUMBLE(ts, {size})")


@query("""
SELECT event_type, b - i * INTERVAL '10 minutes' AS started, b - i * INTERVAL '10 minutes' + INTERVAL '30 minutes' AS ended, count(*) AS n, round(sum(value), 6) AS total
FROM (SELECT *, time_bucket(INTERVAL '10 minutes', ts) AS b FROM events), (VALUES (0), (1), (2)) s(i) GROUP BY 1, 2, 3
""")
def w_legacy_hop(spark: SparkSession, d: str) -> DataFrame:
    """Hopping group windows: slide first, then size."""
    views(spark, d, "events")
    window = "ts, INTERVAL '10' MINUTE, INTERVAL '30' MINUTE"
    return sqlfront.sql(spark, f"SELECT event_type, HOP_START({window}) AS started, HOP_END({window}) AS ended, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type, HOP({window})")


@query("""
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL '1 hour' AS ended, count(*) AS n
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, sid
""")
def w_legacy_session(spark: SparkSession, d: str) -> DataFrame:
    """Session group windows by user."""
    views(spark, d, "events")
    window = "ts, INTERVAL '1' HOUR"
    return sqlfront.sql(spark, f"SELECT user_id, SESSION_START({window}) AS started, SESSION_END({window}) AS ended, count(*) AS n FROM events GROUP BY user_id, SESSION({window})")
