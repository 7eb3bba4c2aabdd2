"""Streaming twins: the batch queries' results from ``readStream``, run to the end of the input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.incremental import LastReadings, incremental_stream
from ..sources.sinks import fold
from ..streaming import processors as P
from ..streaming.late import late_windows
from ..streaming.order import in_order
from ..streaming.packed import pack
from ..streaming.run import finish, read_stream, stepwise
from ..streaming.star import Dimension, Role, assembled, resolved
from ..streaming.topn import top_counts
from .registry import query, table


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: df[f.name].cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


@query("SELECT event_type, time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def x_tumble_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a stream in complete mode, which holds the open ones too."""
    e = read_stream(spark, d, "events").withWatermark("ts", "5 seconds")
    out = e.groupBy("event_type", windows.tumble("ts", "10 minutes")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return _plain(finish(windows.spread(out).drop("window_end"), "complete"))


@query("SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '1 hour' AS window_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, sid HAVING max(ts) + INTERVAL '1 hour' <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '5 seconds' FROM events)")
def x_session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions in append mode: those that the watermark has passed."""
    e = read_stream(spark, d, "events").withWatermark("ts", "5 seconds")
    return _plain(finish(windows.spread(e.groupBy("user_id", windows.session("ts", "1 hour")).agg(F.count("*").alias("n")))))


@query("SELECT event_type, count(*) AS users FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type")
def x_distinct_stream(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts: pairs deduplicated in a stream, whose state holds every pair, and counted once it has ended."""
    e = read_stream(spark, d, "events").select("event_type", "user_id").dropDuplicates(["event_type", "user_id"])
    seen = finish(e)
    return seen.groupBy("event_type").agg(F.count("*").alias("users"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def x_interval_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream-stream join whose bounds limit its state."""
    o = read_stream(spark, d, "orders").withWatermark("o_orderdate", "1 hour")
    line = read_stream(spark, d, "lineitem").withWatermark("l_shipdate", "1 hour")
    on = F.expr("o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAYS")
    return finish(o.join(line, on).select("o_orderkey", "l_linenumber"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY")
def x_inequality_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream-stream join by key where one side's time comes after the other's; its state has no bound.

    An order's lines of a micro-batch enter the state as one row, since that costs by the
    row; times are compared once the lines have met their order and stand apart again.
    """
    o = read_stream(spark, d, "orders").select("o_orderkey", "o_orderdate")
    line = read_stream(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").where("l_orderkey is not null")
    met = o.join(pack(line, ["l_orderkey"], 1 << 20), F.expr("o_orderkey = l_orderkey"))
    lines = met.select("o_orderkey", "o_orderdate", F.inline(F.arrays_zip("l_linenumber", "l_shipdate")))
    return finish(lines.where("timestamp_micros(l_shipdate) > o_orderdate + INTERVAL 60 DAYS").select("o_orderkey", "l_linenumber"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def x_lookup_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream against a static table."""
    table = spark.read.parquet(f"{d}/customer.parquet")
    return finish(read_stream(spark, d, "orders").join(table, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment"))


@query("SELECT user_id AS key, ts, round(p, 6) AS before, round(value, 6) AS value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE value IS NOT NULL) WHERE abs(value - p) > 50")
def x_change_alert_stream(spark: SparkSession, d: str) -> DataFrame:
    """Keyed state: values that jump from their key's last one."""
    e = read_stream(spark, d, "events").where("value is not null").select("user_id", "ts", "value")
    out = finish(P.apply(e, ["user_id"], P.ChangeAlert("value", 50.0), "key long, ts timestamp, before double, value double", "update"))
    return _plain(out.select("key", "ts", F.round("before", 6).alias("before"), F.round("value", 6).alias("value")))


@query("SELECT user_id AS key, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS total FROM events WHERE value IS NOT NULL")
def x_rolling_sum_stream(spark: SparkSession, d: str) -> DataFrame:
    e = read_stream(spark, d, "events").where("value is not null").select("user_id", "ts", "value")
    out = finish(P.apply(e, ["user_id"], P.RunningSum("value"), "key long, ts timestamp, total double", "update"))
    return _plain(out.select("key", "ts", F.round("total", 6).alias("total")))


@query("""
SELECT user_id AS key, b AS bucket, CAST(count(*) AS INTEGER) AS n, round(sum(value), 6) AS total
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // 2 AS BIGINT) AS b FROM events WHERE value IS NOT NULL) GROUP BY 1, 2 HAVING count(*) = 2
""")
def x_count_window_stream(spark: SparkSession, d: str) -> DataFrame:
    e = read_stream(spark, d, "events").where("value is not null").select("user_id", "ts", "value")
    out = finish(P.apply(e, ["user_id"], P.CountWindow("value", 2), "key long, bucket long, n int, total double", "update"))
    return out.select("key", "bucket", "n", F.round("total", 6).alias("total"))


@query("""
SELECT e.user_id AS key, e.ts, round(e.value, 6) AS value, r.threshold FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE value IS NOT NULL) e
JOIN (SELECT c_custkey AS user_id, CAST(c_nationkey AS DOUBLE) AS threshold FROM customer WHERE c_nationkey > 0) r USING (user_id) WHERE abs(e.value - e.p) > r.threshold
""")
def x_rules_stream(spark: SparkSession, d: str) -> DataFrame:
    """Readings and per-key rules as one tagged stream."""
    e = read_stream(spark, d, "events").where("value is not null").select(F.col("user_id").alias("key"), "ts", "value", F.lit("reading").alias("tag"), F.lit(None).cast("double").alias("threshold"))
    rules = read_stream(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("2000-01-01").cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("value"), F.lit("rule").alias("tag"), F.col("c_nationkey").cast("double").alias("threshold"))
    out = finish(P.apply(e.unionByName(rules), ["key"], P.RuleAlert(), "key long, ts timestamp, value double, threshold double", "update"))
    return _plain(out.withColumn("value", F.round("value", 6)))


@query("""
WITH a AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS step FROM events), m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '10 days' AS mark FROM a WHERE step = 0)
SELECT event_id, CASE step WHEN 0 THEN 0 ELSE epoch_ms(mark) END AS watermark_ms, step = 1 AND date_trunc('millisecond', ts) < mark AS late FROM a, m
""")
def x_late_tag_stream(spark: SparkSession, d: str) -> DataFrame:
    """Rows tagged with the watermark: every third row comes in a second micro-batch, behind the first one's watermark or not."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    tag = lambda s: P.apply(s.withWatermark("ts", "10 days"), ["user_id"], P.LateTag(["event_id"]), "event_id long, watermark_ms long, late boolean", "append", "processingTime")
    out = stepwise([e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")], tag, once=True)["out"]
    return out.select("event_id", F.greatest(F.col("watermark_ms"), F.lit(0).cast("long")).alias("watermark_ms"), "late")


@query("""
SELECT user_id AS key, window_start, CAST(sum(n) OVER w AS BIGINT) AS n, round(sum(total) OVER w, 6) AS total
FROM (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n, sum(value) AS total FROM events WHERE value IS NOT NULL GROUP BY 1, 2
      HAVING time_bucket(INTERVAL '1 day', min(ts)) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '5 seconds' FROM events WHERE value IS NOT NULL))
WINDOW w AS (PARTITION BY user_id ORDER BY window_start ROWS UNBOUNDED PRECEDING)
""")
def x_cumulative_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windows closed by the watermark, then totals over all windows so far."""
    e = read_stream(spark, d, "events").where("value is not null").withWatermark("ts", "5 seconds")
    per = e.groupBy("user_id", windows.tumble("ts", "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = finish(P.apply(windows.spread(per), ["user_id"], P.Cumulative(), "key long, window_start timestamp, n long, total double"))
    return _plain(out.withColumn("total", F.round("total", 6)))


#: In which step a row of events arrives: thirds of a month by time, but some rows one or two steps later.
_STEP = "CAST((day(ts) - 1) // 10 AS INTEGER) + CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 31 = 0 THEN 2 ELSE 0 END"


def _steps(spark: SparkSession, d: str, n: int) -> list[DataFrame]:
    """The events by step of arrival; what would come after the last comes with it."""
    e = table(spark, d, "events").where("value is not null").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    late = F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 31 == 0, 2).otherwise(0)
    step = F.least(F.floor((F.day("ts") - 1) / 10) + late, F.lit(n - 1))
    return [e.where(step == k) for k in range(n)]


_ARRIVED = f"""
a AS (SELECT *, least({_STEP}, 3) AS step FROM events WHERE value IS NOT NULL),
m AS (SELECT step, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL '1 hour' AS mark FROM a GROUP BY step),
r AS (SELECT a.*, time_bucket(INTERVAL '1 day', ts) AS window_start, coalesce(time_bucket(INTERVAL '1 day', ts) + INTERVAL '13 days' <= mark, false) AS late FROM a JOIN m ON m.step = a.step)
"""


def _late(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    build = lambda s: late_windows(s, "event_type", "value", "ts", size_s=86_400, lateness_s=12 * 86_400, delay_s=3600)
    return stepwise(_steps(spark, d, 4), build, outputs={"windows": F.col("kind") != "late", "late": F.col("kind") == "late"})


@query(f"""
WITH {_ARRIVED}
SELECT event_type AS key, window_start, count(*) AS n, min(value) AS lowest, max(value) AS highest, round(sum(value), 6) AS total FROM r WHERE NOT late
GROUP BY 1, 2 HAVING window_start + INTERVAL '1 day' <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1 hour' FROM a)
""")
def x_late_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windows that fire again for rows up to 12 days late: the last row of each is the batch aggregate of all rows in time."""
    w = _late(spark, d)["windows"]
    last = w.groupBy("key", "window_start_ms").agg(F.max_by(F.struct("n", "lowest", "highest", "total"), "epoch").alias("r"))
    start = F.timestamp_millis("window_start_ms").alias("window_start")
    return _plain(last.select("key", start, "r.n", "r.lowest", "r.highest", F.round("r.total", 6).alias("total")))


@query(f"WITH {_ARRIVED} SELECT event_type AS key, ts, window_start, value FROM r WHERE late")
def x_late_rows_stream(spark: SparkSession, d: str) -> DataFrame:
    """The second output of the same query: rows that came after their window's lateness had passed."""
    late = _late(spark, d)["late"]
    return _plain(late.select("key", "ts", F.timestamp_millis("window_start_ms").alias("window_start"), F.col("highest").alias("value")))


@query(f"""
WITH a AS (SELECT *, least({_STEP}, 2) AS step FROM events WHERE value IS NOT NULL), s AS (SELECT unnest([0, 1, 2]) AS step),
c AS (SELECT s.step, event_type AS key, user_id AS item, count(*) AS n FROM a JOIN s ON a.step <= s.step GROUP BY 1, 2, 3)
SELECT * FROM (SELECT step, key, CAST(row_number() OVER (PARTITION BY step, key ORDER BY n DESC, item) AS INTEGER) AS rank, item, n FROM c) WHERE rank <= 3
""")
def x_top_changes_stream(spark: SparkSession, d: str) -> DataFrame:
    """The commonest users of each event type, continuously: the changes so far, folded after each of three micro-batches."""
    changes = stepwise(_steps(spark, d, 3), lambda s: top_counts(s, "event_type", "user_id", 3), mode="update")["out"]
    epochs = [r[0] for r in changes.select("epoch").distinct().orderBy("epoch").collect()]  # one for each step
    tables = [fold(changes.where(F.col("epoch") <= e), ["key", "rank"], ["epoch", "seq"]).select(F.lit(k).alias("step"), "key", "rank", "item", "n") for k, e in enumerate(epochs)]
    return reduce(DataFrame.unionByName, tables)


@query("""
SELECT event_id, ts, row_number() OVER (ORDER BY ts) AS position FROM events
WHERE value IS NOT NULL AND time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '25 days' FROM events WHERE value IS NOT NULL)
""")
def x_sorted_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream in the order of event time: a row's position is the rows of earlier micro-batches and its place in its own."""
    build = lambda s: in_order(s.select("event_id", "ts"), "ts", delay_s=25 * 86_400, range_s=6 * 3600)
    out = stepwise(_steps(spark, d, 4), build)["out"]
    sizes = out.groupBy("epoch").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.epoch") < F.col("a.epoch"), "left").groupBy(F.col("a.epoch").alias("epoch")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("epoch").orderBy("ts"))
    placed = out.withColumn("place", place).join(before, "epoch")
    return _plain(placed.select("event_id", "ts", (F.col("before") + F.col("place")).alias("position")))


@query("SELECT event_type, count(*) AS n, min(value) AS lowest, max(value) AS highest, arg_max(value, ts) AS last FROM events WHERE value IS NOT NULL GROUP BY event_type")
def x_incremental_stream(spark: SparkSession, d: str) -> DataFrame:
    """A user's own aggregate of a stream: state is one accumulator per key, merged with those of each micro-batch."""
    build = lambda s: incremental_stream(s, ["event_type"], ["ts", "value"], LastReadings(), "n long, lowest double, highest double, last double")
    out = stepwise(_steps(spark, d, 2), build, mode="update")["out"]
    return out.groupBy("event_type").agg(F.max_by(F.struct("n", "lowest", "highest", "last"), "epoch").alias("r")).select("event_type", "r.*")


@query("""
WITH v AS (SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_type = 'signup' GROUP BY user_id, ts), x AS (SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_type = 'error' GROUP BY user_id, ts)
SELECT p.event_id, v.version AS own, w.version AS partner, x.version AS error
FROM (SELECT *, event_id % 13 AS partner_id FROM events WHERE event_type = 'purchase' AND date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', max(ts)) FROM events WHERE event_type IN ('purchase', 'signup', 'error'))) p
ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts ASOF LEFT JOIN v w ON p.partner_id = w.user_id AND p.ts >= w.ts ASOF LEFT JOIN x ON p.partner_id = x.user_id AND p.ts >= x.ts
""")
def x_star_stream(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the sign-ups of two roles and the errors of one, in one stateful pass; arrivals in two steps."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'signup', 'error')").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    roles = {"own": Role("signups", "user_id"), "partner": Role("signups", "partner_id"), "error": Role("errors", "partner_id")}

    def build(s: DataFrame) -> DataFrame:
        facts = s.where("event_type = 'purchase'").select("event_id", "user_id", F.expr("event_id % 13").alias("partner_id"), "ts")
        version = lambda kind: Dimension(s.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias("version")), "user_id", "ts")
        return resolved(facts, "ts", {"signups": version("signup"), "errors": version("error")}, roles)

    out = stepwise([e.where("day(ts) <= 15"), e.where("day(ts) > 15")], build)["out"]
    stars = assembled(out, "event_id long", dict.fromkeys(roles, "version long"))
    return stars.select("event_id", *[F.col(f"{r}.version").alias(r) for r in roles])


@query("""
SELECT user_id AS key, ts, round(value, 6) AS value
FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN epoch_ms(ts) END) OVER (PARTITION BY user_id ORDER BY ts) + 21600000 AS until FROM events)
WHERE event_type <> 'signup' AND epoch_ms(ts) < until
""")
def x_switch_stream(spark: SparkSession, d: str) -> DataFrame:
    """A control stream joined to the rows that it lets pass: six hours of a user's events after each sign-up."""
    e = read_stream(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "value", F.when(F.col("event_type") == "signup", "switch").otherwise("row").alias("tag"), F.lit(21_600_000).cast("long").alias("for_ms"))
    out = finish(P.apply(e, ["key"], P.Switch(), "key long, ts timestamp, value double", "update"))
    return _plain(out.withColumn("value", F.round("value", 6)))


@query("""
WITH e AS (SELECT user_id AS key, epoch_ms(ts) - epoch_ms(ts) % 3600000 AS window_start_ms, epoch_ms(ts) // 600000 AS slot, value FROM events WHERE value IS NOT NULL)
SELECT key, window_start_ms, count(*) AS n, round(sum(value), 6) AS total, count(DISTINCT CASE WHEN slot % 6 < 5 THEN slot END) AS early
FROM e GROUP BY key, window_start_ms HAVING window_start_ms + 3600000 <= (SELECT epoch_ms(max(ts)) - 5000 FROM events WHERE value IS NOT NULL)
""")
def x_early_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows by a trigger of their own: what they fired last, at their end, and how often before, once for each ten minutes with rows."""
    e = read_stream(spark, d, "events").where("value is not null").select("user_id", "ts", "value").withWatermark("ts", "5 seconds")
    fired = finish(P.apply(e, ["user_id"], P.EarlyWindow("value", 3_600_000, 600_000), "key long, window_start_ms long, n long, total double, final boolean", "append", "eventTime"))
    last = lambda c: F.max(F.when(F.col("final"), F.col(c)))
    out = fired.groupBy("key", "window_start_ms").agg(last("n").alias("n"), F.round(last("total"), 6).alias("total"), F.count_if(~F.col("final")).alias("early"))
    return out.where("n is not null")
