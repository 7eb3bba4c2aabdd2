"""Row pattern queries, and the state-keeping operators in their batch form."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sqlfront
from ..operators import joins, match
from .registry import query, table

_SYMBOLS = """
s AS (SELECT user_id, event_id, ts, value, CASE WHEN event_type IN ('purchase', 'signup') THEN 'P' WHEN event_type = 'view' THEN 'B' ELSE 'X' END AS c FROM events)
"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "ts", "value", "event_type")


@query(f"""
WITH {_SYMBOLS}, g AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, c ORDER BY ts, event_id) AS island,
         lead(c) OVER w AS next_c, lead(event_id) OVER w AS next_id FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), r AS (
  SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_premium, arg_max(event_id, (ts, event_id)) AS last_premium, arg_max(next_c, (ts, event_id)) AS after_c, arg_max(next_id, (ts, event_id)) AS basic, count(*) AS n,
         avg(trunc(value)) AS hours
  FROM g WHERE c = 'P' GROUP BY user_id, island
)
SELECT user_id, first_premium, last_premium, basic, n, hours FROM r WHERE after_c = 'B'
""")
def m_premium_basic(spark: SparkSession, d: str) -> DataFrame:
    """Runs of premium rows that end in a basic one, and the premium rows' mean length."""
    _events(spark, d).withColumn("until", F.expr("ts + make_dt_interval(0, CAST(value AS INT))")).createOrReplaceTempView("subscriptions")
    return sqlfront.sql(
        spark,
        """
        SELECT * FROM subscriptions MATCH_RECOGNIZE (
          PARTITION BY user_id ORDER BY ts, event_id
          MEASURES FIRST(PREMIUM.event_id) AS first_premium, LAST(PREMIUM.event_id) AS last_premium, BASIC.event_id AS basic,
                   COUNT(PREMIUM.event_id) AS n, AVG(TIMESTAMPDIFF(HOUR, PREMIUM.ts, PREMIUM.until)) AS hours
          ONE ROW PER MATCH
          AFTER MATCH SKIP PAST LAST ROW
          PATTERN (PREMIUM+ BASIC)
          DEFINE PREMIUM AS PREMIUM.event_type IN ('purchase', 'signup'), BASIC AS BASIC.event_type = 'view'
        )
        """,
    )


def _v_sql(downs: int, before: str) -> str:
    return f"""
WITH v AS (SELECT event_type, event_id, ts, value, lag(value) OVER w AS p, lead(value) OVER w AS q, row_number() OVER w AS i FROM (SELECT * FROM events WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN value < p THEN 0 ELSE 1 END AS stop FROM v),
g AS (SELECT *, sum(stop) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING) AS fall FROM f),
r AS (SELECT event_type, fall, min(i) AS i0, max(i) AS i1, count(*) - 1 AS downs, arg_max({before}, i) AS bound, arg_max(q, i) AS after FROM g GROUP BY event_type, fall)
SELECT r.event_type, a.event_id AS start_id, b.event_id AS bottom_id, c.event_id AS up_id, CAST(downs AS BIGINT) AS downs
FROM r JOIN v a ON a.event_type = r.event_type AND a.i = i0 JOIN v b ON b.event_type = r.event_type AND b.i = i1 JOIN v c ON c.event_type = r.event_type AND c.i = i1 + 1
WHERE downs >= {downs} AND after > bound
"""


def _v_shapes(spark: SparkSession, d: str, up: str) -> DataFrame:
    _events(spark, d).where("value is not null").createOrReplaceTempView("readings")
    return sqlfront.sql(
        spark,
        f"""
        SELECT * FROM readings MATCH_RECOGNIZE (
          PARTITION BY event_type ORDER BY ts, event_id
          MEASURES START_ROW.event_id AS start_id, LAST(DOWN.event_id) AS bottom_id, LAST(UP.event_id) AS up_id, COUNT(DOWN.event_id) AS downs
          ONE ROW PER MATCH
          AFTER MATCH SKIP TO LAST UP
          PATTERN (START_ROW DOWN+ UP)
          DEFINE DOWN AS (LAST(DOWN.value, 1) IS NULL AND DOWN.value < START_ROW.value) OR DOWN.value < LAST(DOWN.value, 1),
                 UP AS {up}
        ) AS falls
        """,
    )


@query(_v_sql(1, "value"))
def m_v_shape(spark: SparkSession, d: str) -> DataFrame:
    """Falling values that turn above the bottom: each match's last row may begin the next one.

    There are few event types; time slices keep each of them in many tasks.
    """
    return _v_shapes(spark, d, "UP.value > LAST(DOWN.value)")


@query(_v_sql(2, "p"))
def m_v_shape_second(spark: SparkSession, d: str) -> DataFrame:
    """Falling values that turn above the value before the bottom, which must have been part of the fall."""
    return _v_shapes(spark, d, "UP.value > LAST(DOWN.value, 1)")


_AB = """
WITH RECURSIVE n AS (SELECT user_id, event_id, ts, event_type, lead(event_id) OVER w AS b_id, lead(event_type) OVER w AS b_type, lead(ts) OVER w AS b_ts, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ok AS (SELECT * FROM n WHERE b_type <> event_type AND b_ts - ts <= INTERVAL 1 DAY),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM ok),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY i) AS j FROM g)
SELECT user_id, event_id AS a_id, b_id FROM k WHERE j % 2 = 1
"""


@query(_AB)
def m_ab_within(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring rows of different types within a day; matches don't overlap."""
    _events(spark, d).createOrReplaceTempView("visits")
    return sqlfront.sql(
        spark,
        """
        SELECT * FROM visits MATCH_RECOGNIZE (
          PARTITION BY user_id ORDER BY ts, event_id
          MEASURES A.event_id AS a_id, B.event_id AS b_id
          PATTERN (A B) WITHIN INTERVAL '1' DAY
          DEFINE A AS true, B AS B.event_type <> A.event_type
        )
        """,
    )


@query(_AB)
def m_ab_function(spark: SparkSession, d: str) -> DataFrame:
    """The same with Python conditions, which may look at the whole match."""
    return match.match_recognize(
        _events(spark, d), partition_by=["user_id"], order_by=["ts", "event_id"], pattern="A B", within=("ts", timedelta(days=1)),
        define={"B": lambda m: m.row["event_type"] != m.last("A", "event_type")},
        measures={"a_id": lambda m: m.first("A", "event_id"), "b_id": lambda m: m.last("B", "event_id")},
        schema="user_id long, a_id long, b_id long",
    )


@query("""
SELECT event_id, round(p, 6) AS before, round(value, 6) AS value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE abs(value - p) > 50
""")
def x_state_alert(spark: SparkSession, d: str) -> DataFrame:
    """Values that jump by more than a limit from their key's last one."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("before", before).where(F.abs(F.col("value") - F.col("before")) > 50)
    return rows.select("event_id", F.round("before", 6).alias("before"), F.round("value", 6).alias("value"))


@query("""
SELECT e.event_id, r.threshold FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) e
JOIN (SELECT c_custkey AS user_id, CAST(c_nationkey AS DOUBLE) AS threshold FROM customer WHERE c_nationkey > 0) r USING (user_id) WHERE abs(e.value - e.p) > r.threshold
""")
def x_broadcast_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per-key rules; a rule of 0 is no rule."""
    rules = table(spark, d, "customer").where("c_nationkey > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("double").alias("threshold"))
    rows = table(spark, d, "events").withColumn("p", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return joins.lookup_join(rows, rules, "user_id", "inner").where("abs(value - p) > threshold").select("event_id", "threshold")


@query("""
SELECT r.event_id, 'Risk of fire from user_' || CAST(r.user_id AS VARCHAR) AS message FROM (SELECT *, 1 AS one FROM events WHERE event_type <> 'error' AND value > 80) r
ASOF JOIN (SELECT ts, max(value) > 80 AS high, 1 AS one FROM events WHERE event_type = 'error' GROUP BY ts) s ON r.one = s.one AND r.ts >= s.ts WHERE s.high
""")
def x_smoke_alert(spark: SparkSession, d: str) -> DataFrame:
    """Readings above a limit while the last broadcast level is high.

    The level goes to every row, so its one key is spread over time slices by the as-of join.
    """
    e = table(spark, d, "events").withColumn("one", F.lit(1))
    levels = e.where("event_type = 'error'").groupBy("one", F.col("ts").alias("level_ts")).agg((F.max("value") > 80).alias("high"))
    readings = e.where("event_type <> 'error' and value > 80").select("event_id", "user_id", "ts", "one")
    both = joins.asof_join(readings, joins.VersionedTable(levels, "one", "level_ts"), "one", "ts", slice_s=3600).where("high")
    return both.select("event_id", F.concat(F.lit("Risk of fire from user_"), F.col("user_id").cast("string")).alias("message"))


@query("""
SELECT event_id, ts < max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS late FROM events
""")
def x_late_split(spark: SparkSession, d: str) -> DataFrame:
    """Lateness by the order of arrival, in batch: behind a watermark a day below the latest time so far.

    The running maximum is taken within ranges of arrivals, and carried from range to range
    by one row each, so no task sees the whole stream.
    """
    rows = table(spark, d, "events").select("event_id", "ts").withColumn("part", F.floor(F.col("event_id") / 4096))
    heads = rows.groupBy("part").agg(F.max("ts").alias("top"))
    carried = heads.select(F.col("part").alias("of"), F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inside = F.max("ts").over(Window.partitionBy("part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("top", inside).join(carried, F.col("part") == F.col("of"))
    return marked.select("event_id", (F.col("ts") < F.greatest("top", "carry") - F.expr("INTERVAL '1' DAY")).alias("late"))


@query("""
SELECT event_id, 'freezing' AS output FROM events WHERE value < 20
UNION ALL SELECT event_id, 'main' FROM events
""")
def x_side_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Alarms as a side output; the main output keeps every row."""
    from ..operators.sets import split_outputs

    out = split_outputs(table(spark, d, "events").select("event_id", "value"), {"freezing": F.col("value") < 20})
    return out["freezing"].select("event_id", F.lit("freezing").alias("output")).union(out["main"].select("event_id", F.lit("main").alias("output")))
