"""Projection, filters, joins, aggregates, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins, sets
from .registry import query, table, views


@query("SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity AS quantity FROM lineitem")
def p_select_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS revenue FROM lineitem")
def p_arith(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("revenue"))


@query("SELECT DISTINCT event_type FROM events")
def p_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type").distinct()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def p_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_quantity") >= 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F'")
def p_conjunction(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    day = lambda s: F.to_date(F.lit(s)).cast("timestamp_ntz")
    return table(spark, d, "orders").where((at >= day("1995-01-01")) & (at < day("1996-01-01")) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def p_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("click", "error")).select("event_id", "event_type")


@query("SELECT p_partkey, p_type FROM part WHERE p_type SIMILAR TO '(STANDARD|SMALL|PROMO).*'")
def p_similar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(S.similar_to(F.col("p_type"), "(STANDARD|SMALL|PROMO)%")).select("p_partkey", "p_type")


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL AND props IS NOT NULL")
def p_isnull(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("value").isNotNull() & F.col("props").isNotNull()).select("event_id", "value")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def p_between(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size_class FROM orders")
def p_case(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(price > 200000, "large").when(price > 50000, "medium").otherwise("small").alias("size_class"))


_CTE = """
WITH per_customer AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders
FROM per_customer JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
"""


@query(_CTE)
def p_cte(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "orders", "customer")
    return spark.sql(_CTE)


@query("SELECT event_id, user_id, event_type, value, 'web' AS channel FROM events WHERE event_type = 'purchase'")
def p_star_literal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").drop("ts", "props").where("event_type = 'purchase'").select("*", F.lit("web").alias("channel"))


@query("SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS tagline FROM events")
def p_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("tagline"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def p_flat_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01 00:00:00'")
def p_after_now(spark: SparkSession, d: str) -> DataFrame:
    """A wall-clock filter with the clock as a parameter."""
    now = F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "orders").where(F.col("o_orderdate") > now).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS side FROM events WHERE value IS NOT NULL")
def p_split(spark: SparkSession, d: str) -> DataFrame:
    """A stream split by complementary filters, and its parts put together again."""
    events = table(spark, d, "events").where("value is not null")
    high, low = events.where("value > 50"), events.where("value <= 50")
    return high.select("event_id", F.lit("high").alias("side")).union(low.select("event_id", F.lit("low").alias("side")))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) WHERE n > 2")
def p_subquery(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "events")
    return spark.sql("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) WHERE n > 2")


@query("SELECT l_orderkey, l_linenumber, CAST(floor(CAST(((epoch(l_shipdate) - epoch(o_orderdate)) % 86400 + 86400) % 86400 AS BIGINT) / 60) AS BIGINT) AS minutes, round(65 + l_quantity / 100 * 20, 6) AS temperature FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def p_derived(spark: SparkSession, d: str) -> DataFrame:
    """Minutes between two times modulo a day, and a scaled reading."""
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return both.select("l_orderkey", "l_linenumber", F.floor(F.pmod(seconds, F.lit(86400)) / 60).alias("minutes"), F.round(65 + F.col("l_quantity") / 100 * 20, 6).alias("temperature"))


# joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def j_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, c_name FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') RIGHT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def j_right_null(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order of one status."""
    both = table(spark, d, "orders").where("o_orderstatus = 'P'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right")
    return both.where("o_orderkey is null").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j_anti_equiv(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return joins.unmatched(table(spark, d, "customer"), orders, "c_custkey").select("c_custkey", "c_name")


@query("""
SELECT p.event_id, f.event_id AS flag_id FROM events p JOIN events f ON p.user_id = f.user_id AND p.ts > f.ts
WHERE p.event_type = 'purchase' AND f.event_type = 'error'
""")
def j_inequality(spark: SparkSession, d: str) -> DataFrame:
    """Purchases after any of the account's flags."""
    e = table(spark, d, "events")
    tx = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    flags = e.where("event_type = 'error'").select(F.col("event_id").alias("flag_id"), F.col("user_id").alias("account"), F.col("ts").alias("flag_ts"))
    return tx.join(flags, (F.col("user_id") == F.col("account")) & (F.col("ts") > F.col("flag_ts"))).select("event_id", "flag_id")


@query("""
SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY
""")
def j_interval(spark: SparkSession, d: str) -> DataFrame:
    both = joins.interval_join(table(spark, d, "orders"), table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), F.col("o_orderdate"), F.col("l_shipdate"), "0 days", "30 days")
    return both.select("o_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


_VERSIONS = "SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_type = 'signup' GROUP BY user_id, ts"


def _versions(spark: SparkSession, d: str) -> joins.VersionedTable:
    history = table(spark, d, "events").where("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("version_ts")).agg(F.max("event_id").alias("version"))
    return joins.VersionedTable(history, "user_id", "version_ts")


@query(f"""
SELECT p.event_id, p.ts, v.ts AS version_ts, v.version
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN ({_VERSIONS}) v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def j_asof(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(rows, _versions(spark, d), "user_id", "ts").select("event_id", "ts", "version_ts", "version")


@query(f"""
SELECT p.event_id, v.version AS signup, w.version AS error
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN ({_VERSIONS}) v ON p.user_id = v.user_id AND p.ts >= v.ts
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_type = 'error' GROUP BY user_id, ts) w ON p.user_id = w.user_id AND p.ts >= w.ts
""")
def j_asof_left_star(spark: SparkSession, d: str) -> DataFrame:
    """A fact with two versioned dimensions."""
    e = table(spark, d, "events")
    rows = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = joins.VersionedTable(e.where("event_type = 'error'").groupBy("user_id", F.col("ts").alias("error_ts")).agg(F.max("event_id").alias("error")), "user_id", "error_ts")
    one = joins.asof_join(rows, _versions(spark, d), "user_id", "ts", how="left")
    return joins.asof_join(one, errors, "user_id", "ts", how="left").select("event_id", F.col("version").alias("signup"), "error")


@query(f"""
SELECT p.event_id, v.version AS own, w.version AS partner, x.version AS error
FROM (SELECT *, event_id % 13 AS partner_id FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN ({_VERSIONS}) v ON p.user_id = v.user_id AND p.ts >= v.ts
ASOF LEFT JOIN ({_VERSIONS}) w ON p.partner_id = w.user_id AND p.ts >= w.ts
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_type = 'error' GROUP BY user_id, ts) x ON p.partner_id = x.user_id AND p.ts >= x.ts
""")
def j_star_two_roles(spark: SparkSession, d: str) -> DataFrame:
    """A fact with one dimension in two roles, and another one."""
    e = table(spark, d, "events")
    rows = e.where("event_type = 'purchase'").select("event_id", "user_id", F.expr("event_id % 13").alias("partner_id"), "ts")
    errors = joins.VersionedTable(e.where("event_type = 'error'").groupBy("user_id", F.col("ts").alias("error_ts")).agg(F.max("event_id").alias("error")), "user_id", "error_ts")
    signups = _versions(spark, d)
    out = joins.star_join(rows, "ts", {"own": (signups, "user_id"), "partner": (signups, "partner_id"), "of": (errors, "partner_id")})
    return out.select("event_id", F.col("own_version").alias("own"), F.col("partner_version").alias("partner"), F.col("of_error").alias("error"))


@query("""
WITH v AS (SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to, max_id AS version
           FROM (SELECT user_id, ts, max(event_id) AS max_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts))
SELECT * FROM v
""")
def j_versioned_table(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).intervals().select("user_id", "valid_from", "valid_to", "version")


@query("SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("n_nationkey"))
    named = joins.lookup_join(rows, table(spark, d, "nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.lookup_join(named, table(spark, d, "region"), "r_regionkey").select("o_orderkey", "n_name", "r_name")


@query("SELECT p_partkey, w AS word FROM part, unnest(string_split(p_name, ' ')) AS t(w)")
def j_unnest(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "part")
    return spark.sql("SELECT p_partkey, w AS word FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS w")


@query("""
SELECT c_mktsegment, c_custkey, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3
""")
def j_lateral_topn(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "customer")
    return spark.sql("""
      SELECT s.c_mktsegment, t.c_custkey, t.c_acctbal FROM (SELECT DISTINCT c_mktsegment FROM customer) s,
      LATERAL (SELECT c_custkey, c_acctbal FROM customer c WHERE c.c_mktsegment = s.c_mktsegment ORDER BY c_acctbal DESC, c_custkey LIMIT 3) t
    """)


# aggregates


@query("SELECT event_type, count(*) AS n, count(props) AS with_props, round(sum(value), 6) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def a_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.round(F.sum("value"), 6).alias("total"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 12")
def a_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a_distinct_count(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated first, then counted: the form that streams accept too."""
    return table(spark, d, "events").select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("users"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events")
def a_global(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))


@query("""
SELECT l_returnflag, round(avg(DISTINCT l_quantity), 6) AS mean_distinct, round(avg(l_quantity), 6) AS mean_all FROM lineitem GROUP BY l_returnflag
""")
def a_avg_distinct_vs_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.expr("avg(DISTINCT l_quantity)"), 6).alias("mean_distinct"), F.round(F.avg("l_quantity"), 6).alias("mean_all"))


@query("SELECT o_custkey, cnt FROM (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) WHERE cnt > 15")
def a_filter_on_agg(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "orders")
    return spark.sql("SELECT o_custkey, cnt FROM (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) WHERE cnt > 15")


_ROW = "list_value(l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100)"


@query(f"SELECT l_orderkey, l_linenumber, round(list_avg({_ROW}), 9) AS mean, round(list_stddev_samp({_ROW}), 9) AS deviation, round(list_sum({_ROW}), 9) AS total FROM lineitem")
def a_row_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics across the columns of one row."""
    cols = [F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.row_mean(*cols), 9).alias("mean"), F.round(S.row_stdev(*cols), 9).alias("deviation"), F.round(S.row_mean(*cols) * 4, 9).alias("total"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, round(max(value), 6) AS high FROM events GROUP BY user_id")
def a_reduce_final(spark: SparkSession, d: str) -> DataFrame:
    """A keyed reduce, its final result."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.round(F.max("value"), 6).alias("high"))


@query("""
SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, arg_min(event_id, (value, event_id)) AS event_id, round(min(value), 6) AS value
FROM events WHERE value IS NOT NULL GROUP BY 1, 2
""")
def a_min_row(spark: SparkSession, d: str) -> DataFrame:
    """A windowed reduce that keeps the least row."""
    w = F.window("ts", "1 hour").alias("w")
    out = table(spark, d, "events").where("value is not null").groupBy("event_type", w).agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.round(F.min("value"), 6).alias("value"))
    return out.select("event_type", F.col("w.start").alias("window_start"), "event_id", "value")


# sorting and sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 5")
def t_offset_fetch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(5).limit(10)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def t_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal")
def t_order_by(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.asc("c_acctbal"))


@query("""
SELECT c_name AS name, c_nationkey AS nation, 'customer' AS kind, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_nationkey, 'supplier', NULL FROM supplier
UNION ALL SELECT n_name, n_nationkey, 'nation', NULL FROM nation
""")
def u_union_all_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Three schemas aligned by name with literal columns."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"), F.lit("nation").alias("kind"))
    return sets.union_all(c, s, n)


@query("""
SELECT event_id AS id, 'error' AS tag, value AS level, NULL AS amount FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'purchase', NULL, value FROM events WHERE event_type = 'purchase'
""")
def u_connect(spark: SparkSession, d: str) -> DataFrame:
    """Two typed inputs as one tagged stream."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("value").alias("level"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("value").alias("amount"))
    return sets.tagged(error=a, purchase=b)
