"""Whole pipelines as functions from DataFrame to DataFrame, for batch and streams alike.

Each is free of sources and sinks; the queries feed them from the test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.udfs import add_source
from ..operators import sets, windows
from .registry import query, table

FLIGHT = ["email_address", "departure_time", "departure_airport_code", "arrival_time", "arrival_airport_code", "flight_number", "confirmation", "source"]


# flights


def skyone_flights(rows: DataFrame, now: Column) -> DataFrame:
    """One airline's bookings in the common schema, future arrivals only."""
    names = ["email_address", "flight_departure_time", "iata_departure_code", "flight_arrival_time", "iata_arrival_code", "flight_number", "confirmation"]
    picked = rows.where(F.col("flight_arrival_time") > now)
    return picked.select(*[F.col(a).alias(b) for a, b in zip(names, FLIGHT, strict=False)], F.lit("skyone").alias("source"))


def sunset_flights(rows: DataFrame, now: Column) -> DataFrame:
    """The other airline's."""
    names = ["customer_email_address", "departure_time", "departure_airport", "arrival_time", "arrival_airport", "flight_id", "reference_number"]
    picked = rows.where(F.col("arrival_time") > now)
    return picked.select(*[F.col(a).alias(b) for a, b in zip(names, FLIGHT, strict=False)], F.lit("sunset").alias("source"))


def import_flights(skyone: DataFrame, sunset: DataFrame, now: Column) -> DataFrame:
    return sets.union_all(skyone_flights(skyone, now), sunset_flights(sunset, now))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, modulo a day: a flight's length is taken to be under one."""
    gap = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.floor(F.pmod(gap, F.lit(86400)) / 60)


def user_statistics(flights: DataFrame, ts: str, size: str = "1 minute") -> DataFrame:
    """Flights and minutes of each user and window."""
    rows = flights.withColumn("minutes", minutes_between(F.col("departure_time"), F.col("arrival_time")))
    out = rows.groupBy("email_address", windows.tumble(ts, size)).agg(F.sum("minutes").alias("total_flight_duration"), F.count("*").alias("number_of_flights"))
    return windows.spread(out)


def cumulative_statistics(per_window: DataFrame) -> DataFrame:
    """The same over all windows so far; batch. Streams chain :class:`Cumulative`."""
    sums = {c: F.sum(c) for c in ("total_flight_duration", "number_of_flights")}
    renamed = per_window.select("email_address", "window_start", "window_end", *[F.col(c).alias(f"_{c}") for c in sums])
    out = windows.running(renamed, ["email_address"], ["window_start"], **{c: F.sum(f"_{c}") for c in sums})
    return out.drop(*[f"_{c}" for c in sums])


# sensors


def readings(rows: DataFrame) -> DataFrame:
    """(id, ts, num_records, temperature) from (id, rn, log_time), times cut to seconds."""
    return rows.select(F.concat(F.lit("sensor_"), F.col("id").cast("string")).alias("id"), F.date_trunc("second", F.col("log_time")).alias("ts"), F.lit(1).alias("num_records"), (65 + F.col("rn") / 100 * 20).alias("temperature"))


def smoke_level(rn: Column) -> Column:
    return F.when(rn / 100 > 0.8, "High").otherwise("Low")


def fire_alerts(sensors: DataFrame, levels: DataFrame, limit: float = 80) -> DataFrame:
    """Readings above the limit, where a level row of the same instant or the last one before it is high: levels hold from their ts to the next."""
    hot = sensors.where(F.col("temperature") > limit)
    return hot.join(levels.where("level = 'High'"), F.expr("ts >= level_from AND (level_to IS NULL OR ts < level_to)")).select(F.concat(F.lit("Risk of fire from "), F.col("id")).alias("message"), "ts", "temperature")


def sensor_windows(sensors: DataFrame, size: str = "1 second") -> DataFrame:
    out = sensors.groupBy("id", windows.tumble("ts", size)).agg(F.sum("num_records").alias("num_records"), F.round(F.avg("temperature"), 2).alias("mean"), F.min("temperature").alias("low"), F.max("temperature").alias("high"))
    return windows.spread(out)


# fraud


def flagged_transactions(transactions: DataFrame, flags: DataFrame) -> DataFrame:
    """Transactions of accounts after they were flagged."""
    f = flags.select(F.col("account_id").alias("_a"), "flag_date")
    return transactions.join(f, (F.col("account_id") == F.col("_a")) & (F.col("transaction_date") > F.col("flag_date"))).drop("_a")


# taxi


def taxi_forward(rides: DataFrame, ts: str = "pickup_datetime", size: str = "5 seconds") -> DataFrame:
    """Rides and passengers of each vendor and window, for a search index."""
    out = rides.groupBy("vendor_id", windows.tumble(ts, size)).agg(F.sum("passenger_count").cast("int").alias("sum_passengers"), F.count("*").alias("rides"))
    return windows.spread(out)


def taxi_export(rides: DataFrame, ts: str = "pickup_datetime") -> DataFrame:
    """Rides with the partition columns of the export, and where they come from."""
    t = F.col(ts)
    return rides.select("*", add_source().alias("source"), F.date_format(t, "yyyy").alias("year"), F.date_format(t, "MM").alias("month"), F.date_format(t, "dd").alias("date"), F.date_format(t, "HH").alias("hour"))


# sales


def sales_by_seller(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Revenue of each seller's products, with the seller's place."""
    both = items.join(sellers, F.col("seller_id") == F.col("id"))
    return both.groupBy("seller_id", "city", "product").agg(F.sum("quantity").alias("quantity"), F.round(F.sum(F.col("quantity") * F.col("product_price")), 2).alias("revenue"))


def seller_windows(items: DataFrame, ts: str, size: str = "10 seconds", slide: str | None = None) -> DataFrame:
    w = windows.hop(ts, slide, size) if slide else windows.tumble(ts, size)
    return windows.spread(items.groupBy("seller_id", w).agg(F.round(F.sum(F.col("quantity") * F.col("product_price")), 2).alias("window_sales")))


def quarterly_statistics(rows: DataFrame) -> DataFrame:
    q = [F.col(c) for c in ("q1", "q2", "q3", "q4")]
    total = q[0] + q[1] + q[2] + q[3]
    return rows.select("seller_id", total.alias("total"), F.round(S.row_mean(*q), 2).alias("mean"), F.round(S.row_stdev(*q), 2).alias("stdev"))


# queries over the test tables


@query("""
SELECT 'u' || user_id AS email_address, ts AS departure_time, ts + to_seconds(CAST(event_id AS INTEGER) % 7200) AS arrival_time, 'f' || event_id AS confirmation, CASE WHEN event_type = 'purchase' THEN 'skyone' ELSE 'sunset' END AS source
FROM events WHERE event_type IN ('purchase', 'signup') AND ts + to_seconds(CAST(event_id AS INTEGER) % 7200) > TIMESTAMP '2024-01-10'
""")
def pl_flights(spark: SparkSession, d: str) -> DataFrame:
    return _flights(spark, d).select("email_address", "departure_time", "arrival_time", "confirmation", "source")


def _flights(spark: SparkSession, d: str) -> DataFrame:
    arrival = F.expr("ts + make_dt_interval(0, 0, 0, event_id % 7200)")
    e = table(spark, d, "events").select("*", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("who"), arrival.alias("arrival"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("ref"))
    some = F.lit("XXX")
    skyone = e.where("event_type = 'purchase'").select(F.col("who").alias("email_address"), F.col("ts").alias("flight_departure_time"), some.alias("iata_departure_code"), F.col("arrival").alias("flight_arrival_time"), some.alias("iata_arrival_code"), F.col("ref").alias("flight_number"), F.col("ref").alias("confirmation"))
    sunset = e.where("event_type = 'signup'").select(F.col("who").alias("customer_email_address"), F.col("ts").alias("departure_time"), some.alias("departure_airport"), F.col("arrival").alias("arrival_time"), some.alias("arrival_airport"), F.col("ref").alias("flight_id"), F.col("ref").alias("reference_number"))
    return import_flights(skyone, sunset, F.lit("2024-01-10").cast("timestamp_ntz"))


@query("""
WITH f AS (SELECT 'u' || user_id AS email_address, time_bucket(INTERVAL '1 day', ts) AS window_start, (event_id % 7200) // 60 AS minutes FROM events
           WHERE event_type IN ('purchase', 'signup') AND ts + to_seconds(CAST(event_id AS INTEGER) % 7200) > TIMESTAMP '2024-01-10'),
p AS (SELECT email_address, window_start, sum(minutes) AS t, count(*) AS n FROM f GROUP BY 1, 2)
SELECT email_address, window_start, CAST(sum(t) OVER w AS BIGINT) AS total_flight_duration, CAST(sum(n) OVER w AS BIGINT) AS number_of_flights
FROM p WINDOW w AS (PARTITION BY email_address ORDER BY window_start ROWS UNBOUNDED PRECEDING)
""")
def pl_user_statistics(spark: SparkSession, d: str) -> DataFrame:
    return cumulative_statistics(user_statistics(_flights(spark, d), "departure_time", "1 day")).drop("window_end")


@query("""
SELECT p.user_id AS account_id, p.event_id AS transaction_id, p.ts AS transaction_date, f.ts AS flag_date FROM events p JOIN events f ON p.user_id = f.user_id AND p.ts > f.ts
WHERE p.event_type = 'purchase' AND f.event_type = 'error'
""")
def pl_fraud(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    tx = e.where("event_type = 'purchase'").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("transaction_id"), F.col("ts").alias("transaction_date"))
    return flagged_transactions(tx, e.where("event_type = 'error'").select(F.col("user_id").alias("account_id"), F.col("ts").alias("flag_date")))


@query("""
SELECT user_id % 5 AS vendor_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
       CAST(sum(event_id % 6) AS INTEGER) AS sum_passengers, count(*) AS rides FROM events GROUP BY 1, 2, 3
""")
def pl_taxi_forward(spark: SparkSession, d: str) -> DataFrame:
    return taxi_forward(_rides(spark, d), size="1 hour")


def _rides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("vendor_id"), F.col("ts").alias("pickup_datetime"), (F.col("event_id") % 6).alias("passenger_count"))


@query("""
SELECT event_id AS id, user_id % 5 AS vendor_id, ts AS pickup_datetime, event_id % 6 AS passenger_count, 'NYCTAXI' AS source,
       strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS date, strftime(ts, '%H') AS hour FROM events
""")
def pl_taxi_export(spark: SparkSession, d: str) -> DataFrame:
    return taxi_export(_rides(spark, d))


@query("""
SELECT s_suppkey AS seller_id, n_name AS city, p_brand AS product, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(sum(l_quantity * p_retailprice), 2) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3
""")
def pl_sales(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = items.select(F.col("l_suppkey").alias("seller_id"), F.col("p_brand").alias("product"), F.col("l_quantity").alias("quantity"), F.col("p_retailprice").alias("product_price"))
    sellers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("city"))
    return sales_by_seller(items, sellers)


@query("""
SELECT sensor AS id, window_start, CAST(count(*) AS BIGINT) AS num_records, round(avg(t), 2) AS mean, round(min(t), 6) AS low, round(max(t), 6) AS high
FROM (SELECT 'sensor_' || CAST(user_id % 10 AS VARCHAR) AS sensor, time_bucket(INTERVAL '1 hour', date_trunc('second', ts)) AS window_start, 65 + (event_id % 100) / 100 * 20 AS t FROM events) GROUP BY 1, 2
""")
def pl_sensors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("id"), (F.col("event_id") % 100).alias("rn"), F.col("ts").cast("timestamp").alias("log_time"))
    out = sensor_windows(readings(rows), "1 hour").drop("window_end")
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6), "window_start": F.col("window_start").cast("timestamp_ntz")})
