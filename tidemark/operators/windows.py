"""Time windows, count windows and windowed rows.

Window columns work in batch and streaming ``groupBy``; in streaming, set a watermark
first. Sizes are interval strings such as "10 minutes".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumble(ts: str | Column, size: str) -> Column:
    """Grouping column for windows of one size, end to end."""
    return F.window(ts, size).alias("w")


def hop(ts: str | Column, slide: str, size: str) -> Column:
    """Grouping column for overlapping windows; slide first."""
    return F.window(ts, size, slide).alias("w")


def session(ts: str | Column, gap: str) -> Column:
    """Grouping column for sessions. Rows exactly ``gap`` apart share one; it ends a gap after its last row."""
    return F.session_window(ts, gap).alias("w")


def spread(df: DataFrame) -> DataFrame:
    """The window struct ``w`` as window_start and window_end, first."""
    rest = [c for c in df.columns if c != "w"]
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)


def with_window(df: DataFrame, window: Column) -> DataFrame:
    """Rows with their window_start, window_end and window_time (its last millisecond), ungrouped."""
    rows = spread(df.withColumn("w", window))
    return rows.withColumn("window_time", F.col("window_end") - F.expr("INTERVAL '0.001' SECOND"))


def cumulate(df: DataFrame, ts: str, step: str, size: str) -> DataFrame:
    """Rows with every window that starts with their ``size`` window and ends a whole number of steps later, from the row's step on."""
    rows = df.withColumn("_w", F.window(ts, size)).withColumn("_s", F.window(ts, step))
    ends = F.sequence(F.col("_s.end"), F.col("_w.end"), F.expr(f"INTERVAL {step}"))
    return rows.select("*", F.col("_w.start").alias("window_start"), F.explode(ends).alias("window_end")).drop("_w", "_s")


def count_windows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Rows with ``bucket``: 0 for a key's first n rows, and so on; rows of an incomplete last window are left out.

    Batch only; streams use :class:`tidemark.streaming.processors.CountWindow`.
    """
    by = Window.partitionBy(*keys)
    rows = df.withColumn("bucket", F.floor((F.row_number().over(by.orderBy(*order)) - 1) / n)).withColumn("_in", F.count("*").over(by))
    return rows.where((F.col("bucket") + 1) * n <= F.col("_in")).drop("_in")


def running(df: DataFrame, keys: list[str], order: list[str], **aggs: Column) -> DataFrame:
    """Keyed running aggregates, one output row for each input row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[a.over(w).alias(c) for c, a in aggs.items()])
