"""Top-N, deduplication and latest rows. Batch; inside ``foreachBatch`` they serve streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rownum") -> DataFrame:
    """The first n rows of each key; Spark cuts each task's rows to n before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def window_top_n(df: DataFrame, order: list[Column], n: int, keys: list[str] | None = None) -> DataFrame:
    """top_n within each window of an aggregate with window_start and window_end."""
    return top_n(df, ["window_start", "window_end", *(keys or [])], order, n)


def deduplicate(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row for each key, the first or the last by ``order``; an aggregate, combined before the shuffle."""
    row, by = F.struct(*df.columns), F.struct(*order)
    pick = F.min_by(row, by) if keep == "first" else F.max_by(row, by)
    return df.groupBy(*keys).agg(pick.alias("_r")).select("_r.*")


def latest_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What an upsert table holds: the last row of each key."""
    return deduplicate(df, [key], order, keep="last")
