"""Unions, splits and fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged(**frames: DataFrame) -> DataFrame:
    """Several typed inputs as one stream: ``tag`` names the input, missing columns are null."""
    return union_all(*[df.withColumn("tag", F.lit(k)) for k, df in frames.items()])


def split_outputs(df: DataFrame, outputs: dict[str, Column], exclusive: bool = False) -> dict[str, DataFrame]:
    """Side outputs by predicate, and "main": every row, or with ``exclusive`` those no predicate took."""
    taken = reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in outputs.values()], F.lit(False))
    return {k: df.where(p) for k, p in outputs.items()} | {"main": df.where(~taken) if exclusive else df}
