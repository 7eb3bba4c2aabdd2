"""Joins that relate rows by time: as-of (versioned), interval and lookup joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class VersionedTable:
    """The history of a keyed table: each row is valid from ``ts`` until its key's next row."""

    df: DataFrame
    key: str
    ts: str

    def intervals(self) -> DataFrame:
        """Rows with valid_from and valid_to (exclusive; null for the current version)."""
        nxt = F.lead(self.ts).over(Window.partitionBy(self.key).orderBy(self.ts))
        return self.df.withColumn("valid_from", F.col(self.ts)).withColumn("valid_to", nxt)

    def current(self) -> DataFrame:
        """The last version of each key."""
        row = F.max_by(F.struct(*self.df.columns), self.ts).alias("_r")
        return self.df.groupBy(self.key).agg(row).select("_r.*")


def asof_join(left: DataFrame, versions: VersionedTable, on: str, ts: str, *, how: str = "inner", prefix: str = "", slice_s: int = 86_400) -> DataFrame:
    """Each left row with the version of its key that was valid at its time; batch.

    The right columns but its key come back, ``prefix`` before their names. With how="left"
    rows without a version stay, with nulls. Of versions with one timestamp the last one
    by its remaining columns counts.

    No key is handled in one piece: rows are sorted within (key, time slice), and a row
    whose version is older than its slice takes the last one of the slices before, found
    from one row per key and slice. So a hot key is spread over its slices.
    """
    right_cols = [c for c in versions.df.columns if c != versions.key]
    version = F.struct(F.col(versions.ts).alias("_ts"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(right_cols)])
    of = lambda t: F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / slice_s)
    right = versions.df.select(F.col(versions.key).alias("_k"), F.col(versions.ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), version.alias("_r"))
    rows = left.select(F.col(on).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema["_r"].dataType).alias("_r"))
    both = right.unionByName(rows).withColumn("_slice", of("_t"))
    inside = Window.partitionBy("_k", "_slice").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_in", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    per_slice = right.withColumn("_slice", of("_t")).groupBy("_k", "_slice").agg(F.max("_r").alias("_last"))
    asked = rows.select("_k", of("_t").alias("_slice")).distinct()
    slices = asked.join(per_slice, ["_k", "_slice"], "full")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = slices.select(F.col("_k").alias("_ck"), F.col("_slice").alias("_cs"), before.alias("_before"))
    joined = found.join(carried, F.col("_k").eqNullSafe(F.col("_ck")) & F.col("_slice").eqNullSafe(F.col("_cs")), "left")
    chosen = joined.withColumn("_got", F.when(F.col("_k").isNotNull(), F.coalesce("_in", "_before")))
    if how == "inner":
        chosen = chosen.where(F.col("_got").isNotNull())
    return chosen.select("_l.*", *[F.col("_got").getField(f"_v{i}").alias(prefix + c) for i, c in enumerate(right_cols)])


def star_join(facts: DataFrame, ts: str, roles: dict[str, tuple[VersionedTable, str]], *, slice_s: int = 86_400) -> DataFrame:
    """Facts with the versions, valid at their time, of dimensions in several roles; batch.

    ``roles`` names, for each role, the dimension and the fact's column that refers to its
    key; its columns come back with the role and an underscore before their names, null
    where no version was valid.
    """
    for role, (dimension, on) in roles.items():
        facts = asof_join(facts, dimension, on, ts, how="left", prefix=f"{role}_", slice_s=slice_s)
    return facts


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_ts: Column, right_ts: Column, lower: str, upper: str, how: str = "inner") -> DataFrame:
    """Pairs with left_ts + lower <= right_ts <= left_ts + upper. In streaming both sides need a watermark, which bounds the state."""
    return left.join(right, on & right_ts.between(left_ts + F.expr(f"INTERVAL {lower}"), left_ts + F.expr(f"INTERVAL {upper}")), how)


def lookup_join(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Rows, streaming or not, with a table's current values; the table is read anew for each micro-batch."""
    return rows.join(table, on, how)


def unmatched(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Left rows without a partner: what an outer join and a null filter come to."""
    return left.join(right, on, "left_anti")
