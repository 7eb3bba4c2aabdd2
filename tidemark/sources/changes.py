"""Keyed change streams: upserts and tombstones, as versions of a table and as the table itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.joins import VersionedTable, asof_join


def decoded(records: DataFrame, key_schema: str, value_schema: str, *, raw_key: str | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """Records with a key and a JSON value as rows: key columns, ``deleted``, value columns and whatever else the records have.

    The key is JSON, or with ``raw_key`` the text of that one column, cast to its type. A
    null value is a tombstone: the key's row is deleted. Records without a key are dropped.
    """
    others = [c for c in records.columns if c not in (key, value)]
    name, _, kind = key_schema.partition(" ")
    keys = [F.col(key).cast("string").cast(kind).alias(raw_key)] if raw_key else [F.from_json(F.col(key).cast("string"), key_schema).alias("_k")]
    if raw_key and name != raw_key:
        raise ValueError("a raw key is one column, named as in its schema")
    rows = records.where(F.col(key).isNotNull()).select(*keys, F.col(value).isNull().alias("deleted"), F.from_json(F.col(value).cast("string"), value_schema).alias("_v"), *others)
    return rows.select(raw_key or "_k.*", "deleted", "_v.*", *others)


def encoded(rows: DataFrame, keys: list[str], *, deleted: str | None = None, raw_key: bool = False, beside: list[str] | None = None) -> DataFrame:
    """Rows as records (key, value): the value is null where ``deleted`` is true. Columns ``beside`` stay beside the record."""
    beside = beside or []
    if raw_key and len(keys) != 1:
        raise ValueError("a raw key is one column")
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in (*keys, *beside, deleted)]))
    ident = F.col(keys[0]).cast("string") if raw_key else F.to_json(F.struct(*keys))
    return rows.select(ident.alias("key"), (F.when(~F.col(deleted), body) if deleted else body).alias("value"), *beside)


def asof_changes(left: DataFrame, changes: DataFrame, on: str, ts: str, *, key: str, change_ts: str, how: str = "inner", slice_s: int = 86_400) -> DataFrame:
    """Each left row with the version of its key at its time, where a deletion ends the version before it and begins none.

    Of changes of one key and time an upsert comes after a deletion.
    """
    columns = [c for c in changes.columns if c not in (key, "deleted")]
    packed = changes.select(key, change_ts, (~F.col("deleted")).alias("_live"), *[c for c in columns if c != change_ts])
    found = asof_join(left, VersionedTable(packed, key, change_ts), on, ts, how=how, prefix="_c_", slice_s=slice_s)
    live = F.col("_c__live")
    shown = [F.when(live, F.col(f"_c_{c}")).alias(c) for c in columns]
    return (found.where(live) if how == "inner" else found).select(*left.columns, *shown)


def _epochs(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Per bucket the epochs that wrote it, oldest first. A listing of two levels of folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/bucket=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    out: dict[int, list[int]] = {}
    for status in found or []:
        folder = status.getPath()
        out.setdefault(int(folder.getName().split("=")[1]), []).append(int(folder.getParent().getName().split("=")[1]))
    return {b: sorted(e) for b, e in out.items()}


def bucketed_upsert(path: str, keys: list[str], order: list[str], *, deleted: str = "deleted", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table at its last row per key, without deleted keys, and rewrites only the buckets of a batch's keys.

    A batch writes its buckets anew below its epoch, from the newest earlier epoch of each;
    one that runs again writes the same. Of each bucket the two newest versions stay, so
    that a reader of the older one isn't disturbed.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            known = _epochs(spark, path)
            before = {b: max(e for e in known[b] if e < epoch) for b in touched if any(e < epoch for e in known.get(b, []))}
            now = rows.withColumn("_new", F.lit(1))
            if before:
                paths = [f"{path}/epoch={e}/bucket={b}" for b, e in before.items()]
                full = StructType([*batch.drop(deleted).schema.fields, StructField("epoch", LongType()), StructField("bucket", IntegerType())])
                old = spark.read.option("basePath", path).schema(full).parquet(*paths).drop("epoch")
                now = now.unionByName(old.withColumn(deleted, F.lit(False)).withColumn("_new", F.lit(0)))
            last = now.groupBy("bucket", *keys).agg(F.max_by(F.struct(*batch.columns), F.struct("_new", *order)).alias("_r")).select("bucket", "_r.*")
            live = last.where(~F.col(deleted)).drop(deleted)
            folders = spark._jvm.org.apache.hadoop.fs
            live.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")
            fs = folders.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
            for b in touched:  # a bucket whose last key has gone is empty, not unchanged
                fs.mkdirs(folders.Path(f"{path}/epoch={epoch}/bucket={b}"))
                for e in [e for e in known.get(b, []) if e < before.get(b, 0)]:
                    fs.delete(folders.Path(f"{path}/epoch={e}/bucket={b}"), True)
        finally:
            batch.unpersist()

    return run


def read_bucketed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that ``bucketed_upsert`` keeps."""
    paths = [f"{path}/epoch={e[-1]}/bucket={b}" for b, e in _epochs(spark, path).items()]
    full = spark.createDataFrame([], schema)
    return spark.read.schema(full.schema).parquet(*paths) if paths else full
