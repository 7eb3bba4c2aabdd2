"""What several operators of this subpackage share: settings, word splitting and lineage cuts."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import Any
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space. ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark setting that drops an execution's shuffle files as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot that has more than one in so many of all rows; hence there are no more hot keys than that.
HOT_SHARE = 1000
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` returns, made once in each Python worker, which serves many tasks."""
    held = sys.__dict__.setdefault("_tidemark_worker_cache", {})
    if key not in held:
        held[key] = build()
    return held[key]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir or set by hand; a temporary one in local mode only."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """The rows of ``df``, written as a table in the shared folder, by the writer's ``options``, and read from there.

    Later steps don't depend on executors that hold earlier ones' shuffle files, so those
    are dropped once the table stands; ``forget`` drops the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes what ``cut_lineage`` wrote; nothing may read it any more."""
    for df in tables:
        spark, folder = df.sparkSession, _written.pop(df)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def over(table: DataFrame, view: DataFrame) -> DataFrame:
    """``view``, which reads nothing but a written table and stands for it in ``forget``."""
    _written[view] = _written[table]
    return view


def join_dealt(rows: DataFrame, table: DataFrame, key: str, *, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row for a ``key``, with hot keys dealt to many tasks.

    A key is hot that has more than one in HOT_SHARE of all rows. So there are fewer hot
    keys than that, and a row for each is broadcast; their rows are dealt into parts, and
    their rows of ``table`` copied to each part. ``counts`` says how many rows a key has
    (key, _n), if that is known; else ``rows`` is read twice and should be written.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
        total = rows.count()
    else:
        total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / limit).cast("int").alias("_hot_parts")))
    parts = F.coalesce("_hot_parts", F.lit(1))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").select(*rows.columns, F.pmod(F.xxhash64(*rows.columns), parts).cast("int").alias("_part"))
    copied = table.join(hot, F.col(key) == F.col("_hot"), "left").select(*table.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
