"""Runs bounded streams to their end, for parity with batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ROCKSDB


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; a temporary one in local mode only, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base}/stream-{uuid.uuid4().hex}"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store of queries that start inside; each keeps the settings that it starts with.

    It doesn't count its rows, for which every write would first look its key up.
    """
    store = "spark.sql.streaming.stateStore"
    held = {f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.trackTotalNumberOfRows": "false"}
    before = {name: spark.conf.get(name, None) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def _run(df: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> None:
    trigger = {"once": True} if once else {"availableNow": True}
    with _rocksdb(df.sparkSession):
        query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table as a stream, its event times as timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}*.parquet")
    return df.withColumns({f.name: df[f.name].cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def _kept(base: str, outputs: dict[str, Column | None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch's rows to each output whose condition they meet, under the batch's epoch.

    A batch that runs again replaces what it has written. Each batch is computed once, to its
    end: a look at some of its rows first, such as whether there are any, would run stateful
    steps twice and break off the first run while their state is being changed.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        if len(outputs) > 1:
            batch.persist()
        try:
            for name, condition in outputs.items():
                rows = batch if condition is None else batch.where(condition)
                rows.write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch}")
        finally:
            batch.unpersist()

    return keep


def _written(spark: SparkSession, path: str, schema: StructType, epochs: bool = False) -> DataFrame:
    """What ``_kept`` wrote, with the epoch as a column if asked for."""
    full = StructType([*schema.fields, StructField("epoch", LongType())])
    df = spark.read.schema(full).parquet(path) if _exists(spark, path) else spark.createDataFrame([], full)
    return df if epochs else df.drop("epoch")


def finish(df: DataFrame, mode: str = "append", once: bool = False) -> DataFrame:
    """All that a stream emits by the end of its input, from a checkpointed query into files.

    In complete mode the last result; in update mode every update. Processors on processing
    time always ask for another batch, so their queries run ``once``.
    """
    spark, base = df.sparkSession, shared_folder(df.sparkSession)
    keep = _kept(base, {"out": None})
    write = (lambda batch, epoch: keep(batch, 0)) if mode == "complete" else keep
    _run(df, mode, write, f"{base}/state", once)
    return _written(spark, f"{base}/out", df.schema)


def stepwise(steps: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], *, mode: str = "append", outputs: dict[str, Column] | None = None, once: bool = False, folder: str | None = None, checkpoint: str = "state") -> dict[str, DataFrame]:
    """A stream whose input arrives in steps; the query stops after each and goes on from its checkpoint with the next.

    ``build`` makes the query from the stream of the steps' rows. Each of ``outputs`` (name:
    condition; one named "out" with all rows if none is given) comes back as a table with
    the column epoch, the micro-batch that wrote a row; all are written by the one query.
    ``folder`` continues what an earlier call left there, from its checkpoint or from
    ``checkpoint``, a copy of that which was made in the folder meanwhile; such a run has
    outputs of its own.
    """
    base, read, schema, result = folder, 0, None, None
    conditions = outputs or {"out": None}
    for step in steps:
        spark, schema = step.sparkSession, step.schema
        base = base or shared_folder(spark)
        step.write.mode("append").parquet(f"{base}/in")
        result = build(spark.readStream.schema(schema).parquet(f"{base}/in"))
        to = base if checkpoint == "state" else f"{base}/from-{checkpoint}"
        _run(result, mode, _kept(to, conditions), f"{base}/{checkpoint}", once)
        read += 1
    if not read:
        raise ValueError("no steps")
    return {name: _written(spark, f"{to}/{name}", result.schema, True) for name in conditions}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
