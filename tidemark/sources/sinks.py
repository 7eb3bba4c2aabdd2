"""Sinks: statement sets, upserts, partitioned files with commits, changelogs, bulk documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Sink = Callable[[DataFrame], Any]


def statement_set(source: DataFrame, inserts: list[tuple[Callable[[DataFrame], DataFrame], Sink]], checkpoint: str | None = None):
    """Several inserts of one source as one job.

    A bounded source is kept while they run, so it is computed once. A stream feeds them
    all from one query, micro-batch by micro-batch; the query is returned.
    """

    def run(df: DataFrame, _epoch: int = 0) -> None:
        df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for query, sink in inserts:
                sink(query(df))
        finally:
            df.unpersist()

    if not source.isStreaming:
        return run(source)
    writer = source.writeStream.foreachBatch(run).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def csv_file(path: str) -> Sink:
    """One CSV file with a header, overwritten."""
    return lambda df: df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def text_files(path: str) -> Sink:
    return lambda df: df.write.mode("append").text(path)


def blackhole() -> Sink:
    return lambda df: df.write.format("noop").mode("overwrite").save()


def partitioned(path: str, by: list[str], fmt: str = "parquet") -> Sink:
    return lambda df: df.write.mode("append").partitionBy(*by).format(fmt).save(path)


def commit_partitions(df: DataFrame, path: str, by: list[str], ts: str, *, delay: str, checkpoint: str, fmt: str = "parquet"):
    """A partitioned file stream that marks a partition with _SUCCESS once event time has passed its rows by ``delay``.

    Event time is the latest ``ts`` seen so far. Marks are idempotent and held as files, so
    a restarted query neither forgets nor repeats one. A micro-batch's rows are written once
    even if it runs again: what its epoch has written is replaced. Returns the query.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        # each epoch has files of its own under every partition, so a second run overwrites the first
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "_epoch").format(fmt).save(path)
        seen = batch.groupBy(*by).agg(F.max(ts).alias("last"))
        seen.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{path}/_progress")
        batch.unpersist()
        progress = spark.read.parquet(f"{path}/_progress")
        now = progress.agg(F.max("last").alias("now"))
        due = progress.groupBy(*by).agg(F.max("last").alias("last")).join(F.broadcast(now)).where(F.col("last") + F.expr(f"INTERVAL {delay}") < F.col("now"))
        files = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        for row in due.toLocalIterator():  # partitions that are due, one at a time
            mark = files.Path("/".join([path, *[f"{c}={row[c]}" for c in by], "_SUCCESS"]))
            fs = mark.getFileSystem(conf)
            if not fs.exists(mark):
                fs.create(mark).close()

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a Parquet table at its last row per key: what a key-value or SQL store would hold.

    Each batch writes a new version of the whole table, v0, v1 and so on; a batch that runs
    again writes the same version again. The last but one is kept for that, older ones are
    deleted. A version that should be there and isn't is an error.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        rows = batch.unionByName(spark.read.parquet(f"{path}/v{epoch - 1}")) if epoch else batch
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("_r")).select("_r.*")
        last.write.mode("overwrite").parquet(f"{path}/v{epoch}")
        old = files.Path(f"{path}/v{epoch - 2}")
        old.getFileSystem(conf).delete(old, True)

    return run


def merge_sql(url: str, table: str, stage: str, keys: list[str], columns: list[str]) -> str:
    """One statement that puts a staging table's rows into a table by key, in the dialect of the URL."""
    rest = [c for c in columns if c not in keys]
    mysql = url.startswith(("jdbc:mysql:", "jdbc:mariadb:"))
    staged = {c: f"`{c}`" if mysql else f'"{c}"' for c in columns}  # Spark quotes the names of the tables that it creates
    names, values = ", ".join(columns), ", ".join(staged.values())
    if mysql:
        sets = ", ".join(f"{c} = VALUES({c})" for c in rest or keys)
        return f"INSERT INTO {table} ({names}) SELECT {values} FROM {stage} ON DUPLICATE KEY UPDATE {sets}"
    if url.startswith(("jdbc:postgresql:", "jdbc:sqlite:")):
        sets = "UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in rest) if rest else "NOTHING"
        return f"INSERT INTO {table} ({names}) SELECT {values} FROM {stage} WHERE true ON CONFLICT ({', '.join(keys)}) DO {sets}"
    on = " AND ".join(f"t.{k} = s.{staged[k]}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = s.{staged[c]}' for c in rest)}" if rest else ""
    return f"MERGE INTO {table} AS t USING {stage} AS s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join('s.' + v for v in staged.values())})"


def jdbc_upsert(url: str, table: str, keys: list[str], order: list[str], **options: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts each batch's last row per key into a table that exists.

    Executors write a staging table, ``table`` with the suffix _stage, over JDBC; one
    statement then merges it. A batch that runs again has the same effect.
    """

    def run(batch: DataFrame, _epoch: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("_r")).select("_r.*")
        stage = f"{table}_stage"
        last.write.mode("overwrite").format("jdbc").options(url=url, dbtable=stage, **options).save()
        properties = batch.sparkSession._jvm.java.util.Properties()
        for name in ("user", "password"):
            if name in options:
                properties.setProperty(name, options[name])
        connection = batch.sparkSession._jvm.java.sql.DriverManager.getConnection(url, properties)
        try:
            statement = connection.createStatement()
            statement.executeUpdate(merge_sql(url, table, stage, keys, batch.columns))
            statement.close()
        finally:
            connection.close()

    return run


def changelog(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``op``: +I inserted, -U and +U updated, -D deleted, from a keyed result before and after."""
    cols = [c for c in new.columns if c not in keys]
    a, b = (df.select(*keys, F.struct(F.lit(1).alias("_"), *cols).alias(n)) for df, n in ((new, "_new"), (old, "_old")))
    both = a.join(b, keys, "full")
    change = lambda op, row: F.struct(F.lit(op).alias("op"), row.alias("row"))
    ops = (
        F.when(F.col("_old").isNull(), F.array(change("+I", F.col("_new"))))
        .when(F.col("_new").isNull(), F.array(change("-D", F.col("_old"))))
        .when(~F.col("_old").eqNullSafe(F.col("_new")), F.array(change("-U", F.col("_old")), change("+U", F.col("_new"))))
    )
    return both.select(*keys, F.explode(ops).alias("_c")).select("_c.op", *keys, *[F.col(f"_c.row.{c}").alias(c) for c in cols])


def fold(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table that a changelog comes to: per key the last change by ``order``, unless it takes the row away.

    ``order`` must tell the changes of a key apart. Works on all changes so far, or on the
    table so far and a batch of changes. The columns but op and those of ``order`` come back.
    """
    cols = [c for c in changes.columns if c not in keys and c != "op" and c not in order]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("op", *cols), F.struct(*order)).alias("_r"))
    return last.where(F.col("_r.op").isin("+I", "+U")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def canal_json(changes: DataFrame) -> DataFrame:
    """A changelog as canal-json messages."""
    kind = F.when(F.col("op").isin("+I", "+U"), "INSERT").otherwise("DELETE")
    cols = [c for c in changes.columns if c != "op"]
    return changes.select(F.to_json(F.struct(F.array(F.struct(*cols)).alias("data"), kind.alias("type"))).alias("value"))


def bulk_lines(df: DataFrame, index: str, id_cols: list[str] | None = None) -> DataFrame:
    """Rows as a search engine's bulk request: an action line and a document line, as one text each."""
    ident = {"_id": F.concat_ws("_", *id_cols)} if id_cols else {}
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), *[v.alias(k) for k, v in ident.items()]).alias("index")))
    return df.select(F.concat_ws("\n", action, F.to_json(F.struct(*df.columns))).alias("value"))


def put_item(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as key-value put requests, typed: {"Item": {name: {"S" or "N": text}}}, with the item's key."""
    cell = lambda c, t: F.create_map(F.lit("N" if t in ("int", "bigint", "double", "float") or t.startswith("decimal") else "S"), F.col(c).cast("string"))
    item = F.struct(*[cell(c, t).alias(c) for c, t in df.dtypes])
    return df.select(F.concat_ws("|", *keys).alias("key"), F.to_json(F.struct(item.alias("Item"))).alias("value"))
