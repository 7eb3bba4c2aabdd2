"""Table definitions: one object reads as a bounded or an unbounded DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableDef:
    """Schema, format and options of a table, its computed columns, watermark and key.

    ``computed`` maps names to SQL expressions, applied in order; ``watermark`` is (column,
    delay). A primary key isn't enforced; ``current()`` reads the table as an upsert table.
    """

    name: str
    schema: str
    format: str = "parquet"
    options: dict[str, Any] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    watermark: tuple[str, str] | None = None
    primary_key: tuple[str, ...] = ()
    partitioned_by: tuple[str, ...] = ()

    def with_options(self, **options: Any) -> TableDef:
        """The table with other options; dots in names as double underscores."""
        return replace(self, options=self.options | {k.replace("__", "."): v for k, v in options.items()})

    def like(self, name: str, *, excluding_options: bool = False, **changes: Any) -> TableDef:
        """Another table of the same schema, keeping the options or not."""
        return replace(self, name=name, options={} if excluding_options else self.options, **changes)

    def read(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        """Batch or streaming rows, computed columns last, the watermark set on a stream."""
        reader = spark.readStream if streaming else spark.read
        df = reader.format(self.format).schema(self.schema).options(**self.options).load()
        for name, expression in self.computed.items():
            df = df.withColumn(name, F.expr(expression))
        if self.watermark and streaming:
            column, delay = self.watermark
            df = df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)
        return df

    def current(self, spark: SparkSession, order: list[str]) -> DataFrame:
        """The last row of each primary key, by ``order``; batch."""
        df = self.read(spark)
        return df.groupBy(*self.primary_key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


class Catalog:
    """Tables by name, in batch or streaming mode; registers them as temporary views."""

    def __init__(self, spark: SparkSession, mode: str = "batch"):
        self.spark, self.mode, self.tables = spark, mode, {}

    def set(self, key: str, value: str) -> None:
        """SET 'execution.runtime-mode' = 'batch' or 'streaming'; other keys go to the session."""
        if key == "execution.runtime-mode":
            self.mode = value
            for t in self.tables.values():
                self.create(t)
        else:
            self.spark.conf.set(key, value)

    def create(self, table: TableDef) -> None:
        self.tables[table.name] = table
        if table.format in ("noop", "console"):  # these are only written
            return
        try:
            rows = table.read(self.spark, self.mode == "streaming")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], table.schema)  # nothing has been written to it yet
            rows = rows.withColumns({c: F.expr(e) for c, e in table.computed.items()})
        rows.createOrReplaceTempView(table.name)

    def alter(self, name: str, **options: Any) -> None:
        self.create(self.tables[name].with_options(**options))

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables and not if_exists:
            raise KeyError(name)
        self.tables.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def show(self) -> list[str]:
        return sorted(self.tables)

    def table(self, name: str, **options: Any) -> DataFrame:
        """The table's rows; ``options`` hold for this read only."""
        t = self.tables[name]
        return (t.with_options(**options) if options else t).read(self.spark, self.mode == "streaming")


def load_properties(groups: list[dict[str, Any]], group_id: str) -> dict[str, str]:
    """The property map of one group of an application's configuration."""
    for g in groups:
        if g["PropertyGroupId"] == group_id:
            return g["PropertyMap"]
    raise KeyError(group_id)
