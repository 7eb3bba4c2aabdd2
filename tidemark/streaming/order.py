"""Sorting a stream by event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class SortBuffer(StatefulProcessor):
    """Holds the rows of one time range until the watermark has passed its end, and then lets them go in order."""

    def __init__(self, columns: str, names: list[str], ts: str, range_ms: int):
        self.columns, self.names, self.ts, self.range = columns, names, ts, range_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.rows.appendList([tuple(r[c] for c in self.names) for r in rows])
        self.handle.registerTimer((key[0] + 1) * self.range)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = self.names.index(self.ts)
        rows = sorted((tuple(r) for r in self.rows.get()), key=lambda r: r[at])
        self.rows.clear()
        for r in rows:
            yield Row(**dict(zip(self.names, r, strict=True)))

    def close(self) -> None:
        pass


def in_order(df: DataFrame, ts: str, *, delay_s: int, range_s: int = 60) -> DataFrame:
    """A stream's rows in the order of ``ts``: every row of a micro-batch comes after all rows of earlier ones.

    Rows wait until the watermark, ``delay_s`` behind the latest time, has passed the end
    of their time range; later rows are dropped, as are rows without a time. Ranges are
    what tasks share out, so within a micro-batch a sink that needs one order sorts by
    ``ts``, which Spark does by ranges. What a range holds must fit in a task.
    """
    timed = df.where(F.col(ts).isNotNull()).withWatermark(ts, f"{delay_s} seconds")
    rows = timed.withColumn("_range", F.floor(F.unix_millis(ts) / (range_s * 1000)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.groupBy("_range").transformWithState(SortBuffer(schema, df.columns, ts, range_s * 1000), schema, "append", "eventTime")
