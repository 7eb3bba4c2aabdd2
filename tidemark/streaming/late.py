"""Windows that fire again for late rows, with rows that are too late beside them.

Spark drops rows behind its watermark before a processor sees them. So the stream's
watermark is set a HORIZON behind the time that counts, and the processor adds it again:
timers are registered, and rows judged, a HORIZON earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HORIZON_S = 1000 * 86_400
WINDOWS = "window_start_ms long, n long, lowest double, highest double, total double"


class LateWindow(StatefulProcessor):
    """(key, kind, ts, window_start_ms, n, lowest, highest, total) of tumbling windows.

    kind "fired": the window as the watermark passes its end. "refired": the window with
    rows that came after that, at most ``lateness_ms`` behind; a row for each micro-batch
    that has such. "late": a row beyond that, ts and highest its time and value. A window's
    state is kept until its lateness has passed.
    """

    def __init__(self, column: str, ts: str, size_ms: int, lateness_ms: int):
        self.column, self.ts, self.size, self.lateness = column, ts, size_ms, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long", "n long, lowest double, highest double, total double")

    def row(self, key: tuple, kind: str, start: int, state: tuple) -> Row:
        return Row(key=key[0], kind=kind, ts=None, window_start_ms=start, **dict(zip(("n", "lowest", "highest", "total"), state, strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() + HORIZON_S * 1000
        changed: dict[int, tuple] = {}
        for r in rows:
            at, value = int(r["_ms"]), r[self.column]
            start = at - at % self.size
            if start + self.size + self.lateness <= mark:
                yield Row(key=key[0], kind="late", ts=r[self.ts], window_start_ms=start, n=None, lowest=None, highest=value, total=None)
                continue
            if start not in changed:
                changed[start] = tuple(self.windows.getValue((start,))) if self.windows.containsKey((start,)) else (0, None, None, 0.0)
            n, low, high, total = changed[start]
            changed[start] = (n + 1, value if low is None else min(low, value), value if high is None else max(high, value), total + value)
        for start, state in changed.items():
            self.windows.updateValue((start,), state)
            end = start + self.size
            if end <= mark:
                yield self.row(key, "refired", start, state)
            else:
                self.handle.registerTimer(end - HORIZON_S * 1000)
            self.handle.registerTimer(end + self.lateness - HORIZON_S * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() + HORIZON_S * 1000
        fired, gone = at - self.size, at - self.size - self.lateness
        if fired % self.size == 0 and self.windows.containsKey((fired,)):
            yield self.row(key, "fired", fired, tuple(self.windows.getValue((fired,))))
        if gone % self.size == 0 and self.windows.containsKey((gone,)):
            self.windows.removeKey((gone,))

    def close(self) -> None:
        pass


def late_windows(df: DataFrame, key: str, column: str, ts: str, *, size_s: int, lateness_s: int, delay_s: int) -> DataFrame:
    """A stream's windows by :class:`LateWindow`; ``delay_s`` is how far rows may come out of order.

    Rows with a null in the column or the time are left out; null keys are a key.
    """
    rows = df.where(F.col(column).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("double").alias(column), F.col(ts), F.unix_millis(ts).alias("_ms"))
    rows = rows.withWatermark(ts, f"{delay_s + HORIZON_S} seconds")
    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithState(LateWindow(column, ts, size_s * 1000, lateness_s * 1000), f"key {kind}, kind string, ts timestamp, {WINDOWS}", "append", "eventTime")
