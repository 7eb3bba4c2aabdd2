"""Stateful processors for transformWithState (Row API), and helpers that apply them.

Rows of one micro-batch come in no order, so processors sort by their order column first.
State has declared schemas. Spark passes timer arguments by keyword, hence the names.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.match import settled
from .packed import apply_packed


def apply(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "append", time: str = "none", event_time: str = "") -> DataFrame:
    """A keyed stream through a processor; one that needs no time, with its rows packed by key, if they have more than the key."""
    if time == "none" and not event_time and set(df.columns) - set(keys):
        return apply_packed(df, keys, processor, schema, mode)
    args = {"eventTimeColumnName": event_time} if event_time else {}
    return df.groupBy(*keys).transformWithState(processor, schema, mode, time, **args)


class Alarm:
    """One event-time timer for a key, for the earliest time asked for; so that waiting rows are gone through once a watermark, not once a row."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.state = handle.getValueState("alarm", "ms long")

    def ask(self, at: datetime) -> None:
        """Wakes once the watermark is past a time. A millisecond later: Spark deletes a timer that is set anew while it expires."""
        ms = int(at.timestamp() * 1000) + 1
        before = self.state.get()[0] if self.state.exists() else None
        if before is None or ms < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.state.update((ms,))

    def rang(self) -> None:
        self.state.clear()


class Keyed(StatefulProcessor):
    """Base: one value state of ``state_schema``, rows in the order of ``order``.

    With ``ttl_ms`` a key's state is gone so long after its last change, by processing
    time, which the query must then run on.
    """

    state_schema = "v double"

    def __init__(self, order: str = "ts", ttl_ms: int | None = None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema, self.ttl_ms)

    def sorted(self, rows: Iterator[Row]) -> list[Row]:
        return sorted(rows, key=lambda r: r[self.order])

    def held(self) -> Any:
        return self.state.get()

    def close(self) -> None:
        pass


class RunningSum(Keyed):
    """(key, order, total): the sum so far, a row for each row."""

    def __init__(self, column: str, order: str = "ts", ttl_ms: int | None = None):
        super().__init__(order, ttl_ms)
        self.column = column

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total = (self.held() or (0.0,))[0]
        for r in self.sorted(rows):
            total += float(r[self.column])
            yield Row(**{"key": key[0], self.order: r[self.order], "total": total})
        self.state.update((total,))


class ChangeAlert(Keyed):
    """(key, order, before, value): rows that differ from their key's last one by more than ``limit``; a first row never does."""

    def __init__(self, column: str, limit: float, order: str = "ts", idle_ms: int | None = None, ttl_ms: int | None = None):
        super().__init__(order, ttl_ms)
        self.column, self.limit, self.idle_ms = column, limit, idle_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held()
        last = held[0] if held else None
        newest = None
        for r in self.sorted(rows):
            value = float(r[self.column])
            if last is not None and abs(value - last) > self.limit:
                yield Row(**{"key": key[0], self.order: r[self.order], "before": last, "value": value})
            last, newest = value, r[self.order]
        self.state.update((last,))
        if self.idle_ms is not None and newest is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """State that has been idle is forgotten."""
        self.state.clear()
        return iter([])


class RisingAlert(Keyed):
    """Alerts when a key's value has risen for ``wait_ms`` without falling (processing time).

    A rise sets the timer if none is set, a fall clears it, a first row does neither.
    """

    state_schema = "v double, timer long"

    def __init__(self, column: str, wait_ms: int = 1000, order: str = "ts"):
        super().__init__(order)
        self.column, self.wait_ms = column, wait_ms

    @staticmethod
    def step(last: float | None, timer: int, value: float, now: int, wait: int) -> int:
        """The timer after one value: 0 for none."""
        if last is None or value < last:
            return 0
        return timer or now + wait if value > last else timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, timer = self.held() or (None, 0)
        before, now = timer, timerValues.getCurrentProcessingTimeInMs()
        for r in self.sorted(rows):
            timer = self.step(last, timer, float(r[self.column]), now, self.wait_ms)
            last = float(r[self.column])
        if timer != before:
            if before:
                self.handle.deleteTimer(before)
            if timer:
                self.handle.registerTimer(timer)
        self.state.update((last, timer))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, _ = self.held() or (None, 0)
        self.state.update((last, 0))
        yield Row(key=key[0], message=f"{key[0]} rose for {self.wait_ms} ms", at=expiredTimerInfo.getExpiryTimeInMs())


class RuleAlert(StatefulProcessor):
    """Readings against per-key rules, both in one tagged stream: tag "rule" sets the threshold, 0 removes it.

    (key, order, value, threshold) where a reading differs from the last by more than it.
    """

    def __init__(self, order: str = "ts"):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "threshold double, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get() or (None, None)
        threshold, last = before
        for r in sorted(rows, key=lambda r: (r[self.order], r["tag"] != "rule")):
            if r["tag"] == "rule":
                threshold = r["threshold"] or None
                continue
            if threshold is not None and last is not None and abs(r["value"] - last) > threshold:
                yield Row(**{"key": key[0], self.order: r[self.order], "value": r["value"], "threshold": threshold})
            last = r["value"]
        if (threshold, last) != tuple(before):
            self.state.update((threshold, last)) if (threshold, last) != (None, None) else self.state.clear()

    def close(self) -> None:
        pass


class Switch(Keyed):
    """Forwards a key's rows for as many milliseconds after a switch row as that row says; both in one tagged stream."""

    state_schema = "until long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = until = (self.held() or (0,))[0]
        for r in sorted(rows, key=lambda r: (r[self.order], r["tag"] != "switch")):
            at = int(r[self.order].timestamp() * 1000)
            if r["tag"] == "switch":
                until = at + r["for_ms"]
            elif at < until:
                yield Row(**{"key": key[0], self.order: r[self.order], "value": r["value"]})
        if until != before:
            self.state.update((until,))


class CountWindow(StatefulProcessor):
    """(key, bucket, n, total) for every n rows of a key; what is left over stays in state."""

    def __init__(self, column: str, n: int, order: str = "ts"):
        self.column, self.n, self.order = column, n, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "bucket long, n int, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        bucket, n, total = self.state.get() if self.state.exists() else (0, 0, 0.0)
        for r in sorted(rows, key=lambda r: r[self.order]):
            n, total = n + 1, total + float(r[self.column])
            if n == self.n:
                yield Row(key=key[0], bucket=bucket, n=n, total=total)
                bucket, n, total = bucket + 1, 0, 0.0
        self.state.update((bucket, n, total))

    def close(self) -> None:
        pass


class Cumulative(StatefulProcessor):
    """Totals per key over all its windows, after a window aggregate: rows have window_start, n and total."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for r in sorted(rows, key=lambda r: r["window_start"]):
            n, total = n + r["n"], total + r["total"]
            yield Row(key=key[0], window_start=r["window_start"], n=n, total=total)
        self.state.update((n, total))

    def close(self) -> None:
        pass


class LateTag(StatefulProcessor):
    """Rows as they are with watermark_ms and late (ts before the watermark, or with ``inclusive`` at it).

    Runs on processing time, where Spark hands over late rows too.
    """

    def __init__(self, columns: list[str], ts: str = "ts", inclusive: bool = False):
        self.columns, self.ts, self.inclusive = columns, ts, inclusive

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            at = int(r[self.ts].timestamp() * 1000)
            yield Row(**{c: r[c] for c in self.columns}, watermark_ms=mark, late=at <= mark if self.inclusive else at < mark)

    def close(self) -> None:
        pass


class AsOf(StatefulProcessor):
    """Streaming as-of join of one tagged stream: tag "version" rows are a key's history, "row" rows wait until the watermark passes them.

    (key, ts, id, version_ts, version). Versions older than the one in force at the watermark are dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = Alarm(handle)
        self.versions = handle.getListState("versions", "ts timestamp, version string")
        self.waiting = handle.getListState("waiting", "ts timestamp, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        versions, waiting = [], []
        for r in rows:
            if r["tag"] == "version":
                versions.append((r["ts"], r["version"]))
            else:
                waiting.append((r["ts"], r["id"]))
        if versions:
            self.versions.appendList(versions)
        if waiting:
            self.waiting.appendList(waiting)
            self.alarm.ask(min(w[0] for w in waiting))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.alarm.rang()
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        versions, waiting = sorted(self.versions.get()), list(self.waiting.get())
        due = sorted(w for w in waiting if w[0].timestamp() <= mark)
        out, at = [], -1
        for ts, i in due:
            while at + 1 < len(versions) and versions[at + 1][0] <= ts:
                at += 1
            out.append(Row(key=key[0], ts=ts, id=i, version_ts=versions[at][0] if at >= 0 else None, version=versions[at][1] if at >= 0 else None))
        old = [v for v in versions if v[0].timestamp() <= mark]
        self.versions.put(old[-1:] + [v for v in versions if v[0].timestamp() > mark]) if versions else None
        rest = [w for w in waiting if w[0].timestamp() > mark]
        if rest:
            self.waiting.put(rest)
            self.alarm.ask(min(w[0] for w in rest))
        else:
            self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        pass


class EarlyWindow(StatefulProcessor):
    """Tumbling windows that fire early, once each ``every_ms`` of event time, and finally at their end.

    (key, window_start_ms, n, total, final). Needs event time. A key's open windows and the
    times at which they are to fire are read and written once a micro-batch, and one timer
    wakes the key for the earliest.
    """

    def __init__(self, column: str, size_ms: int, every_ms: int, ts: str = "ts"):
        self.column, self.size, self.every, self.ts = column, size_ms, every_ms, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = handle.getValueState("alarm", "ms long")
        self.windows = handle.getListState("windows", "start long, n long, total double, due array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {w[0]: [w[1], w[2], set(w[3])] for w in self.windows.get()}
        for r in rows:
            at = int(r[self.ts].timestamp() * 1000)
            start = at - at % self.size
            window = held.setdefault(start, [0, 0.0, set()])
            window[0] += 1
            window[1] += float(r[self.column])
            window[2].add(min(at - at % self.every + self.every, start + self.size))
        self._wait([(start, n, total, sorted(due)) for start, (n, total, due) in held.items()], self.alarm.get()[0] if self.alarm.exists() else None)
        return iter([])

    def _wait(self, held: list[tuple], before: int | None) -> None:
        """Keeps the open windows and sets the timer for the earliest firing, in place of one set ``before``."""
        self.windows.put(held)
        first = min(min([start + self.size, *due]) for start, _, _, due in held)
        if before != first:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)
            self.alarm.update((first,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark, out, rest = timerValues.getCurrentWatermarkInMs(), [], []
        for start, n, total, due in self.windows.get():
            end = start + self.size
            out += [Row(key=key[0], window_start_ms=start, n=n, total=total, final=False) for at in due if at <= mark and at < end]
            if end <= mark:
                out.append(Row(key=key[0], window_start_ms=start, n=n, total=total, final=True))
            else:
                rest.append((start, n, total, [at for at in due if at > mark]))
        if rest:
            self._wait(rest, None)
        else:
            self.windows.clear()
            self.alarm.clear()
        return iter(out)

    def close(self) -> None:
        pass


class PatternMatch(StatefulProcessor):
    """Streaming row pattern matching; needs event time, and emits once the watermark has passed what decides a match.

    columns: DDL of the input columns that rows are kept with; the others as in
    :func:`tidemark.operators.match.match_recognize`. Rows come out as (key, measures).
    """

    def __init__(self, columns: str, pattern: str, define: dict, measures: dict, order: list[str], ts: str = "ts", after: str = "PAST LAST ROW", within: Any = None):
        self.columns, self.pattern, self.define, self.measures = columns, pattern, define, measures
        self.order, self.ts, self.after, self.within = order, ts, after, within
        self.names = [c.split()[0] for c in columns.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = Alarm(handle)
        self.rows = handle.getListState("rows", self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = list(rows)
        self.rows.appendList([tuple(r[c] for c in self.names) for r in new])
        self.alarm.ask(min(r[self.ts] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.alarm.rang()
        mark = datetime.fromtimestamp(timerValues.getCurrentWatermarkInMs() / 1000)
        kept = [dict(zip(self.names, r, strict=True)) for r in self.rows.get()]
        due = sorted((r for r in kept if r[self.ts] <= mark), key=lambda r: [r[c] for c in self.order])
        found, done = settled(due, self.pattern, self.define, self.after, self.within and (self.ts, self.within), mark)
        later = [r for r in kept if r[self.ts] > mark]
        rest = due[done:] + later
        self.rows.put([tuple(r[c] for c in self.names) for r in rest]) if rest else self.rows.clear()
        if later:
            self.alarm.ask(min(r[self.ts] for r in later))
        return iter([Row(key=key[0], **{k: f(m) for k, f in self.measures.items()}) for m in found])

    def close(self) -> None:
        pass


def schema_of(df: DataFrame, *more: str) -> StructType:
    """The DDL of a frame's columns and more."""
    return StructType.fromDDL(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + list(more)))
