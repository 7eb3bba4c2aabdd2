"""Continuous Top-N per key over counts, as a changelog with retractions."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .packed import AT_ONCE, apply_packed


class TopChanges(StatefulProcessor):
    """(key, rank, op, seq, item, n): how the ``most`` items with the greatest counts of a key change.

    Rows are (key, item, delta). A micro-batch gives each rank that changed its old row
    (-U, or -D if nothing takes the rank) and its new one (+U, or +I if the rank was
    empty), numbered by seq. Equal counts rank by item. Every item's count is kept, in
    state that needn't fit in memory but by one of its 1024 buckets, each read and written
    once a micro-batch; items untouched since the last batch can only come up when one of
    the best goes down, and are looked through only then.
    """

    buckets = 1024

    def __init__(self, most: int, item: str):
        self.most, self.item = most, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "bucket long", f"items array<{self.item}>, counts array<long>")
        self.best = handle.getListState("best", f"item {self.item}, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        deltas: Counter = Counter()
        for r in rows:
            deltas[r["item"]] += r["delta"]
        old = [(r[0], r[1]) for r in self.best.get()] if self.best.exists() else []
        now = dict(old)
        dealt: dict[int, list] = defaultdict(list)
        for item, delta in deltas.items():
            if delta:
                dealt[crc32(repr(item).encode()) % self.buckets].append((item, delta))
        for bucket, changes in dealt.items():
            held = self.counts.getValue((bucket,))
            counts = dict(zip(*held, strict=True)) if held else {}
            for item, delta in changes:
                n = counts.pop(item, 0) + delta
                if n > 0:
                    counts[item] = now[item] = n
                else:
                    now.pop(item, None)
            self.counts.updateValue((bucket,), (list(counts), list(counts.values()))) if counts else self.counts.removeKey((bucket,))
        if any(deltas[item] < 0 for item, _ in old):
            now = {item: n for _, held in self.counts.iterator() for item, n in zip(*held, strict=True)}
        new = sorted(now.items(), key=lambda x: (-x[1], x[0]))[: self.most]
        seq = 0
        for rank in range(1, max(len(old), len(new)) + 1):
            was, now_row = (x[rank - 1] if rank <= len(x) else None for x in (old, new))
            if was == now_row:
                continue
            for op, row in (("-U" if now_row else "-D", was), ("+U" if was else "+I", now_row)):
                if row:
                    yield Row(key=key[0], rank=rank, op=op, seq=seq, item=row[0], n=row[1])
                    seq += 1
        self.best.put(new) if new else self.best.clear()

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a task's rows, in parts of AT_ONCE or fewer pairs."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= AT_ONCE:
            held = [pd.concat(held).groupby(["key", "item"], as_index=False, sort=False)["delta"].sum()]
            if len(held[0]) > AT_ONCE // 2:
                yield held.pop()
    if held:
        yield pd.concat(held).groupby(["key", "item"], as_index=False, sort=False)["delta"].sum()


def top_counts(df: DataFrame, key: str, item: str, most: int, *, delta: str | None = None) -> DataFrame:
    """The changelog of each key's ``most`` commonest items; ``delta`` names a column of 1 and -1 where rows can be taken back.

    Rows with a null key or item don't count. Rows are dealt by key and item and
    counted where they come together, so a hot key's task takes a number for each item.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("key"), F.col(item).alias("item"), (F.col(delta) if delta else F.lit(1)).cast("long").alias("delta"))
    of_key, of_item = (df.schema[c].dataType.simpleString() for c in (key, item))
    few = rows.repartition("key", "item").mapInPandas(_combined, rows.schema)
    return apply_packed(few, ["key"], TopChanges(most, of_item), f"key {of_key}, rank int, op string, seq int, item {of_item}, n long", "update", together=False)
