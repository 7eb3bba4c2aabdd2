"""User-defined aggregates that combine before the shuffle.

An :class:`Aggregate` says how an accumulator is made, takes rows in, merges with another
and gives a result. Each task keeps an accumulator per key, so what is shuffled is a few
bytes per key and task, however many rows a key has; after the shuffle, accumulators are
merged as they come, one key at a time. Each carries the key it was made for, and merging
two of different keys is refused.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keys that a task keeps before it hands its accumulators on.
HELD = 100_000


class Aggregate:
    """What a user writes. Accumulators must pickle, best as plain tuples; ``merge`` must not care about order."""

    def create(self) -> Any:
        raise NotImplementedError

    def add(self, acc: Any, row: Any) -> Any:
        """The accumulator with a row (a named tuple of the input columns) taken in."""
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def result(self, acc: Any) -> tuple:
        """Values of the result columns."""
        raise NotImplementedError

    def add_rows(self, acc: Any, rows: pd.DataFrame) -> Any:
        """Many rows at once; to be overridden where arrays are faster."""
        for row in rows.itertuples(index=False):
            acc = self.add(acc, row)
        return acc


@dataclass
class Held:
    """An accumulator and the key it belongs to."""

    key: tuple
    acc: Any

    def merged(self, other: Held, aggregate: Aggregate) -> Held:
        if self.key != other.key:
            raise ValueError(f"accumulators of different keys can't merge: {self.key} and {other.key}")
        return Held(self.key, aggregate.merge(self.acc, other.acc))


class WeightedMean(Aggregate):
    """(mean, n) of columns value and weight; rows with a null in either don't count."""

    def create(self) -> tuple:
        return (0.0, 0.0, 0)

    def add(self, acc: tuple, row: Any) -> tuple:
        if pd.isna(row.value) or pd.isna(row.weight):
            return acc
        return (acc[0] + row.value * row.weight, acc[1] + row.weight, acc[2] + 1)

    def add_rows(self, acc: tuple, rows: pd.DataFrame) -> tuple:
        rows = rows.dropna()
        return (acc[0] + float((rows["value"] * rows["weight"]).sum()), acc[1] + float(rows["weight"].sum()), acc[2] + len(rows))

    def merge(self, a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    def result(self, acc: tuple) -> tuple:
        return (acc[0] / acc[1] if acc[1] else None, acc[2])


class LastReadings(Aggregate):
    """(n, lowest, highest, last) of columns ts and value, the last by time; null values don't count."""

    def create(self) -> tuple:
        return (0, None, None, None)

    def add(self, acc: tuple, row: Any) -> tuple:
        return acc if pd.isna(row.value) else self.merge(acc, (1, row.value, row.value, (row.ts, row.value)))

    def merge(self, a: tuple, b: tuple) -> tuple:
        if not (a[0] and b[0]):
            return b if b[0] else a
        return (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))

    def result(self, acc: tuple) -> tuple:
        return (acc[0], acc[1], acc[2], acc[3] and acc[3][1])


def partial(df: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, held: int = HELD) -> DataFrame:
    """(_key, _acc): a row per key and task, or more where a task has more than ``held`` keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accs: dict[tuple, Any] = {}

        def drain() -> pd.DataFrame:
            out = pd.DataFrame({"_key": [dict(zip(keys, k, strict=True)) for k in accs], "_acc": [pickle.dumps((k, a)) for k, a in accs.items()]})
            accs.clear()
            return out

        for batch in batches:
            codes, found = pd.factorize(pd.Series([tuple(k[c] for c in keys) for k in batch["_key"]], dtype=object))
            rows = batch[columns]
            for i, at in rows.groupby(codes).indices.items():
                key = found[i]
                accs[key] = aggregate.add_rows(accs[key] if key in accs else aggregate.create(), rows.iloc[at])
            if len(accs) > held:
                yield drain()
        if accs:
            yield drain()

    key = F.struct(*[F.col(k) for k in keys])
    schema = df.select(key.alias("_key"), F.lit(b"").alias("_acc")).schema
    return df.select(key.alias("_key"), *columns).mapInPandas(run, schema)


def incremental(df: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, result: str, *, held: int = HELD) -> DataFrame:
    """A row per key: the keys and the aggregate's result, whose columns ``result`` declares.

    Keys may be null and may be window columns. Only ``columns`` reach the aggregate, under
    their names. An empty table gives no rows.
    """
    names = [c.split()[0] for c in result.split(", ")]
    parts = partial(df, keys, columns, aggregate, held).repartition("_key").sortWithinPartitions("_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(h: Held) -> tuple:
            return (dict(zip(keys, h.key, strict=True)), *aggregate.result(h.acc))

        now: Held | None = None
        for batch in batches:
            out = []
            for body in batch["_acc"]:
                held = Held(*pickle.loads(bytes(body)))
                if now is None or now.key != held.key:
                    out += [done(now)] if now else []
                    now = held
                else:
                    now = now.merged(held, aggregate)
            if out:
                yield pd.DataFrame(out, columns=["_key", *names])
        if now:
            yield pd.DataFrame([done(now)], columns=["_key", *names])

    merged = parts.mapInPandas(run, f"_key {parts.schema['_key'].dataType.simpleString()}, {result}")
    return merged.select("_key.*", *names)


class Merging(StatefulProcessor):
    """Keyed state of one accumulator: partial ones of each micro-batch are merged into it."""

    def __init__(self, keys: list[str], names: list[str], aggregate: Aggregate):
        self.keys, self.names, self.aggregate = keys, names, aggregate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("acc", "acc binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = Held(*pickle.loads(bytes(self.state.get()[0]))) if self.state.exists() else None
        for r in rows:
            held = Held(*pickle.loads(bytes(r["_acc"])))
            now = now.merged(held, self.aggregate) if now else held
        self.state.update((pickle.dumps((now.key, now.acc)),))
        yield Row(**dict(zip(self.keys, now.key, strict=True)), **dict(zip(self.names, self.aggregate.result(now.acc), strict=True)))

    def close(self) -> None:
        pass


def incremental_stream(df: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, result: str) -> DataFrame:
    """The same of a stream, in update mode: for each micro-batch a row for each key that it has."""
    names = [c.split()[0] for c in result.split(", ")]
    parts = partial(df, keys, columns, aggregate).select("_key.*", "_acc")
    schema = ", ".join([f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys] + [result])
    return parts.groupBy(*keys).transformWithState(Merging(keys, names, aggregate), schema, "update", "none")
