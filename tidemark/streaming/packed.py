"""A keyed stream's rows as arrays: what a stateful processor in Python takes and gives costs by the key, not by the row and cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, TimestampType

#: Rows of a task that are put in order of their keys together; a key with more has several arrays.
AT_ONCE = 200_000
_EPOCH, _MICRO = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)


def _packed(schema: StructType, keys: list[str]) -> StructType:
    """The schema of rows packed by key: arrays of the other columns, times as microseconds."""
    kind = lambda f: LongType() if isinstance(f.dataType, TimestampType) else f.dataType
    return StructType([f if f.name in keys else StructField(f.name, ArrayType(kind(f))) for f in schema])


def _packer(keys: list[str], at_once: int = AT_ONCE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        codes = [pa.chunked_array(t[k].chunks, t[k].type).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        order = np.lexsort(codes[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)
        starts = np.flatnonzero(new)
        offsets, taken = pa.array(np.append(starts, len(order)), pa.int32()), t.take(pa.array(order)).combine_chunks()
        columns = []
        for name in t.column_names:
            values = pa.chunked_array(taken[name].chunks, taken[name].type).combine_chunks()
            if name in keys:
                columns.append(values.take(pa.array(starts)))
                continue
            if pa.types.is_timestamp(values.type) and values.type.tz is not None:
                values = values.cast(pa.int64())
            columns.append(pa.ListArray.from_arrays(offsets, values))
        yield from pa.table(columns, t.column_names).to_batches(max_chunksize=1000)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= at_once:
                yield from one(held)
                held, n = [], 0
        if held:
            yield from one(held)

    return pack


def pack(df: DataFrame, keys: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """A stream's rows as arrays by key, times as microseconds: a row for each key of a micro-batch, or one for every ``at_once`` rows of a task that hold it."""
    return df.repartition(*keys).mapInArrow(_packer(keys, at_once), _packed(df.schema, keys))


class Packed(StatefulProcessor):
    """Gives a processor its key's rows one by one, and packs what it returns."""

    def __init__(self, inner: StatefulProcessor, given: StructType, keys: list[str], returned: StructType):
        times = lambda s: [isinstance(f.dataType, TimestampType) for f in s]
        self.inner, self.keys = inner, keys
        self.names, self.times = given.names, times(given)
        self.out, self.out_times = returned.names, times(returned)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def _rows(self, packed: Iterator[Row]) -> Iterator[Row]:
        row = Row(*self.names)
        for p in packed:
            n = len(next(v for name, v in zip(self.names, p, strict=True) if name not in self.keys))
            columns = []
            for name, values, time in zip(self.names, p, self.times, strict=True):
                if name in self.keys:
                    values = [values] * n
                elif time:
                    values = [None if v is None else _EPOCH + timedelta(microseconds=v) for v in values]
                columns.append(values)
            for values in zip(*columns, strict=True):
                yield row(*values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = list(self.inner.handleInputRows(key, self._rows(rows), timerValues))
        for at in range(0, len(found), AT_ONCE):
            yield Row(**{name: [self._plain(r[name], time) for r in found[at : at + AT_ONCE]] for name, time in zip(self.out, self.out_times, strict=True)})

    @staticmethod
    def _plain(value: Any, time: bool) -> Any:
        return (value - _EPOCH) // _MICRO if time and value is not None else value

    def close(self) -> None:
        self.inner.close()


def apply_packed(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str | StructType, mode: str, together: bool = True) -> DataFrame:
    """A keyed stream without timers through a processor of rows, packed on both sides.

    Unless ``together``, each task packs what it has of a key, as is better for few keys.
    """
    returned = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = (df.repartition(*keys) if together else df).mapInArrow(_packer(keys), _packed(df.schema, keys))
    out = rows.groupBy(*keys).transformWithState(Packed(processor, df.schema, keys, returned), _packed(returned, []), mode, "none")
    flat = out.select(F.inline(F.arrays_zip(*returned.names)))
    return flat.select(*[F.timestamp_micros(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else f.name for f in returned])
