"""Streaming star-schema joins: facts with the versions, valid at their time, of several dimensions and roles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass
class Role:
    """A fact's column ``on`` refers to ``key`` of a dimension, whose rows are versions from ``ts`` on."""

    dimension: str
    on: str


@dataclass
class Dimension:
    """A stream of versions, of any schema."""

    df: DataFrame
    key: str
    ts: str


class Lookups(StatefulProcessor):
    """Keyed by (dimension, key): versions by time, and facts that wait until the watermark passes them.

    One pass serves all dimensions and roles: versions travel as JSON. A key has one timer,
    for its earliest waiting fact; when it is due, waiting facts and versions are put in
    order once, and versions before the one in force at the watermark are dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getMapState("versions", "us long", "body string")
        self.waiting = handle.getListState("waiting", "us long, role string, fact string")
        self.timer = handle.getValueState("timer", "ms long")

    def wake(self, us: int) -> None:
        """Sets the timer just after a fact's time, unless an earlier one is set. So none is set anew while it expires, which Spark would delete."""
        ms = us // 1000 + 1
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or ms < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        facts = []
        for r in rows:
            if r["role"] is None:
                held = self.versions.getValue((r["us"],))[0] if self.versions.containsKey((r["us"],)) else ""
                self.versions.updateValue((r["us"],), (max(held, r["body"]),))
            else:
                facts.append((r["us"], r["role"], r["body"]))
        if facts:
            self.waiting.appendList(facts)
            self.wake(min(f[0] for f in facts))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        versions = sorted((k[0], v[0]) for k, v in self.versions.iterator())
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        at, rest = -1, []
        for us, role, fact in waiting:
            if us > mark:
                rest.append((us, role, fact))
                continue
            while at + 1 < len(versions) and versions[at + 1][0] <= us:
                at += 1
            yield Row(fact=fact, role=role, version=versions[at][1] if at >= 0 else None)
        past = [us for us, _ in versions if us <= mark]
        for us in past[:-1]:
            self.versions.removeKey((us,))
        if rest:
            self.waiting.put(rest)
            self.wake(rest[0][0])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def resolved(facts: DataFrame, ts: str, dimensions: dict[str, Dimension], roles: dict[str, Role], *, delay_s: int = 0) -> DataFrame:
    """(fact, role, version): each fact once for each role, with the version in force, both as JSON; a stream in append mode.

    All of a fact's roles come in one micro-batch. Of versions of one time the greatest
    JSON counts. Facts and versions behind the watermark are dropped; a fact whose column
    is null has no version, and one without a time is dropped.
    """
    body = F.to_json(F.struct(*facts.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    wanted = F.array(*[F.struct(F.lit(r.dimension).alias("dimension"), F.col(r.on).cast("string").alias("key"), F.lit(name).alias("role")) for name, r in roles.items()])
    rows = facts.where(F.col(ts).isNotNull()).select(F.col(ts).alias("_ts"), body.alias("body"), F.inline(wanted))
    columns = ["dimension", "key", "_ts", "role", "body"]
    parts = [rows.select(*columns)]
    for name, d in dimensions.items():
        version = F.to_json(F.struct(*[c for c in d.df.columns if c != d.key]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        known = d.df.where(F.col(d.ts).isNotNull() & F.col(d.key).isNotNull())
        parts.append(known.select(F.lit(name).alias("dimension"), F.col(d.key).cast("string").alias("key"), F.col(d.ts).alias("_ts"), F.lit(None).cast("string").alias("role"), version.alias("body")).select(*columns))
    both = reduce(DataFrame.unionByName, parts).withWatermark("_ts", f"{delay_s} seconds").withColumn("us", F.unix_micros("_ts"))
    return both.groupBy("dimension", "key").transformWithState(Lookups(), "fact string, role string, version string", "append", "eventTime")


def assembled(rows: DataFrame, fact_schema: str, roles: dict[str, str]) -> DataFrame:
    """Facts with a struct of each role's version, from ``resolved`` rows of whole micro-batches; ``roles`` has the versions' schemas.

    ``fact_schema`` has the columns that are wanted, none named like a role. Facts that are
    equal in all columns come back once: facts need a key.
    """
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    picked = [F.max(F.when(F.col("role") == name, F.col("version"))).alias(name) for name in roles]
    wide = rows.groupBy("fact").agg(*picked)
    return wide.select(F.from_json("fact", fact_schema, options).alias("_f"), *[F.from_json(name, schema, options).alias(name) for name, schema in roles.items()]).select("_f.*", *roles)
