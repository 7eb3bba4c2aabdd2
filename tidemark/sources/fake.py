"""Seeded fake rows from expressions: the data source "fake", batch and streaming.

    spark.dataSource.register(FakeDataSource)
    spark.read.format("fake").schema("id string, price double") \\
        .option("fields.id", "#{Internet.uuid}").option("fields.price", "#{Number.randomDouble '2','1','9'}") \\
        .option("number-of-rows", 100).load()

Row i of a seed is the same in every run. Options: rows-per-second (streaming),
number-of-rows, seed, partitions, base-time (ISO; what date expressions count from),
fields.NAME, fields.NAME.null-rate, fields.NAME.length (for arrays).
"""

from __future__ import annotations

import random
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import ArrayType, DataType, StructType

#: Short word lists of our own for themed expressions; other themes draw from "word".
WORDS = {
    "firstname": ["Ada", "Bruno", "Chen", "Dalia", "Emeka", "Freya"],
    "lastname": ["Archer", "Bosch", "Castro", "Duval", "Eriksen"],
    "city": ["Arden", "Brook", "Calder", "Dunmore", "Elgin"],
    "state": ["North", "South", "East", "West"],
    "country": ["Avaria", "Boria", "Cadland"],
    "streetaddress": ["1 High Street", "22 Mill Lane", "303 Lake Road"],
    "useragent": ["Mozilla/5.0 (X11; Linux x86_64)", "curl/8.5.0", "Lynx/2.8.9"],
    "word": ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove"],
}
_EXPR = re.compile(r"#\{\s*([\w.]+)((?:\s*'[^']*'\s*,?)*)\s*\}")


def regexify(pattern: str, rng: random.Random) -> str:
    """Text of a pattern made of literals, [classes], (a|b|c) and {n} or {n,m}."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "(":
            depth, j = 1, i + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[j], 0)
                j += 1
            inner, parts, level, last = pattern[i + 1 : j - 1], [], 0, 0
            for k, c in enumerate(inner + "|"):
                level += {"(": 1, ")": -1}.get(c, 0)
                if c == "|" and level == 0:
                    parts.append(inner[last:k])
                    last = k + 1
            make = lambda parts=parts: regexify(rng.choice(parts), rng)
        elif pattern[i] == "[":
            j = pattern.index("]", i) + 1
            letters = "".join(re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), pattern[i + 1 : j - 1]))
            make = lambda letters=letters: rng.choice(letters)
        else:
            j = i + 2 if pattern[i] == "\\" else i + 1
            text = pattern[j - 1]
            make = lambda text=text: rng.choice("0123456789") if text == "d" and pattern[j - 2 : j] == "\\d" else text  # noqa: E731, B023
        times = re.match(r"\{(\d+)(?:,(\d+))?\}", pattern[j:])
        n = rng.randint(int(times[1]), int(times[2] or times[1])) if times else 1
        out += [make() for _ in range(n)]
        i = j + (times.end() if times else 0)
    return "".join(out)


def value(name: str, args: list[str], rng: random.Random, base: datetime) -> str:
    """One expression's value, as text."""
    kind = name.lower()
    if kind == "number.numberbetween":
        low, high = int(args[0]), int(args[1])
        return str(rng.randrange(low, high) if high > low else low)
    if kind == "number.randomdouble":
        return f"{rng.uniform(float(args[1]), float(args[2])):.{int(args[0])}f}"
    if kind in ("date.past", "date.future"):
        unit = timedelta(**{args[-1].lower().rstrip("s") + "s": 1})
        low = float(args[1]) if len(args) > 2 else 0.0
        gap = unit * rng.uniform(low, float(args[0]))
        return (base - gap if kind == "date.past" else base + gap).isoformat(sep=" ", timespec="milliseconds")
    if kind == "regexify":
        return regexify(args[0], rng)
    if kind == "numerify":
        return re.sub("#", lambda _: str(rng.randrange(10)), args[0])
    if kind == "options.option":
        return rng.choice(args)
    if kind == "internet.uuid":
        return str(uuid.UUID(int=rng.getrandbits(128), version=4))
    if kind == "internet.publicipv4address":
        return ".".join(str(rng.randint(11, 126) if i == 0 else rng.randint(1, 254)) for i in range(4))
    if kind in ("bool.bool", "boolean"):
        return str(rng.random() < 0.5).lower()
    if kind in ("json", "jsona"):
        import json

        fields = dict(zip(args[::2], args[1::2], strict=False))
        made = {k: fill(v, rng, base) for k, v in fields.items()}
        return json.dumps([made] if kind == "jsona" else made)
    return rng.choice(WORDS.get(kind.rpartition(".")[2].replace("_", ""), WORDS["word"]))


def fill(template: str, rng: random.Random, base: datetime) -> str:
    """A text with its expressions replaced."""
    return _EXPR.sub(lambda m: value(m[1], re.findall(r"'([^']*)'", m[2]), rng, base), template)


def typed(text: str, kind: DataType, base: datetime):
    name = kind.simpleString()
    if name in ("int", "bigint", "smallint", "tinyint"):
        return int(float(text))
    if name in ("float", "double"):
        return float(text)
    if name.startswith("decimal"):
        from decimal import Decimal

        return Decimal(text)
    if name == "boolean":
        return text == "true"
    if name == "date":
        return datetime.fromisoformat(text).date()
    if name.startswith("timestamp"):
        at = datetime.fromisoformat(text)
        return at.replace(tzinfo=None) if name.endswith("ntz") else at.replace(tzinfo=timezone.utc)
    return text


class _Rows:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        self.seed = int(self.options.get("seed", 0))
        self.base = datetime.fromisoformat(self.options.get("base-time", "2024-01-01T00:00:00"))

    def row(self, i: int) -> tuple:
        rng = random.Random(f"{self.seed}:{i}")
        out = []
        for f in self.schema.fields:
            name = f"fields.{f.name.lower()}"
            template = self.options.get(f"{name}.expression", self.options.get(name, "#{word}"))
            if rng.random() < float(self.options.get(f"{name}.null-rate", 0)):
                out.append(None)
            elif isinstance(f.dataType, ArrayType):
                out.append([typed(fill(template, rng, self.base), f.dataType.elementType, self.base) for _ in range(int(self.options.get(f"{name}.length", 1)))])
            else:
                out.append(typed(fill(template, rng, self.base), f.dataType, self.base))
        return tuple(out)


class _Reader(DataSourceReader):
    def __init__(self, rows: _Rows):
        self.rows = rows
        self.n = int(rows.options.get("number-of-rows", 100))
        self.parts = int(rows.options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        cut = [self.n * k // self.parts for k in range(self.parts + 1)]
        return [InputPartition((a, b)) for a, b in zip(cut, cut[1:])]  # noqa: B905

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b = partition.value
        return (self.rows.row(i) for i in range(a, b))


class _Stream(SimpleDataSourceStreamReader):
    """rows-per-second rows in each micro-batch, until number-of-rows."""

    def __init__(self, rows: _Rows):
        self.rows = rows
        self.step = int(rows.options.get("rows-per-second", 100))
        self.most = int(rows.options.get("number-of-rows", 2**62))

    def initialOffset(self) -> dict:
        return {"row": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        a, b = start["row"], min(start["row"] + self.step, self.most)
        return iter([self.rows.row(i) for i in range(a, b)]), {"row": b}  # a list: Spark ships it

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.rows.row(i) for i in range(start["row"], end["row"])])


class FakeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fake"

    def schema(self) -> str:
        raise ValueError("the fake source needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Rows(schema, dict(self.options)))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(_Rows(schema, dict(self.options)))
