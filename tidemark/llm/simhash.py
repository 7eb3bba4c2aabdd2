"""SimHash near-duplicates by BK-trees (operator 4).

Equal fingerprints are one node. Two fingerprints within the radius agree on ``agree`` of
radius + ``agree`` blocks of bits, so nodes are dealt into shards, one table for each
choice of blocks, keyed by the bits that must agree; every link lies in some shard. In a
shard a BK-tree, whose children are keyed by the integer Hamming distance to their parent,
is searched for each node along the edges within the radius only.

Shard trees travel to the tasks that search them by a shuffle, not from the driver: all
trees together are the corpus's fingerprints, which have no bound. A shard of more than
TILE nodes is cut into parts and searched tile by tile (a tree over one part, searched with
another), so no task holds more than 2 * TILE nodes. A tile returns a spanning forest of
the links it finds, at most one row a node, which keeps every component and no clique.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, forget, join_dealt
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Nodes in one part of a large shard.
TILE = 4096
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(SHINGLE)))] if len(words) >= SHINGLE else [b" ".join(words)]  # noqa: B905
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), COUNT_ROWS):
        part = shingles[at : at + COUNT_ROWS]
        h = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _mark, _fp) per row: a hash of the text, and the fingerprint as a signed long; null and empty texts have fingerprint zero."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(bytes(t)) if t is not None else 0 for t in texts], np.uint64).view(np.int64))

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_mark"), run(text.cast("binary")).alias("_fp"))


def masks(radius: int, agree: int) -> list[int]:
    """Every choice of ``agree`` of radius + ``agree`` blocks, as bit masks."""
    n = radius + agree
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
    return [sum(c) for c in combinations(blocks, agree)]


class BKTree:
    """Nodes in parallel lists; children of each keyed by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                nxt = self.children[at].setdefault(d, new)
                if nxt == new:
                    return
                at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the nodes at that distance or less."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if kids := children[at]:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
        return found


def forest(tree_part: list[int], probes: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links between the values of one part (probes None) or of two, as (value, root) of a spanning forest."""
    values = tree_part + (probes or [])
    up = list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    tree = BKTree()
    if probes is None:
        for i, v in enumerate(values):
            for j in tree.within(v, radius):
                up[root(i)] = root(j)
            tree.add(v)
    else:
        for v in tree_part:
            tree.add(v)
        for i, v in enumerate(probes, len(tree_part)):
            for j in tree.within(v, radius):
                up[root(i)] = root(j)
    return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]


def links(nodes: DataFrame, *, radius: int = RADIUS, agree: int = 1, tile: int = TILE) -> DataFrame:
    """Forests (u, v) over distinct fingerprints (_fp) that hold every link within the radius."""
    unsigned = (1 << 64) - 1
    choices = [F.struct(F.lit(k).alias("t"), F.col("_fp").bitwiseAND(F.lit(int(np.uint64(m & unsigned).view(np.int64)))).alias("key")) for k, m in enumerate(masks(radius, agree))]
    keyed = nodes.select("_fp", F.inline(F.array(*choices))).select("_fp", F.struct("t", "key").alias("_shard"))
    counts = cut_lineage(keyed.groupBy("_shard").agg(F.count("*").alias("_n")).where("_n > 1"))  # a fingerprint alone in its shard has no link there
    sizes = counts.select("_shard", F.ceil(F.col("_n") / tile).cast("int").alias("_tiles"))
    parts = F.col("_tiles")
    dealt = (
        join_dealt(keyed, sizes, "_shard", counts=counts)
        .select("_fp", "_shard.t", "_shard.key", F.pmod(F.xxhash64("_fp"), parts).cast("int").alias("part"), parts.alias("n"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        .select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "_fp")
        .repartition("t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j", "part", "_fp")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(tile_key: tuple[int, ...], rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            i, j = tile_key[2:]
            first = [fp for part, fp in rows if part == i]
            return forest(first, None if i == j else [fp for part, fp in rows if part != i], radius)

        now, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch[c].tolist() for c in ("t", "key", "i", "j", "part")]
            for *key, part, fp in zip(*columns, batch["_fp"].to_numpy().view(np.uint64).tolist(), strict=True):
                if tuple(key) != now:
                    out += found(now, held) if now else []
                    now, held = tuple(key), []
                held.append((part, fp))
            if out:
                yield pd.DataFrame(np.array(out, np.uint64).view(np.int64), columns=["u", "v"])
        if now and (out := found(now, held)):
            yield pd.DataFrame(np.array(out, np.uint64).view(np.int64), columns=["u", "v"])

    return dealt.mapInPandas(run, "u long, v long")


def _classified(docs: DataFrame, id_col: str, text_col: str, agree: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of the rows, and per fingerprint (_class) its component: _root and component_id."""
    prints = cut_lineage(fingerprints(docs, id_col=id_col, text_col=text_col))
    nodes = cut_lineage(prints.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")))
    joined = components(links(nodes.select("_fp"), agree=agree, tile=tile))
    classes = cut_lineage(nodes.join(joined, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", "_n", F.coalesce("root", "_fp").alias("_root")))
    forget(nodes)
    least = classes.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_n"))
    return prints, join_dealt(classes, least.drop("_n"), "_root", counts=least.select("_root", "_n")).select("_fp", "_root", "_n", "component_id")


def _by_class(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with their fingerprint's class; one fingerprint may have most rows (empty texts, copies of a page)."""
    return join_dealt(prints, classes.drop("_n"), "_fp", counts=classes.select("_fp", "_n"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", agree: int = 1, tile: int = TILE) -> DataFrame:
    """Per row: id_col, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each
    come back. Null ids come back and never name a component unless it has no other id.
    Other columns are ignored; an empty table gives no rows. ``agree`` sets how many bits
    shards share: 1 suits up to about 10^8 distinct fingerprints, 2 to 10^11.
    """
    named = _by_class(*_classified(docs, id_col, text_col, agree, tile))
    return named.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", agree: int = 1, tile: int = TILE) -> DataFrame:
    """One row of each component, that of the smallest id (nulls last), columns as they were."""
    named = _by_class(*_classified(docs, id_col, text_col, agree, tile))
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_mark")
    first = named.groupBy("_root").agg(F.min(order).alias("_first")).select(F.col("_first._id").alias("_keep"), F.col("_first._mark").alias("_text"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_mark"))
    kept = rows.join(first, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_mark") == F.col("_text"))).dropDuplicates(["_id", "_mark"])
    return kept.select("_row.*")
