"""N-gram Jaccard join by count-vector R-trees.

Equal word sequences are one class. A class's shingles are hashed to groups. Two sets of
similarity t differ in at most (1 - t) times the larger's shingles, so with one group more
than that they agree wholly in one: a shard holds the classes that agree in a group, and
no link is lost. Shards of the same members are searched once. In a shard, counts of
shingles by GROUPS hash groups are points of an R-tree; the overlap of two sets is at
most the sum of the smaller of their counts, and that of a set with anything below a node
at most the sum with the node's largest counts. Pairs that survive are verified by their
whole shingle sets.

Two passes: in the first each member of a shard names its first surviving partner, which
joins the large families by a row a member; in the second, shards that still hold several
components give all surviving pairs between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, forget, join_dealt
from .components import components

SHINGLE = 3
#: Sets link whose intersection is at least so many hundredths of their union.
PERCENT = 90
#: Coordinates of a point in the tree; large sets also have finer ones, a power of two times as many.
GROUPS = 32
#: A finer point has a coordinate for about so many shingles, and FINEST coordinates at most.
PER_GROUP = 4
FINEST = 2048
#: Points a leaf, children a node.
FANOUT = 16
#: Points a task holds of one shard; larger shards go in tiles of two parts.
TILE = 4096
#: Size classes grow by this factor; a set is a guest of the next class if it may have a partner there.
GROWTH = 1.5
#: Members of a large tile that all others ask in the first pass.
HEADS = 256
#: Pairs compared at once.
STRIP = 65536
#: A count of so many stands for any greater one, which then bounds nothing.
MOST = 65535
UNBOUNDED = 1 << 40
#: Classes up to which their list is broadcast to fetch their texts.
FEW = 100_000
#: Word hashes a worker remembers.
REMEMBERED = 500_000
LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_hashes: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    return bytes(text).translate(LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if it is shorter."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    h = np.array([_hashes.get(w) or _hashes.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in words], np.uint64)
    if len(h) == 0:
        return h
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = mixed(out * _MIX[k] + h[k : k + n])
    return np.unique(out)


def class_bounds(percent: int, size: int) -> list[tuple[int, int]]:
    """(size class, number of groups) that a set of this size goes to: its own, and the next if that may hold a partner.

    Two linked sets of at most m shingles differ in at most 2m(1 - t) / (1 + t) of them.
    """
    groups = lambda most: 2 * (100 - percent) * most // (100 + percent) + 1
    low, at = 1, 0
    while True:
        high = max(low + 1, int(low * GROWTH))  # sizes low to high - 1
        if size < high:
            break
        low, at = high, at + 1
    out = [(at, groups(high - 1))]
    if 100 * size >= percent * high:
        out.append((at + 1, groups(max(high + 1, int(high * GROWTH)) - 1)))
    return out


def shard_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """A 64-bit key for each group of the set's size classes: hash of class, group and the group's shingles."""
    keys = []
    for at, groups in class_bounds(percent, len(hashes)):
        group = (mixed(hashes ^ np.uint64(at + 1)) % np.uint64(groups)).astype(np.int64)
        sums = np.zeros(groups, np.uint64)
        np.add.at(sums, group, mixed(hashes * _MIX[0] + np.uint64(1)))
        with np.errstate(over="ignore"):
            keys.append(mixed(mixed(sums + np.uint64(at)) + np.arange(groups, dtype=np.uint64) * _MIX[1]))
    return np.concatenate(keys)


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts by hash group, MOST at most, as fine as the set's size suggests; neighbours add up to coarser counts."""
    n = GROUPS
    while n < FINEST and n * PER_GROUP < len(hashes):
        n *= 2
    group = (mixed(hashes + _MIX[2]) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(group, minlength=n), MOST).astype(np.uint16)


def coarse(fine: np.ndarray, n: int) -> np.ndarray:
    """n coordinates of points with at least as many; what may be more than MOST has no bound."""
    counts = np.where(fine == MOST, UNBOUNDED, fine.astype(np.int64))
    return np.minimum(counts.reshape(*fine.shape[:-1], n, -1).sum(axis=-1), UNBOUNDED)


def enough(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap can make, or makes, a link of two sets whose sizes sum to ``sizes``: 100 * i >= percent * (sizes - i)."""
    return (100 + percent) * overlap >= percent * sizes


class CountTree:
    """R-tree over count vectors, packed in the order of size and then of the widest coordinates.

    A node has the coordinatewise maximum of its points and their least size.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        wide = np.argsort(-points.std(axis=0), kind="stable")[:2]
        self.order = np.lexsort((points[:, wide[1]], points[:, wide[0]] // 4, np.log2(sizes).round(1)))
        self.tiers = [(points[self.order], sizes[self.order])]
        while len(self.tiers) == 1 or len(self.tiers[-1][0]) > 1:
            high, least = self.tiers[-1]
            cut = np.arange(0, len(high), FANOUT)
            self.tiers.append((np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(least, cut)))

    def within(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``points``, row of the tree's input) of every pair that the summed minima let through."""
        ask, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for tier in range(len(self.tiers) - 1, -1, -1):
            high, least = self.tiers[tier]
            keep = np.zeros(len(ask), bool)
            for at in range(0, len(ask), STRIP):
                a, n = ask[at : at + STRIP], node[at : at + STRIP]
                keep[at : at + STRIP] = enough(np.minimum(points[a], high[n]).sum(axis=1), sizes[a] + least[n], percent)
            ask, node = ask[keep], node[keep]
            if tier:
                first = node * FANOUT
                n = np.minimum(first + FANOUT, len(self.tiers[tier - 1][0])) - first
                ask = np.repeat(ask, n)
                node = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        return ask, self.order[node]


class Members:
    """Rows of shards' tiles as arrays, in the order of tile and rep."""

    def __init__(self, rows: pd.DataFrame):
        self.tile = rows[["shard", "i", "j"]].to_numpy(np.int64)
        self.rep, self.part, self.root, self.size = (rows[c].to_numpy(np.int64) for c in ("rep", "part", "root", "size"))
        self.fine = [np.frombuffer(bytes(p), np.uint16) for p in rows["point"]]
        self.width = np.array([len(p) for p in self.fine], np.int64)
        self.points = np.zeros((len(rows), GROUPS), np.int64)
        for n in np.unique(self.width):
            at = np.flatnonzero(self.width == n)
            self.points[at] = coarse(np.stack([self.fine[i] for i in at]), GROUPS)

    def finer(self, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
        """Which row pairs the summed minima of their finest common points let through."""
        width = np.minimum(self.width[u], self.width[v])
        keep = width == GROUPS
        for n in np.unique(width[~keep]):
            mine = np.flatnonzero(width == n)
            for at in range(0, len(mine), STRIP * GROUPS // n):
                some = mine[at : at + STRIP * GROUPS // n]
                named, back = np.unique(np.r_[u[some], v[some]], return_inverse=True)
                points = np.stack([coarse(self.fine[i], n) for i in named])
                overlap = np.minimum(points[back[: len(some)]], points[back[len(some) :]]).sum(axis=1)
                keep[some] = enough(overlap, self.size[u[some]] + self.size[v[some]], percent)
        return keep

    def pairs(self, u: np.ndarray, v: np.ndarray, percent: int, first: bool) -> np.ndarray:
        """(greater, lesser) rep of row pairs, those of one component left out; for ``first``, each greater's least."""
        keep = (self.rep[u] != self.rep[v]) & (self.root[u] != self.root[v])
        u, v = u[keep], v[keep]
        keep = self.finer(u, v, percent)
        u, v = self.rep[u[keep]], self.rep[v[keep]]
        found = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
        return found[np.r_[True, found[1:, 0] != found[:-1, 0]]] if first and len(found) else found

    def one_leaf(self, starts: np.ndarray, sizes: np.ndarray, percent: int, first: bool) -> np.ndarray:
        """Survivors of many tiles that are a single leaf each: their points are compared directly."""
        out = []
        for n in np.unique(sizes):
            a, b = np.triu_indices(n, 1)
            u, v = (np.add.outer(starts[sizes == n], x).ravel() for x in (a, b))
            for at in range(0, len(u), STRIP):
                x, y = u[at : at + STRIP], v[at : at + STRIP]
                keep = enough(np.minimum(self.points[x], self.points[y]).sum(axis=1), self.size[x] + self.size[y], percent)
                out.append(self.pairs(x[keep], y[keep], percent, False))
        found = np.concatenate([*out, np.zeros((0, 2), np.int64)])
        if first and len(found):
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            found = found[np.r_[True, found[1:, 0] != found[:-1, 0]]]
        return found

    def tree(self, a: int, b: int, percent: int, first: bool) -> np.ndarray:
        """Survivors of one tile, rows a to b.

        First pass: every row asks a tree of the HEADS least reps. Second: a pair of two
        components has a row outside the tile's commonest one, so only those ask.
        """
        rows = np.arange(a, b)
        if first:
            asks = [(rows[:HEADS], rows)]
        else:
            roots, counts = np.unique(self.root[rows], return_counts=True)
            odd = self.root[rows] != roots[counts.argmax()]
            _, i, j = self.tile[a]
            of_i, of_j = self.part[rows] == i, self.part[rows] == j
            asks = [(rows[of_i], rows[odd & of_j])] + ([(rows[of_j], rows[odd & of_i])] if i != j else [])
        out = [np.zeros((0, 2), np.int64)]
        for held, asked in asks:
            if not len(held) or not len(asked):
                continue
            tree = CountTree(self.points[held], self.size[held])
            for at in range(0, len(asked), 1024):  # a block of questions walks the tree together
                some = asked[at : at + 1024]
                x, y = tree.within(self.points[some], self.size[some], percent)
                out.append(self.pairs(some[x], held[y], percent, first))
        return np.concatenate(out)


def _tiles(members: DataFrame, *, first: bool, percent: int, tile: int) -> DataFrame:
    """Candidate pairs (u, v) of all shards; members: shard, parts, rep, root, size, point.

    First pass: each part by itself and with the part of the shard's least member. Second:
    every two parts.
    """
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = members.withColumn("part", part)
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    if first:
        head = F.pmod(F.xxhash64("least"), F.col("parts")).cast("int")
        others = F.when(F.col("part") == head, others).otherwise(F.array_distinct(F.array("part", head)))
    dealt = dealt.select("*", F.explode(others).alias("other"))
    dealt = dealt.select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "root", "size", "point")
    dealt = dealt.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "rep")

    def searched(rows: pd.DataFrame) -> pd.DataFrame:
        m = Members(rows)
        starts = np.flatnonzero(np.r_[True, (m.tile[1:] != m.tile[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        leaf = (sizes <= FANOUT) & (m.tile[starts, 1] == m.tile[starts, 2])
        found = [m.one_leaf(starts[leaf], sizes[leaf], percent, first)]
        found += [m.tree(at, at + n, percent, first) for at, n in zip(starts[~leaf], sizes[~leaf], strict=True)]
        return pd.DataFrame(np.concatenate(found), columns=["u", "v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            key = batch[["shard", "i", "j"]].to_numpy(np.int64)
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if held and (held[0][["shard", "i", "j"]].iloc[0].to_numpy(np.int64) != key[0]).any():
                new = np.r_[0, new]
            if not len(new):
                held.append(batch)
                continue
            yield searched(pd.concat([*held, batch.iloc[: new[-1]]], ignore_index=True))
            held = [batch.iloc[new[-1] :]]
        if held:
            yield searched(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(run, "u long, v long").distinct()


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (smallest id reachable by links, its own included).

    Null and empty texts and those without words have no shingles and link with nothing, not
    even one another: each is its own component. Repeated rows each come back, in one
    component. Null ids come back and name a component only if it has no other id. Very
    long texts are read whole. Other columns are ignored; an empty table gives no rows.
    Shingles are told apart by 64-bit hashes, word sequences by MD5.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100, so that partners are of one size class or of two neighbouring ones")
    measured = "_class binary, size int, point binary, keys array<long>"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["_body"]:
                words = words_of(text)
                h = shingles(words)
                keys = shard_keys(h, percent).view(np.int64) if len(h) else []
                rows.append((hashlib.md5(b" ".join(words)).digest(), len(h), point(h).tobytes(), keys))
            yield pd.concat([batch[["_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["_class", "size", "point", "keys"])], axis=1)

    id_type = docs.schema[id_col].dataType.simpleString()
    bodies = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_body"))
    prints = cut_lineage(bodies.mapInPandas(measure, f"_id {id_type}, {measured}"))
    classes = prints.where("size > 0").groupBy("_class").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.first("size").alias("size"), F.first("point").alias("point"), F.first("keys").alias("keys"))
    classes = cut_lineage(classes.withColumn("rep", F.monotonically_increasing_id()))

    keyed = classes.select("rep", F.explode("keys").alias("key"))
    shared = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"))
    at_key = cut_lineage(join_dealt(keyed, shared.select("key"), "key", counts=shared))
    marks = [F.min("rep").alias("least"), F.max("rep").alias("most"), F.bit_xor(F.xxhash64("rep")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x")]
    shards = at_key.groupBy("key").agg(F.count("*").alias("n"), *marks).groupBy("n", "least", "most", "s", "x").agg(F.min("key").alias("key"))
    shards = cut_lineage(shards.select(F.col("key").alias("shard"), "n", "least", F.ceil(F.col("n") / tile).cast("int").alias("parts")))
    at_shard = join_dealt(at_key.withColumnRenamed("key", "shard"), shards, "shard", counts=shards.select("shard", F.col("n").alias("_n")))
    points = classes.select("rep", "size", "point")
    members = cut_lineage(at_shard.join(points, "rep"))
    forget(shared, at_key)

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among written candidate pairs, by the whole texts of both."""
        asked = pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
        wanted = cut_lineage(asked.join(classes.select("rep", "_class", "_first"), "rep"))
        few = F.broadcast(wanted) if wanted.count() <= FEW else wanted
        texts = bodies.join(few, F.col("_id").eqNullSafe(F.col("_first"))).select("rep", "_class", "_body")

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for rep, of, text in zip(batch["rep"], batch["_class"], batch["_body"], strict=True):
                    words = words_of(text)
                    if hashlib.md5(b" ".join(words)).digest() == bytes(of):  # one id may have several texts
                        rows.append((rep, shingles(words).tobytes()))
                yield pd.DataFrame(rows, columns=["rep", "hashes"])

        whole = cut_lineage(texts.mapInPandas(sets, "rep long, hashes binary").dropDuplicates(["rep"]))

        @F.pandas_udf("boolean")
        def linked(a: pd.Series, b: pd.Series) -> pd.Series:
            out = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y))
                out.append(bool(enough(same, len(x) + len(y), percent)))
            return pd.Series(out, dtype=bool)

        one = join_dealt(pairs, whole.select(F.col("rep").alias("u"), F.col("hashes").alias("_u")), "u")
        two = join_dealt(one, whole.select(F.col("rep").alias("v"), F.col("hashes").alias("_v")), "v", counts=pairs.groupBy("v").agg(F.count("*").alias("_n")))
        links = cut_lineage(two.where(linked("_u", "_v")).select("u", "v"))
        forget(whole, wanted)
        return links

    tried = cut_lineage(_tiles(members.withColumn("root", F.col("rep")), first=True, percent=percent, tile=tile))
    some = verified(tried)
    joined = components(some)
    rooted = cut_lineage(members.join(joined, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node"))
    forget(members)
    open_ = rooted.groupBy("shard").agg((F.min("root") < F.max("root")).alias("_open"), F.count("*").alias("_n")).where("_open")
    rest = join_dealt(rooted, open_.select("shard", "_open"), "shard", counts=open_.select("shard", "_n"))
    left = cut_lineage(_tiles(rest, first=False, percent=percent, tile=tile).join(tried, ["u", "v"], "left_anti"))
    more = verified(left)
    all_ = components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    forget(rooted)

    named = cut_lineage(classes.select("_class", "rep", "_first", "_n").join(all_, F.col("rep") == F.col("node"), "left").select("_class", "_first", "_n", F.coalesce("root", "rep").alias("_root")))
    least = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = join_dealt(named, least, "_root")
    rows = prints.select("_id", "_class", F.col("size").cast("long").alias("n_shingles"))
    linked_rows = join_dealt(rows.where("n_shingles > 0"), named.select("_class", "component_id"), "_class", counts=named.select("_class", "_n"))
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("_id"))
    out = linked_rows.select("_id", "n_shingles", "component_id").unionByName(alone.select("_id", "n_shingles", "component_id"))
    return out.withColumnRenamed("_id", id_col)


#: DuckDB SQL for the query.
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), c AS (
  SELECT w, row_number() OVER () AS k, min(doc_id) AS least FROM d WHERE len(w) > 0 GROUP BY w
), g AS (
  SELECT DISTINCT k, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM c)
), n AS (
  SELECT k, count(*) AS n FROM g GROUP BY k
), p AS (
  SELECT a.k AS a, b.k AS b, count(*) AS same FROM g a JOIN g b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.k = p.a JOIN n y ON y.k = p.b WHERE 100 * same >= {PERCENT} * (x.n + y.n - same)
), s AS (
  SELECT k AS a, k AS b FROM c UNION SELECT s.a, l.b FROM s JOIN l ON l.a = s.b
), o AS (
  SELECT s.a AS k, min(c.least) AS component_id FROM s JOIN c ON c.k = s.b GROUP BY s.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(o.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN c ON c.w = d.w LEFT JOIN n ON n.k = c.k LEFT JOIN o ON o.k = c.k
"""
