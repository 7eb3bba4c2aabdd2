"""Approximate nearest neighbours by low-dimensional stable projections (operator 6).

Vectors are projected to M Gaussian coordinates. Over a vector at distance d, its projected
squared distance is d^2 times a chi-square variable of M degrees of freedom. So neighbours
taken in the order of projected distance, incrementally from a kd-tree, are verified by
their true distance until the chi-square test holds: once the next projected squared
distance exceeds the quantile P_STOP times the k-th true squared distance, any vector
nearer than that k-th one would have been met with probability P_STOP.

The largest inner product becomes the least distance by one more coordinate: with R the
largest norm, a vector x gets sqrt(R^2 - |x|^2), a query is scaled to norm R and gets 0.

The kd-tree's upper levels are fitted on a bounded sample and deal all vectors into cells;
each cell has a tree of its own. A query is searched in its home cell first; the distance
found there bounds which other cells it must visit. Cells and the queries that visit them
are cut into parts of about CELL_ROWS and QUERY_ROWS, so tasks are bounded. Queries walk a
tree in blocks of neighbours, best leaves first; each query leaves out the leaves that its
own test excludes.

Vectors without structure, whose k-th neighbour is hardly nearer than any other row, can't
be pruned by this or another test at such a recall; the work then grows with queries times
rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

M, P_STOP, LEAF, SEED = 16, 0.95, 256, 23
#: Queries that walk a tree together.
BLOCK = 128
#: Rounding that a matrix product may show against a sum in fixed order, as a share of the norms.
SLACK = 1e-12
#: Rows, about, of the sample that the cells are fitted on, by the hash of their id; rows a part of a cell aims at; queries in a part; cells at most.
SAMPLE_ROWS, CELL_ROWS, QUERY_ROWS, MOST_CELLS = 20_000, 25_000, 4_000, 4_096


def chi_square(x: float) -> float:
    """Distribution function for M degrees of freedom; M is even."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(M // 2))


def quantile(p: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < p else (low, mid)
    return high


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim + 1, M))


class Cells:
    """The kd-tree's upper levels: each split halves the sample at its widest coordinate."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # coordinate, value, left, right; children below 0 are cells ~i
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.root = self._build(sample, cells, np.full(M, -np.inf), np.full(M, np.inf))

    def _build(self, rows: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.ptp(rows, axis=0).argmax()) if len(rows) else 0
        if cells < 2 or len(rows) < 2 or np.ptp(rows[:, axis]) == 0:
            self.boxes.append((low, high))
            return ~(len(self.boxes) - 1)
        at = float(np.median(rows[:, axis]))
        left = rows[:, axis] < at
        if not left.any():
            at = float(np.nextafter(at, np.inf))
            left = rows[:, axis] < at
        me = len(self.splits)
        self.splits.append((axis, at, 0, 0))
        cut_high, cut_low = high.copy(), low.copy()
        cut_high[axis] = cut_low[axis] = at
        a = self._build(rows[left], cells // 2, low, cut_high)
        b = self._build(rows[~left], cells - cells // 2, cut_low, high)
        self.splits[me] = (axis, at, a, b)
        return me

    def home(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)

        def down(node: int, which: np.ndarray) -> None:
            if node < 0:
                out[which] = ~node
                return
            axis, at, a, b = self.splits[node]
            left = rows[which, axis] < at
            down(a, which[left])
            down(b, which[~left])

        down(self.root, np.arange(len(rows)))
        return out

    def distances(self, row: np.ndarray) -> np.ndarray:
        """Squared distance from a projected query to every cell."""
        low, high = np.array([b[0] for b in self.boxes]), np.array([b[1] for b in self.boxes])
        return (np.maximum(np.maximum(low - row, row - high), 0) ** 2).sum(axis=1)


class Tree:
    """A kd-tree over projected rows: leaves in order, with their boxes."""

    def __init__(self, rows: np.ndarray, most: int = LEAF):
        self.order = np.arange(len(rows))
        self.ends: list[int] = [0]
        todo = [(0, len(rows))]
        while todo:
            a, b = todo.pop()
            part = rows[self.order[a:b]]
            axis = int(np.ptp(part, axis=0).argmax())
            if b - a <= most or np.ptp(part[:, axis]) == 0:
                self.ends.append(b)
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a + mid, b), (a, a + mid)]
        starts = np.array(self.ends[:-1])
        sorted_rows = rows[self.order]
        self.low, self.high = np.minimum.reduceat(sorted_rows, starts), np.maximum.reduceat(sorted_rows, starts)

    def distances(self, row: np.ndarray) -> np.ndarray:
        return (np.maximum(np.maximum(self.low - row, row - self.high), 0) ** 2).sum(axis=1)


def search(ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, qids: np.ndarray, queries: np.ndarray, projected: np.ndarray, bound: np.ndarray, scale: np.ndarray, base: float, radius: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified neighbours (place of the query, id, score) in one part of a cell.

    near: projected rows. Of each query bound is the k-th squared distance known elsewhere,
    and base - scale * score the squared distance that a score comes to. Scores are summed
    in the order of the components, whatever the block.
    """
    tree = Tree(near)
    vectors, ids = vectors[tree.order], ids[tree.order]
    ends = np.array(tree.ends)
    close = SLACK * np.linalg.norm(vectors, axis=1).max() * np.linalg.norm(queries, axis=1)
    blocks = Tree(projected, BLOCK)
    out = []
    for a, b in zip(blocks.ends, blocks.ends[1:]):  # noqa: B905
        mine = blocks.order[a:b]
        q, limit, kth = queries[mine], radius * bound[mine], (base - bound[mine]) / scale[mine]
        leaf = np.stack([tree.distances(y) for y in projected[mine]])
        who, found, score = np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0)
        for at in np.argsort(leaf.mean(axis=0), kind="stable"):
            asks = np.flatnonzero(leaf[:, at] <= limit)
            if not len(asks):
                continue
            rows = slice(ends[at], ends[at + 1])
            here, there = np.nonzero(q[asks] @ vectors[rows].T >= (kth[asks] - close[mine[asks]])[:, None])
            here, there = asks[here], there + ends[at]
            other = ids[there] != qids[mine[here]]
            here, there = here[other], there[other]
            if not len(here):
                continue
            who, found, score = np.r_[who, here], np.r_[found, ids[there]], np.r_[score, np.add.reduce(q[here] * vectors[there], axis=1)]
            order = np.lexsort((found, -score, who))
            who, found, score = who[order], found[order], score[order]
            first = np.searchsorted(who, who)
            keep = np.arange(len(who)) - first < k
            who, found, score = who[keep], found[keep], score[keep]
            full = np.flatnonzero(np.bincount(who, minlength=b - a) == k)
            last = np.searchsorted(who, full, side="right") - 1
            kth[full] = score[last]
            limit[full] = np.minimum(limit[full], radius * (np.maximum(0, base - scale[mine[full]] * kth[full]) * (1 + 1e-9) + 1e-12))
        out.append((mine[who], found, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of largest inner product.

    Rows whose vector isn't usable, whose id is null, or whose number of components isn't
    the commonest one (the least, at a tie) take no part. A query finds neither itself nor
    rows of its own id. Of repeated candidates each counts; a repeated query asks once, and
    one id's different query vectors each have their ranks. Ties go to the smaller id.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    norm2 = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)
    shape = rows.groupBy(F.size("_v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm2).alias("top")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], schema)
    dim, top = shape["dim"], math.sqrt(shape["top"])
    rows = rows.where(F.size("_v") == dim)
    radius, matrix = quantile(P_STOP), projection(dim)

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(top**2 - (v**2).sum(axis=1, keepdims=True), 0))], axis=1) @ matrix

    def asked(v: np.ndarray) -> np.ndarray:
        return (v * (top / np.linalg.norm(v, axis=1, keepdims=True))) @ matrix[:-1]

    share = min(1.0, SAMPLE_ROWS / shape["n"])
    sampled = rows.where(F.xxhash64("_id") <= min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)).groupBy("_id").agg(F.min("_v").alias("_v"))  # repeated ids count once
    sample = sampled.toPandas().sort_values("_id")["_v"]
    cells = Cells(lifted(np.stack(sample.to_numpy())), min(MOST_CELLS, -(-shape["n"] // CELL_ROWS)))
    # the cells, MOST_CELLS boxes at most, are sent with the functions

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(cells.home(lifted(np.stack(v.to_numpy()))) if len(v) else [], dtype="int32")

    data = cut_lineage(rows.withColumn("_cell", home("_v")))
    sizes = cut_lineage(data.groupBy("_cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_parts")))  # a row for each cell

    def visits(queries: DataFrame) -> DataFrame:
        """Searches each query (_id, _q, _v, _bound, _cell) in its cell."""
        asked_n = queries.groupBy("_cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("_asks"))
        tiles = sizes.join(asked_n, "_cell")
        left = data.join(F.broadcast(tiles), "_cell").select("_cell", F.pmod(F.xxhash64("_id", "_v"), "_parts").cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.col("_asks") - 1)).alias("_ask"), "_id", F.lit(0).cast("long").alias("_q"), "_v", F.lit(None).cast("double").alias("_bound"))
        right = queries.join(F.broadcast(tiles), "_cell").select("_cell", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.pmod(F.xxhash64("_q"), "_asks").cast("int").alias("_ask"), "_id", "_q", "_v", "_bound")

        def run(group: pd.DataFrame) -> pd.DataFrame:
            asks = group["_bound"].notna()
            rows, queries = group[~asks], group[asks]
            if rows.empty or queries.empty:
                return pd.DataFrame(columns=["query_id", "_q", "vec_id", "score"]).astype({"query_id": "int64", "_q": "int64", "vec_id": "int64", "score": "float64"})
            x, q = np.stack(rows["_v"].to_numpy()), np.stack(queries["_v"].to_numpy())
            qids, keys = queries["_id"].to_numpy(np.int64), queries["_q"].to_numpy(np.int64)
            who, found, score = search(rows["_id"].to_numpy(np.int64), x, lifted(x), qids, q, asked(q), queries["_bound"].to_numpy(float), 2 * top / np.linalg.norm(q, axis=1), 2 * top**2, radius, k)
            return pd.DataFrame({"query_id": qids[who], "_q": keys[who], "vec_id": found, "score": score})

        return left.unionByName(right).groupBy("_cell", "_part", "_ask").applyInPandas(run, "query_id long, _q long, vec_id long, score double")

    # equal rows ask once; rows of one id with different vectors ask each for themselves
    queries = data.where(is_query(F.col("_id"))).withColumn("_q", F.xxhash64("_id", "_v")).dropDuplicates(["_id", "_q"])
    first = cut_lineage(visits(queries.withColumn("_bound", F.lit(float("inf")))))
    by_query = Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("_r", F.row_number().over(by_query)).where(F.col("_r") == k).select(F.col("_q").alias("_of"), F.col("score").alias("_s"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    bound = F.coalesce(F.greatest(F.lit(0.0), 2 * top**2 - 2 * top / norm * F.col("_s")) * (1 + 1e-9) + 1e-12, F.lit(float("inf")))
    known = queries.join(kth, F.col("_q") == F.col("_of"), "left").withColumn("_bound", bound)

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, bounds: pd.Series, own: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series([[i for i in np.flatnonzero(cells.distances(y) <= radius * b).tolist() if i != o] for y, b, o in zip(asked(np.stack(v.to_numpy())), bounds, own, strict=True)])

    abroad = known.select("_id", "_q", "_v", "_bound", F.explode(others("_v", "_bound", "_cell")).alias("_cell"))
    found = first.unionByName(visits(abroad))
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
