"""Ranked lexical search by per-term geometric blocking.

One pass over the texts keeps, per document, its length and its counts of the terms asked
for. Tasks then take documents in shards. A shard's documents are put in the order of a
clustering, and each posting list, in that order, is cut into blocks of similar documents.
A block's summary is the coordinatewise maximum of its documents' vectors; weighed by an
item's terms it bounds every score inside. Lists are visited from the strongest on, blocks
from the highest bound on. A block is skipped only where its bound is below the item's
k-th best score so far, and a visit ends where the lists left can't reach it together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, forget

K = 50
#: Documents a block, at most.
BLOCK = 16
CENTROIDS = 32
#: Blocks scored between two looks at the threshold.
STEP = 8
#: Documents times terms a shard: bounds a task's memory at 4 bytes each.
CELLS = 1 << 23
#: (item, term) entries a round: bounds what the driver holds and sends to tasks.
ROUND_TERMS = 20_000
#: Bytes of terms, A-Z lower-cased; all others part terms.
ALNUM = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return bytes(text).translate(ALNUM).split()


class Item:
    """A question: positions of its terms in the round's vocabulary, and its best documents so far."""

    def __init__(self, terms: list[int], k: int):
        self.terms, self.k = np.array(sorted(terms), np.int64), k
        self.score, self.none, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.least
        self.score, self.none, self.ids = np.r_[self.score, score[keep]], np.r_[self.none, none[keep]], np.r_[self.ids, ids[keep]]
        best = np.lexsort((self.ids, self.none, -self.score))[: self.k]
        self.score, self.none, self.ids = self.score[best], self.none[best], self.ids[best]

    @property
    def least(self) -> int:
        """The least score that may still count; one at a tie does."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


class Postings:
    """One term's list in a shard: documents in blocks, and their summaries at ``coords``."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, term: int, coords: np.ndarray, block: int):
        self.docs = np.flatnonzero(vectors[term])
        mine = labels[self.docs]
        run = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        since = np.arange(len(mine)) - np.repeat(run, np.diff(np.r_[run, len(mine)]))
        self.starts = np.flatnonzero(since % block == 0)
        self.ends = np.r_[self.starts[1:], len(mine)]
        self.coords = coords
        self.summary = np.maximum.reduceat(vectors[np.ix_(coords, self.docs)], self.starts, axis=1)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return weights @ self.summary[np.searchsorted(self.coords, terms)].astype(np.int64)


class Shard:
    """Documents as vectors (terms x documents) of saturated counts; ``weights`` makes them scores."""

    def __init__(self, docs: pd.DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, block: int):
        sizes = docs["ids"].str.len().to_numpy(np.int64)
        term = np.concatenate([*docs["ids"], np.zeros(0, np.int32)]).astype(np.int64)
        tf = np.concatenate([*docs["tfs"], np.zeros(0, np.int64)]).astype(np.int64)
        m = np.repeat(50 + 50 * docs["n"].to_numpy(np.int64) * n_docs // n_terms, sizes)
        vectors = np.zeros((len(weights), len(docs)), np.int32)
        vectors[term, np.repeat(np.arange(len(docs)), sizes)] = 1_000_000_000 * tf // (1000 * tf + 20 * m)
        self.labels, order = self.clustered(vectors, weights)
        self.vectors = np.ascontiguousarray(vectors[:, order])
        self.none, self.ids = docs["doc_id"].isna().to_numpy()[order], docs["doc_id"].fillna(0).to_numpy(np.int64)[order]
        self.weights, self.block, self.lists = weights, block, {}

    @staticmethod
    def clustered(vectors: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels in order and the order: each document goes to the nearest of evenly drawn ones by cosine, nearest first."""
        x = (vectors * weights[:, None].astype(np.float32)).astype(np.float32)
        x /= np.maximum(np.sqrt((x * x).sum(axis=0)), 1e-9)
        heads = np.unique(np.linspace(0, x.shape[1] - 1, min(CENTROIDS, x.shape[1])).astype(int))
        near = x[:, heads].T @ x
        labels = near.argmax(axis=0)
        order = np.lexsort((-near.max(axis=0), labels))
        return labels[order], order

    @cached_property
    def tops(self) -> np.ndarray:
        return self.weights * self.vectors.max(axis=1)

    def search(self, item: Item, around: dict[int, np.ndarray]) -> None:
        """Offers the item every document that may belong to its best. around: per term, the terms of all items that hold it."""
        terms, weights = item.terms, self.weights[item.terms]
        seen = np.zeros(len(self.ids), bool)
        strength = self.tops[terms]
        order = np.argsort(-strength, kind="stable")
        left = strength[order][::-1].cumsum()[::-1]  # what this list and those after it can give together
        for at, most in zip(order, left, strict=True):
            if most < item.least:
                break
            term = int(terms[at])
            if term not in self.lists:
                self.lists[term] = Postings(self.vectors, self.labels, term, around[term], self.block)
            found = self.lists[term]
            bound = found.bounds(terms, weights)
            best = np.argsort(-bound, kind="stable")
            for k in range(0, len(best), STEP):
                some = [b for b in best[k : k + STEP] if bound[b] >= item.least]
                if not some:
                    break
                docs = np.concatenate([found.docs[found.starts[b] : found.ends[b]] for b in some])
                docs = docs[~seen[docs]]
                seen[docs] = True
                item.offer(weights @ self.vectors[np.ix_(terms, docs)].astype(np.int64), self.none[docs], self.ids[docs])


def _ask(forward: DataFrame, asked: list[tuple[int | None, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, block: int, cells: int) -> DataFrame:
    """Each task's k best documents of each item: (_item, _none, _doc, score)."""
    around: dict[int, np.ndarray] = {}
    for _, terms in asked:
        for t in terms:
            around[t] = np.union1d(around.get(t, np.zeros(0, np.int64)), terms)
    rows = max(1, cells // max(1, len(weights)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = [Item(terms, k) for _, terms in asked]
        for batch in batches:
            for at in range(0, len(batch), rows):
                shard = Shard(batch.iloc[at : at + rows], weights, n_docs, n_terms, block)
                for item in items:
                    shard.search(item, around)
        for i, item in enumerate(items):
            if len(item.ids):
                yield pd.DataFrame({"_item": i, "_none": item.none, "_doc": item.ids, "score": item.score})

    return forward.mapInPandas(run, "_item int, _none boolean, _doc long, score long")


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, block: int = BLOCK, cells: int = CELLS, round_terms: int = ROUND_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by id.

    Null and empty texts hold no terms: such documents are never found and such items find
    nothing. Rows of one item id ask together, with the terms of all of them, once each.
    Repeated documents each count and each have a rank; null document ids come after others
    of their score. Long texts are read whole, and an item of many terms is a round of its
    own. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession

    @F.pandas_udf("array<binary>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([list(set(terms_of(t))) for t in texts], dtype=object)

    text = lambda name: F.coalesce(F.col(name), F.lit("")).cast("binary")
    entries = cut_lineage(items.select(F.col(item_col).cast("long").alias("_id"), F.explode(split(text(item_text_col))).alias("_term")).distinct())
    rounds = max(1, -(-entries.count() // round_terms))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for r in range(rounds):
        mine = entries.where(F.pmod(F.xxhash64("_id"), F.lit(rounds)) == r).toPandas()
        if mine.empty:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for t in mine["_term"]}))}

        def count(batches: Iterator[pd.DataFrame], vocabulary: dict[bytes, int] = vocabulary) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for doc_id, body in zip(batch["doc_id"], batch["body"], strict=True):
                    words = terms_of(body)
                    held = [(vocabulary[t], n) for t, n in Counter(words).items() if t in vocabulary]
                    rows.append((doc_id, len(words), [t for t, _ in held], [n for _, n in held]))
                yield pd.DataFrame(rows, columns=["doc_id", "n", "ids", "tfs"]).astype({"doc_id": "Int64"})

        counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), text(text_col).alias("body")).mapInPandas(count, "doc_id long, n long, ids array<int>, tfs array<long>")
        forward = cut_lineage(counted.where("n > 0"))
        n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
        holds = {i: n for i, n in forward.select(F.explode("ids").alias("i")).groupBy("i").count().collect()}  # the round's vocabulary at most
        if not holds:
            forget(forward)
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holds[i] + 1))) if i in holds else 0 for i in range(len(vocabulary))], np.int64)
        asked = [(None if pd.isna(i) else int(i), sorted(j for t in part["_term"] if (j := vocabulary[bytes(t)]) in holds)) for i, part in mine.groupby("_id", dropna=False)]
        asked = [(i, terms) for i, terms in asked if terms]
        found = _ask(forward.where(F.size("ids") > 0), asked, weights, n_docs, n_terms, k, block, cells)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(asked)], "_at int, item_id long")
        found = found.join(F.broadcast(names), F.col("_item") == F.col("_at"))  # a row for each item of the round
        out = out.unionByName(found.select("item_id", F.when(~F.col("_none"), F.col("_doc")).alias("doc_id"), "score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL for the query.
ORACLE = rf"""
WITH t AS (
  SELECT r, doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT *, row_number() OVER () AS r FROM documents)
), q AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM benchmark
), s AS (
  SELECT r, doc_id, count(*) AS n FROM t GROUP BY r, doc_id
), g AS (
  SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM s
), tf AS (
  SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, nd
), c AS (
  SELECT tf.r, s.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))) AS c FROM tf JOIN s ON s.r = tf.r JOIN w ON w.term = tf.term, g
), p AS (
  SELECT item_id, r, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c ON c.term = q.term GROUP BY item_id, r, doc_id
), o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {K}
"""
