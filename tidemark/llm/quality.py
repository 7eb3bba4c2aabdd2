"""Quality classifier: a byte-level convolutional network in numpy (operator 9).

Filters of WIDTH bytes slide over chunks of CHUNK bytes, which overlap so that every window
of the document lies in one. Each filter is max-pooled over its chunk; the mean and the
maximum over a document's chunks feed a small dense layer, whose output is one probability.
A filter is a table of one weight per offset and byte, so convolving is looking up and adding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, FILTERS, HIDDEN, CHUNK = 6, 16, 16, 512
STRIDE = CHUNK - WIDTH + 1
#: The bounded sample of labelled rows that the model is fitted on: documents of each class, of any length.
SAMPLE_PER_CLASS = 2000
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 10, 1200, 32, 0.01, 17
THRESHOLD = 0.7
#: Chunks convolved at once in scoring and in learning.
BLOCK, LEARN_BLOCK = 64, 1024


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of a text of n bytes begin; the last ends with the text."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - CHUNK, STRIDE), n - CHUNK)


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as rows of bytes, zero after a short text's end, and how many each text has."""
    at, counts, base = [], [], 0
    for t in texts:
        s = chunk_starts(len(t))
        at.append(s + base)
        counts.append(len(s))
        base += max(len(t), CHUNK)
    data = np.frombuffer(b"".join(t if len(t) >= CHUNK else t.ljust(CHUNK, b"\0") for t in texts), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(data, CHUNK)
    return windows[np.concatenate(at)], np.array(counts)


def convolve(tables: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """[chunk, position, filter]"""
    n = CHUNK - WIDTH + 1
    out = tables[0].take(chunks[:, :n], axis=0)
    for j in range(1, WIDTH):
        out += tables[j].take(chunks[:, j : j + n], axis=0)
    return out


class Network:
    """Parameters by name; forward and backward passes."""

    def __init__(self, params: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.p = params or {
            "tables": 0.3 * draw(WIDTH, 256, FILTERS), "bias": np.zeros(FILTERS, np.float32), "w1": draw(2 * FILTERS, HIDDEN) / np.float32(np.sqrt(2 * FILTERS)),
            "b1": np.zeros(HIDDEN, np.float32), "w2": draw(HIDDEN) / np.float32(np.sqrt(HIDDEN)), "b2": np.zeros(1, np.float32),
        }

    def pool(self, chunks: np.ndarray) -> np.ndarray:
        """[chunk, filter], a block of chunks at a time."""
        parts = [convolve(self.p["tables"], chunks[i : i + BLOCK]).max(axis=1) for i in range(0, len(chunks), BLOCK)]
        return np.maximum(np.concatenate(parts) + self.p["bias"], 0)

    def head(self, pooled: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.r_[0, np.cumsum(counts)[:-1]]
        features = np.concatenate([np.add.reduceat(pooled, first) / counts[:, None], np.maximum.reduceat(pooled, first)], axis=1)
        hidden = np.maximum(features @ self.p["w1"] + self.p["b1"], 0)
        return features, hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"], -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """One text's chunks are pooled at a time, so memory grows with the longest text only."""
        if not texts:
            return np.zeros(0)
        pooled = [self.pool(chunked([t])[0]) for t in texts]
        return self.head(np.concatenate(pooled), np.array([len(p) for p in pooled]))[2]

    def gradients(self, chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        top_of = []
        for i in range(0, len(chunks), LEARN_BLOCK):
            acts = convolve(self.p["tables"], chunks[i : i + LEARN_BLOCK])
            at = acts.argmax(axis=1)
            top_of.append((at, np.take_along_axis(acts, at[:, None], axis=1)[:, 0]))
        where = np.concatenate([at for at, _ in top_of])  # [chunk, filter]
        pooled = np.maximum(np.concatenate([top for _, top in top_of]) + self.p["bias"], 0)
        features, hidden, prob = self.head(pooled, counts)
        d = ((prob - labels) / len(labels)).astype(np.float32)
        g = {"w2": hidden.T @ d, "b2": d.sum(keepdims=True)}
        dh = np.outer(d, self.p["w2"]) * (hidden > 0)
        g |= {"w1": features.T @ dh, "b1": dh.sum(axis=0)}
        df = dh @ self.p["w1"].T
        doc = np.repeat(np.arange(len(counts)), counts)
        top = pooled == features[doc, FILTERS:]
        share = np.add.reduceat(top.astype(np.float32), np.r_[0, np.cumsum(counts)[:-1]])[doc]
        dp = (df[doc, :FILTERS] / counts[doc, None] + df[doc, FILTERS:] * top / share) * (pooled > 0)
        g["bias"] = dp.sum(axis=0)
        spots = where[:, :, None] + np.arange(WIDTH)
        bytes_there = np.take_along_axis(chunks[:, None, :], spots, axis=2).astype(np.int64)  # [chunk, filter, offset]
        flat = (np.arange(WIDTH) * 256 + bytes_there) * FILTERS + np.arange(FILTERS)[:, None]
        g["tables"] = np.bincount(flat.ravel(), np.repeat(dp.ravel(), WIDTH), WIDTH * 256 * FILTERS).astype(np.float32).reshape(WIDTH, 256, FILTERS)
        return g


def train(chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Network:
    """Adam over shuffled batches with a falling rate; the same rows in the same order give the same network."""
    net, rng = Network(), np.random.default_rng(SEED)
    if not len(labels):
        return net
    first = np.r_[0, np.cumsum(counts)[:-1]]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    each = -(-len(labels) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    step, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs])
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for k, g in net.gradients(chunks[rows], counts[docs], labels[docs]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id's row is never held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network from a bounded sample: the SAMPLE_PER_CLASS labelled ids of each class with the least hashes.

    Held-out ids, null ids and labels other than 0 and 1 are left out. Of a repeated id the
    least text counts, and an id labelled both ways counts as 1. Texts of the sample are learnt
    from whole, however long, pooled a block of chunks at a time as they are in scoring.
    """
    marked = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).withColumn("_hash", F.xxhash64("_id"))
    classes = [marked.where(F.col("_label") == k).dropDuplicates(["_id"]).orderBy("_hash", "_id").limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    chosen = {r["_id"]: int(r["_label"]) for c in classes for r in c.collect()}
    if not chosen:
        return Network()

    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], f"_chosen {docs.schema[id_col].dataType.simpleString()}")
    here = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_chosen"))  # 2 * SAMPLE_PER_CLASS ids at most
    rows = here.groupBy("_id").agg(F.min(F.coalesce("_text", F.lit(b""))).alias("_text")).collect()
    rows.sort(key=lambda r: str(r["_id"]))
    if not rows:
        return Network()
    chunks, counts = chunked([bytes(r["_text"]) for r in rows])
    return train(chunks, counts.astype(np.int64), np.array([chosen[r["_id"]] for r in rows], np.float32))


def scorer(docs: DataFrame, net: Network):
    """A column function from binary texts to probabilities; null scores like the empty text."""
    params = docs.sparkSession.sparkContext.broadcast(net.p)  # WIDTH * 256 * FILTERS weights and a few more, whatever the corpus

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(Network(params.value).score([bytes(t) if t is not None else b"" for t in texts]) if len(texts) else [], dtype="float64")

    return lambda text: score(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: id_col, held_out, score, predicted.

    Every text is scored whole, where it is read, without a shuffle. Null and empty texts
    score like each other; null ids and repeated rows give a row each; other columns are
    ignored; an empty table gives no rows, and without labels the untrained network scores.
    A very long text is scored whole, one block of chunks at a time.
    """
    score = scorer(docs, fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns as they were."""
    score = scorer(docs, fit(docs, labels, text_col=text_col))
    return docs.where(score(F.col(text_col)) >= THRESHOLD)
