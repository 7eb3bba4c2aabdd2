"""Byte-level BPE encoding and decoding (operator 8).

A text up to ``chunk_chars`` long is one chunk and is encoded where it is read. A longer one
is dealt out as overlapping chunks, which are pre-tokenised and encoded in parallel and
stitched where boundaries resynchronise: the pattern looks only forward, so once two
neighbouring chunks have one boundary in common, all later ones agree. Where an overlap has
no such boundary (a run of one kind of character longer than the overlap) the text from the
last sure boundary on is encoded anew. Chunks come to the stitching task in order and are
dropped one by one; digests grow as they pass. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Pieces whose encoding a worker remembers; it starts afresh beyond that.
CACHE_PIECES = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes by ranks, piece by piece; each piece's ids are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.find = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: b for b, i in ranks.items()}
        self.known: dict[str, tuple[str, list[int], bytes]] = {}

    def piece(self, piece: str) -> tuple[str, list[int], bytes]:
        """The ids as decimal text, the ids, and the bytes that they decode to."""
        got = self.known.get(piece)
        if got is None:
            ids = list(self.encoding._encode_single_piece(piece))
            got = " ".join(map(str, ids)), ids, self.decode(ids)
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[piece] = got
        return got

    def pieces(self, text: str) -> list[tuple[str, list[int], bytes]]:
        found = self.find.findall(text)
        got = list(map(self.known.get, found))
        if None in got:
            got = [x or self.piece(p) for x, p in zip(got, found, strict=True)]
        return got

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def sealed(got: list[tuple[str, list[int], bytes]], with_ids: bool) -> tuple:
    out = sum(len(x[1]) for x in got), hashlib.sha256(" ".join([x[0] for x in got]).encode()).hexdigest(), hashlib.sha256(b"".join([x[2] for x in got])).hexdigest()
    return (*out, [i for x in got for i in x[1]]) if with_ids else out


def chunks(text: str, size: int, overlap: int) -> list[str]:
    """Overlapping chunks; the last one reaches the end."""
    return [text[i : i + size + overlap] for i in range(0, max(1, len(text) - overlap), size)]


class Part:
    """An encoded stretch of text that begins at character ``base``: its pieces' starts and numbers of ids, and the ids."""

    def __init__(self, text: str, base: int, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.text, self.base, self.starts, self.counts, self.ids, self.lo = text, base, starts, counts, ids, 0

    @classmethod
    def of(cls, text: str, base: int, codec: Codec) -> Part:
        found = codec.find.findall(text)
        got = codec.pieces(text)
        starts = np.cumsum([0, *map(len, found)])[:-1]
        return cls(text, base, starts.astype(np.int64), np.array([len(x[1]) for x in got], np.int64), np.array([i for x in got for i in x[1]], np.int64))

    def taken(self, upto: int) -> np.ndarray:
        """Ids of the pieces from ``lo`` to before ``upto``."""
        ends = np.r_[0, np.cumsum(self.counts)]
        return self.ids[ends[self.lo] : ends[upto]]


class Stitcher:
    """Takes a text's chunks in order; holds one of them, and the digests of what is sure.

    A piece is sure when it starts at a sure boundary and ends two characters or more
    before its chunk does, for the pattern looks one character beyond a match.
    """

    def __init__(self, codec: Codec, with_ids: bool):
        self.codec, self.part = codec, None
        self.n, self.ids_digest, self.raw_digest = 0, hashlib.sha256(), hashlib.sha256()
        self.ids: list[np.ndarray] | None = [] if with_ids else None

    def _out(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        some = ids.tolist()
        self.ids_digest.update((" " * (self.n > 0) + " ".join(map(str, some))).encode())
        self.raw_digest.update(self.codec.decode(some))
        self.n += len(some)
        if self.ids is not None:
            self.ids.append(ids)

    def add(self, new: Part) -> None:
        now = self.part
        if now is None:
            self.part = new
            return
        at = now.base + now.starts[now.lo :]
        common = np.flatnonzero(np.isin(at, new.base + new.starts))
        ends = np.r_[now.starts[1:], len(now.text)][now.lo :]
        unsure = np.flatnonzero(ends > len(now.text) - 2)
        stop = int(unsure[0]) if len(unsure) else len(at)
        if len(common) and common[0] <= stop:
            self._out(now.taken(now.lo + int(common[0])))
            new.lo = int(np.searchsorted(new.starts, at[common[0]] - new.base))
            self.part = new
        else:  # no common boundary: go on from the last sure one through the next chunk's end
            self._out(now.taken(now.lo + stop))
            begin = int(at[stop]) if stop < len(at) else now.base + len(now.text)
            text = now.text[begin - now.base :] + new.text[now.base + len(now.text) - new.base :]
            self.part = Part.of(text, begin, self.codec)

    def row(self) -> tuple:
        """n_tokens, the digests and, if asked for, the ids."""
        if self.part is not None:
            self._out(self.part.taken(len(self.part.counts)))
        out = self.n, self.ids_digest.hexdigest(), self.raw_digest.hexdigest()
        return out if self.ids is None else (*out, np.concatenate(self.ids).tolist() if self.ids else [])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 16, overlap: int = 1024, with_ids: bool = True) -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    No special tokens: their strings are ordinary text. Null and empty texts give no
    tokens. Repeated rows, null ids among them, give a row each. Bytes that aren't UTF-8
    count as U+FFFD. An empty table gives no rows. A very long text is held whole only where
    its row is read; after that by the chunk. Other columns are ignored. ``ranks`` is broadcast: a vocabulary,
    bounded whatever the corpus.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ranks)
    name = f"bpe:{pattern}:{hashlib.sha1(repr(sorted(ranks.items())).encode()).hexdigest()}"
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def codec() -> Codec:
        return worker_cache(name, lambda: Codec(held.value, pattern))

    @F.pandas_udf(fields)
    def whole(texts: pd.Series) -> pd.DataFrame:
        c = codec()
        rows = [sealed(c.pieces(t.decode("utf-8", "replace")) if t else [], with_ids) for t in texts]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, t in zip(batch["_id"], batch["_text"], strict=True):
                text = bytes(t).decode("utf-8", "replace")
                mark = hashlib.sha256(text.encode()).hexdigest()
                for k, part in enumerate(chunks(text, chunk_chars, overlap)):
                    yield pd.DataFrame({"_id": [i], "_mark": [mark], "_k": [k], "_chunk": [part]})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec()
        for batch in batches:
            for row in batch.to_dict("records"):
                part = Part.of(row["_chunk"], 0, c)
                yield pd.DataFrame([row | {"_starts": part.starts, "_counts": part.counts, "_ids": part.ids}])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, now, last, times, made = codec(), None, -1, 0, None
        columns = ["_id", *[f.split()[0] for f in fields.split(", ")]]

        def done() -> pd.DataFrame:
            return pd.DataFrame([(now[0], *made.row())] * times, columns=columns)

        for batch in batches:
            for i, mark, k, *rest in batch[["_id", "_mark", "_k", "_chunk", "_starts", "_counts", "_ids"]].itertuples(index=False):
                if (i, mark) != now:
                    if made is not None:
                        yield done()
                    now, last, times, made = (i, mark), -1, 0, Stitcher(c, with_ids)
                times += k == 0  # a repeated row brings every chunk again
                if k > last:
                    text, *arrays = rest
                    made.add(Part(text, k * chunk_chars, *[np.asarray(a, np.int64) for a in arrays]))
                    last = k
        if made is not None:
            yield done()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.col(text_col).alias("_whole"))
    long = F.coalesce(F.length("_whole"), F.lit(0)) > chunk_chars
    short = rows.where(~long).select("_id", whole("_text").alias("_out")).select("_id", "_out.*")
    parts = rows.where(long).select(F.col("_id").cast("string"), "_text").mapInPandas(deal, f"_id string, _mark string, _k int, _chunk string")
    parts = parts.repartition("_id", "_mark", "_k").mapInPandas(split, f"_id string, _mark string, _k int, _chunk string, _starts array<int>, _counts array<int>, _ids array<int>")
    joined = parts.repartition("_id", "_mark").sortWithinPartitions("_id", "_mark", "_k").mapInPandas(join, f"_id string, {fields}")
    return short.unionByName(joined.withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType))).withColumnRenamed("_id", id_col)
