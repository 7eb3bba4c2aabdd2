"""Divergence audit of a language's sources by pair-task sparse merge.

Term counts are made where texts are read. The kept terms of a language are dealt to
blocks, its sources to tiles; a task co-groups two tiles' rows of one block, turns each
group into sorted (term id, count) arrays and merges every unordered pair of groups: the
shorter array is looked up in the longer one, so overlaps, terms of one side and terms of
neither are priced without a dense vector.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, join_dealt

#: A term is kept that so many of its language's documents hold.
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Kept terms a block, and sources a tile: together they bound what a task holds.
BLOCK = 4096
TILE = 32
#: Distinct (group, term) entries that a task counts before it hands them on.
HELD = 200_000
#: Bytes of terms, A-Z lower-cased; all others part terms.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, source, term, n, docs) of (lang, source, text); an empty term marks that a group occurs."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def drain() -> pd.DataFrame:
        rows = [(*g, t, n, docs[g][t]) for g, c in counts.items() for t, n in c.items()]
        rows += [(*g, b"", 0, 0) for g in counts]
        counts.clear()
        docs.clear()
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            words = bytes(text).translate(LETTERS).split()
            counts[lang, source].update(words)
            docs[lang, source].update(set(words))
        if sum(map(len, counts.values())) > HELD:
            yield drain()
    if counts:
        yield drain()


def price(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), by long division in steps of 1000, so nothing overflows."""
    by = total + 2 * kept
    out, rest = np.divmod(counts + 2, by)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + more
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Sparse:
    """A group's terms in one block: sorted ids and prices, and the price of a term it lacks."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, total: int, kept: int):
        order = np.argsort(ids)
        self.ids, self.prices = ids[order], price(counts[order], total, kept)
        self.absent = price(np.zeros(1, np.int64), total, kept)

    def to(self, other: Sparse) -> int:
        """The summed gaps over both arrays' terms, less what absent terms would have given in their place."""
        a, b = (self, other) if len(self.ids) <= len(other.ids) else (other, self)
        at = np.searchsorted(b.ids, a.ids)
        both = np.zeros(len(a.ids), bool)
        inside = at < len(b.ids)
        both[inside] = b.ids[at[inside]] == a.ids[inside]
        alone = np.ones(len(b.ids), bool)
        alone[at[both]] = False
        total = gap(a.prices[both], b.prices[at[both]]).sum() + gap(a.prices[~both], b.absent).sum() + gap(b.prices[alone], a.absent).sum()
        return int(total - (len(a.ids) + alone.sum()) * gap(a.absent, b.absent)[0])

    def absent_gap(self, other: Sparse) -> int:
        return int(gap(self.absent, other.absent)[0])


def merge_tiles(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences (lang, a, b, value) of one block: of all pairs within a tile, or of two tiles."""
    lang, i, j, block = key
    terms = pd.factorize(pd.concat([left["term"], right["term"]], ignore_index=True))[0].astype(np.int64)

    def groups(rows: pd.DataFrame, ids: np.ndarray) -> list[tuple[str, Sparse | None, int]]:
        out = []
        for source, at in sorted(rows.groupby("source", sort=False).indices.items()):
            part, mine = rows.iloc[at], ids[at]
            real = (part["term"].str.len() > 0).to_numpy()
            kept = int(part["kept"].iloc[0])
            sparse = Sparse(mine[real], part["n"].to_numpy(np.int64)[real], int(part["total"].iloc[0]), kept) if kept else None
            out.append((source, sparse, kept))
        return out

    a = groups(left, terms[: len(left)])
    b = groups(right, terms[len(left) :])
    pairs = [(x, y) for k, x in enumerate(a) for y in a[k + 1 :]] if i == j else [(x, y) for x in a for y in b]
    rows = []
    for (s, x, kept), (t, y, _) in pairs:
        value = 0 if x is None else x.to(y) + (kept * x.absent_gap(y) if block == 0 else 0)
        rows.append((lang, s, t, value))
    return pd.DataFrame(rows, columns=["lang", "a", "b", "value"])


def _priced(count: Column, total: Column, kept: Column) -> Column:
    """``price`` as a column; decimals, as the product may pass 64 bits."""
    return F.call_function("div", (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * kept).cast("decimal(19,0)")) + 1


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from its language's others, and its strangest terms.

    Part "pair": a row for each other source of the language, farthest first; part "term":
    the TOP_TERMS kept terms that the source has most in excess of its language, most
    first; ties by item in byte order. Null lang, source and text count as ''. Repeated
    rows count each; very long texts are read whole. A source alone in its language has no
    pairs, one without kept terms no terms; a language without kept terms has pairs of
    value 0. Other columns are ignored; an empty table gives no rows. Pairs grow with the
    square of a language's sources, as the result does.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"), F.coalesce(F.col(text_col), empty).cast("binary").alias("text"))
    counted = rows.mapInPandas(count_terms, "lang string, source string, term binary, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    real = F.length("term") > 0
    known = counted.select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("_docs"), F.sum("n").over(by_term).alias("lang_n"), F.row_number().over(by_term.orderBy("source")).alias("_nth"))
    kept = cut_lineage(known.where((F.col("_docs") >= MIN_DOCS) | ~real).drop("_docs"))

    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("_n"), F.count_if(real & (F.col("_nth") == 1)).alias("_first"))
    of_lang = Window.partitionBy("lang")
    groups = groups.select(
        F.struct("lang", "source").alias("_g"), "_n", "total", F.sum("total").over(of_lang).alias("lang_total"), F.sum("_first").over(of_lang).alias("kept"),
        F.greatest(F.lit(1), F.ceil(F.sum("_first").over(of_lang) / block)).cast("int").alias("_blocks"), F.ceil(F.count("*").over(of_lang) / tile).cast("int").alias("_tiles"),
    )
    groups = cut_lineage(groups)  # a row for each group
    entries = join_dealt(kept.select(F.struct("lang", "source").alias("_g"), "term", "n", "lang_n"), groups.drop("_n"), "_g", counts=groups.select("_g", "_n"))
    entries = entries.select("_g.lang", "_g.source", "term", "n", "lang_n", "total", "lang_total", "kept", "_blocks", "_tiles")

    home = F.pmod(F.xxhash64("source"), F.col("_tiles")).cast("int")
    blocks = F.when(real, F.array(F.pmod(F.xxhash64("term"), F.col("_blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    spread = entries.select("lang", "source", "term", "n", "total", "kept", home.alias("_home"), "_tiles", F.explode(blocks).alias("block"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"))
    parts = ["lang", "i", "j", "block"]
    sides = spread.select("lang", F.least("_home", "_other").alias("i"), F.greatest("_home", "_other").alias("j"), "block", "source", "term", "n", "total", "kept", "_home", "_other")
    columns = [*parts, "source", "term", "n", "total", "kept"]
    left, right = (sides.where(side).select(*(F.col(c).alias(c) for c in columns)) for side in ("_home <= _other", "_home > _other"))
    merged = left.groupBy(*parts).cogroup(right.groupBy(*parts)).applyInPandas(merge_tiles, "lang string, a string, b string, value long")
    both = merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = both.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    pairs = ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = _priced(F.col("n"), F.col("total"), F.col("kept")), _priced(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    over = entries.where(real).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), p.alias("_p"), q.alias("_q")).where("_p > _q")
    terms = over.select("lang", "source", "part", "item", F.expr("(_p - _q) * (_p - _q) div (_p + _q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)


#: DuckDB SQL for the query.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), v AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), lv AS (
  SELECT lang, count(*) AS kept, sum(n) AS total FROM v GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN v ON v.lang = t.lang AND v.term = t.term GROUP BY 1, 2, 3
), s AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2
), f AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * lv.kept) AS p,
         1 + ({SCALE}::HUGEINT * (v.n + 2)) // (lv.total + 2 * lv.kept) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN lv ON lv.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), pv AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM f WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
