"""Quality rules with suffix-array repetition (operator 2).

A suffix array over the words of a batch of texts, built by prefix doubling in numpy; ranks
hold the document, so no repeat crosses texts. The longest common prefixes of neighbours
are read off the ranks of each doubling. An LCP interval is a maximal repeated substring;
each of its occurrences covers as many words as the larger of a suffix's two neighbouring
LCPs says, so the union of the spans of all maximal repeats is the union of those runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are measured together up to so many bytes; a longer one alone.
BATCH_BYTES = 1 << 20
#: Base rules.
MIN_WORDS, WINDOW, MAX_WINDOW_PERCENT = 20, 8, 30
#: The method's own: repeats of MIN_REPEAT words or more may cover MAX_COVERED_PERCENT of the words, the longest repeat MAX_REPEAT words.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_REPEAT = 5, 35, 50

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of words from it that its document has elsewhere too.

    words: ids; doc: non-decreasing number of each word's document.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    ends = np.searchsorted(doc, doc, side="right")
    _, rank = np.unique(doc.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    # a group's rank is the place of its first suffix in the order
    s = rank[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        s = rank[order]
        tied = np.r_[False, s[1:] == s[:-1]]
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        at = order[places]
        ahead = at + step
        second = np.where(ahead < ends[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        order[places] = at[by]
        key = both[by]
        first = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[order[places]] = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
        levels.append(rank.astype(np.int32))
        step *= 2
    a, b, lcp = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = np.r_[levels.pop(), np.int32(-1)]
        live = np.flatnonzero(level[np.minimum(a + lcp, n)] == level[np.minimum(b + lcp, n)])
        lcp[live] += 1 << k
    best = np.zeros(n, np.int64)
    best[order[1:]] = lcp
    best[order[:-1]] = np.maximum(best[order[:-1]], lcp)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeat of at least so many words."""
    i = np.arange(len(best))
    return np.maximum.accumulate(np.where(best >= least, i + best, 0)) > i if len(best) else np.zeros(0, bool)


def batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts of BATCH_BYTES together, or one longer text."""
    now, size = [], 0
    for t in texts:
        if now and size + len(t) > BATCH_BYTES:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def measure(texts: list[bytes]) -> pd.DataFrame:
    """One row per text."""
    ids: dict[bytes, int] = {}
    words = [[ids.setdefault(w, len(ids)) for w in t.split()] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((i for w in words for i in w), np.int64, counts.sum())
    doc = np.repeat(np.arange(len(texts)), counts)
    best = longest_repeats(flat, doc)
    total = lambda what: np.bincount(doc, weights=what, minlength=len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, best)
    rows = []
    for t in texts:
        a = np.frombuffer(t, np.uint8)
        seen: set[bytes] = set()
        dup = 0
        for line in t.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
        rows.append((int(np.count_nonzero(((a & 0xC0) != 0x80) & ~_SPACE[a])), int(np.count_nonzero(_SYMBOL[a])), dup))
    out = pd.DataFrame(rows, columns=["word_chars", "n_symbols", "n_dup_lines"], dtype="int64")
    return out.assign(n_words=counts, n_repeat_words=total(covered(best, WINDOW)), covered_words=total(covered(best, MIN_REPEAT)), longest_repeat=longest)


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Repeated rows and null ids
    give a row each; other columns are ignored; an empty table gives no rows. A text is
    measured whole, in the task that reads it: no shuffle. Memory grows with a batch of
    BATCH_BYTES or the longest text, some 40 bytes a word and doubling.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    @F.pandas_udf(", ".join(f"{c} long" for c in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        made = [measure(b) for b in batches([bytes(t) if t is not None else b"" for t in texts])]
        return (pd.concat(made, ignore_index=True) if made else measure([]))[names]

    measured = run(F.col(text_col).cast("binary")).alias("_out")
    out = docs.select(F.col(id_col).alias("_id"), measured).select("_id", "_out.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_WINDOW_PERCENT * F.col("n_words"))
    good = (100 * F.col("covered_words") <= MAX_COVERED_PERCENT * F.col("n_words")) & (F.col("longest_repeat") <= MAX_REPEAT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & good).withColumnRenamed("_id", id_col)


#: DuckDB SQL for the query: a run of words occurs twice if each window of its length does.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), p AS (
  SELECT r, len(words) AS n, words, unnest(range(1, len(words) + 1)) AS i FROM w
), g AS (
  SELECT r, n, i, m, count(*) OVER (PARTITION BY r, m, hash(words[i:i + m - 1])) > 1 AS twice
  FROM p, (VALUES ({WINDOW}), ({MIN_REPEAT}), ({MAX_REPEAT + 1})) AS v(m) WHERE i + m - 1 <= n
), c AS (
  SELECT r, m, i, max(CASE WHEN twice THEN i + m - 1 END) OVER (PARTITION BY r, m ORDER BY i) AS reach FROM g
), e AS (
  SELECT r, m, i AS pos, reach, lead(i) OVER (PARTITION BY r, m ORDER BY i) AS nxt FROM c
), k AS (
  SELECT r, m, sum(CASE WHEN reach IS NULL OR reach < pos THEN 0 WHEN nxt IS NULL THEN reach - pos + 1 ELSE 1 END) AS covered FROM e GROUP BY r, m
), l AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line) AS nth
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), z AS (
  SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce((SELECT count(*) FROM l WHERE l.r = w.r AND nth > 1), 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce((SELECT covered FROM k WHERE k.r = w.r AND m = {WINDOW}), 0) AS BIGINT) AS n_repeat_words,
         coalesce((SELECT covered FROM k WHERE k.r = w.r AND m = {MIN_REPEAT}), 0) AS cov,
         coalesce((SELECT covered FROM k WHERE k.r = w.r AND m = {MAX_REPEAT + 1}), 0) AS far
  FROM w
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words)
         AND 100 * cov <= {MAX_COVERED_PERCENT} * n_words AND far = 0 AS kept
FROM z
"""
