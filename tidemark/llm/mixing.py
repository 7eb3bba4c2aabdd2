"""Mixing sources to target weights (operator 7).

Every document gets a hash-random key. Within its source, documents are in the order of
that key, and a prefix sum of their sizes says where the source's exact budget cuts. The
sum is distributed: keys are uniform, so their first hex digits deal each source, however
large, into BUCKETS equal ranges; one aggregate per range gives the range's offset, and
only inside a range is anything sorted. No step sees more than one range of one source,
or one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, n_words

#: Hex digits of the key that name a range: 4096 ranges in each source.
RANGE_DIGITS = 3
#: A source is repeated this many times at most.
MAX_EPOCHS = 3
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (1, 2, 3)


def source_targets(ranges: DataFrame) -> DataFrame:
    """One row per source: _source, source_size, target.

    ``ranges`` has _source and _sum. Targets are the level L with target = min(weight * L,
    MAX_EPOCHS * source_size) whose sum is the sum of all sizes: what resharing the excess
    by weight comes to. With sources sorted by cap / weight, L is the largest of
    (total - caps before) / (weights from here on).
    """
    every = Window.orderBy(F.col("_source").asc_nulls_last())
    total = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = (F.row_number().over(every) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).cast("double")
    return (
        ranges.groupBy("_source")
        .agg(F.sum("_sum").alias("source_size"))
        .withColumn("_weight", weight)
        .withColumn("_cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(total).cast("double"))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
        .withColumn("_level", F.max("_level").over(total))
        .select("_source", "source_size", F.least(F.col("_weight") * F.col("_level"), F.col("_cap")).alias("target"))
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document its size, its source's size and target, and the words taken of it.

    Returns id_col, the ``carry`` columns, size, source_size, target and taken; other
    columns are ignored, so clashing names don't matter. taken = whole epochs * size, and
    in the epoch that ends inside the source, whatever of the document lies before the cut.
    Null text: size 0, taken 0. Null source: a source of its own, last. Null ids are
    keyed by their text. Repeated rows count each; equal rows are interchangeable, so reruns agree. An
    empty table gives no rows; a corpus without words takes nothing.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("size"), key.alias("_key"), F.struct(F.lit(0), *carry).alias("_carried")).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    rows = cut_lineage(rows)  # words are counted once
    ranges = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    of_source = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(ranges).withColumnRenamed("_source", "_of")
    offsets = (
        ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(of_source), F.lit(0)))
        .join(targets, F.col("_source").eqNullSafe(F.col("_of")))
        .select("_of", F.col("_range").alias("_in"), "_before", "source_size", "target")
    )
    joined = rows.join(offsets, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    ties = [F.col("_carried")] if carry else []
    run = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    before = F.col("_before") + F.sum("size").over(run) - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return joined.withColumn("taken", (whole * F.col("size") + part).cast("long")).select(F.col("_id").alias(id_col), *[F.col(f"_carried.{c}").alias(c) for c in carry], "size", "source_size", "target", "taken")


def draw(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: a row for each epoch a document is in.

    The one document of each source in which the budget ends appears once with the words
    before the cut, their white space as it was. Documents without words take no words, so
    they don't appear.
    """
    mixed = mix(docs.withColumn("_row", F.struct(*docs.columns)), id_col=id_col, text_col=text_col, source_col=source_col, carry=("_row",))
    copies = F.expr("transform(sequence(0L, (taken - 1) div size), i -> least(size, taken - i * size))")
    drawn = mixed.where(F.col("taken") > 0).withColumn("_words", F.explode(copies))
    text = F.col("_row").getField(text_col)
    piece = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("_words").cast("int")), "")
    cut = F.when(F.col("_words") < F.col("size"), piece).otherwise(text)
    out = {c: cut if c == text_col else F.col("_row").getField(c) for c in docs.columns}
    return drawn.select(*[v.alias(c) for c, v in out.items()])


#: DuckDB SQL for the query over ``documents``.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS t FROM s
), l AS (
  SELECT *, (t - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM r
), g AS (
  SELECT source, source_size, least(w * max(lev) OVER (), cap) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END AS e,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(e * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - e * source_size - before)) AS BIGINT) AS taken
FROM p
"""
