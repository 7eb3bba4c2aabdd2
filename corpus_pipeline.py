"""A corpus pipeline over ``documents``, from quality filter to token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, mixing, quality, simhash
from tidemark.llm.common import cut_lineage, forget, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that, nearly or exactly, came before."""
    return _measured(lines.clean(docs))


def fresh_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return _measured(mixing.draw(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("quality classifier", good), ("line dedup", fresh_lines), ("SimHash near-dedup", fresh_documents), ("source mixing", mixed), ("byte-level BPE", encoded)]

#: No SQL expresses the trained network or XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.

    Each stage's result is written to the cluster's shared folder and read again; the one
    before it is then deleted. Null and empty texts go where a stage sends them: the
    classifier scores them like any other text, line dedup leaves them as they are, equal
    rows are near copies of which one stays, and mixing takes no words of them. Null ids
    come last where the smallest id decides. An empty table gives no rows; further columns
    of ``documents``, whatever their names, go through all stages but the last.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
            if before is not None:
                forget(before)
            before = docs
    return docs
