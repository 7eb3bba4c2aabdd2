"""The queries of this subpackage, as ``__spark_entry__`` registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, jaccard, licences, lines, mixing, neighbours, perspectives, pseudonyms, quality, repetition, search, simhash
from .common import table


#: Key of the pseudonyms; a deployment passes its own secret.
PSEUDONYM_KEY = "tidemark"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op2_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_rules(table(spark, sf_dir, "documents"))
    return out.drop("covered_words", "longest_repeat")


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op4_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).drop("_copy")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op13_geometric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_suffix_array_repetition": op2_suffix_array_repetition,
    "op3_perspective_rotation": op3_perspective_rotation,
    "op4_simhash_bk_tree": op4_simhash_bk_tree,
    "op5_licence_scan": op5_licence_scan,
    "op6_stable_projections": op6_stable_projections,
    "op7_mix_sources": op7_mix_sources,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_byte_cnn": op9_byte_cnn,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_source_divergence": op11_source_divergence,
    "op12_count_vector_join": op12_count_vector_join,
    "op13_geometric_search": op13_geometric_search,
}

ORACLES: dict[str, str] = {
    "op2_suffix_array_repetition": repetition.ORACLE,
    "op3_perspective_rotation": perspectives.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_count_vector_join": jaccard.ORACLE,
    "op13_geometric_search": search.ORACLE,
}
