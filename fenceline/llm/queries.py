"""The registered queries of the corpus operators and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fenceline.llm import chat, convnet, dictionaries, jaccard, lattice, manifest, mixing, packing, patterns, repeats, rules, search, spots
from fenceline.llm.common import table


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents"))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convnet.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprints(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.document_scores(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_control_case(table(spark, sf_dir, "conversations")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op11_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(table(spark, sf_dir, "documents"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_quality": op1_compression_quality,
    "op2_suffix_repeats": op2_suffix_repeats,
    "op3_hilbert_packing": op3_hilbert_packing,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_spot_fingerprints": op6_spot_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_lattice_scores": op8_lattice_scores,
    "op9_chat": op9_chat,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_pair_bound_search": op11_pair_bound_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_pattern_packing": op13_pattern_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op7_mixing": mixing.SQL,
    "op11_pair_bound_search": search.SQL,
    "op12_merkle_manifest": manifest.SQL,
}
