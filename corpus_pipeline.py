"""A corpus pipeline: quality rules, near duplicates, repeated passages, source mix, packing.

Each stage takes what the one before kept, as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fenceline.llm import jaccard, mixing, packing, repeats, rules  # noqa: E402
from fenceline.sources.shared import new_path, passing, remove  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of linked documents."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller document has too; ``n_chars`` follows the text."""
    return repeats.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("suffix_repeats", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]

#: Learned rules, hashes of whole sets and a tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next. What a stage wrote besides its
    result goes when that is written, and a result goes when the next one is; the last stays for the caller."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing(spark) as kept:
            result = stage(spark, docs, sf_dir)
            path = new_path(spark, name)
            result.write.parquet(path)
            kept.append(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.schema(result.schema).parquet(path), path
    return docs
