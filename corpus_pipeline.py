"""A corpus pipeline: reject bad documents, drop exact and near copies, mix sources to their weights, pack into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import exact_dedup, mixing, near_dedup, packing, quality
from lexmill.llm.common import small_batches, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learned from the labels table, takes for good."""
    small_batches(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the smallest doc_id."""
    small_batches(spark)
    return exact_dedup.keep_first(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more), the row of the smallest doc_id."""
    small_batches(spark)
    return near_dedup.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: one row per piece, with its ids.

    Executors' heaps have grown by the stages before, so the workers' caches are smaller than the operator's own.
    """
    small_batches(spark)
    return packing.pack(docs, with_ids=True, cache=50_000, group_chars=1 << 19, hand_back=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("MinHash near-dedup", unlike),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]
#: SQL can't express the classifier, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each staged as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, f"stage-{n + 1}")
    return docs
