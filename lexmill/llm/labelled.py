"""Bounded samples of labelled documents, to fit classifiers on the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import text_or_empty


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: tuple[int, int], most_chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most per_class[label] rows of each class, a fixed pseudo-random choice by doc_id, in its order.

    learnable is a condition on the label rows' doc_id. Rows with texts over `most_chars` are not learned from, so the sample
    is at most sum(per_class) * most_chars characters. The chosen ids are bounded, so they are broadcast.
    Of rows that repeat an id, one text counts.
    """
    rows = labels.where(learnable & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    order = F.md5(F.col("_id").cast("string"))
    # Labels that repeat an id or contradict each other: one of them counts.
    rows = rows.where(F.col("_label").isin(0, 1)).groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = None
    for value in (0, 1):
        some = rows.where(F.col("_label") == value).orderBy(order, "_id").limit(per_class[value])
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty("text").alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id").where(F.length("_text") <= most_chars).groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))
    return [(r["_text"], r["_label"]) for r in sorted(found.collect(), key=lambda r: (hashlib.md5(str(r["_id"]).encode()).digest(), r["_text"]))]
