"""Cohesion, position, artifacts, part of speech, and order of candidate words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.config import BLOCKLIST
from lexmill.functions.text import holds_any
from lexmill.operators.ngrams import binary_splits
from lexmill.operators.statistics import single_total


def best_product(words: DataFrame, indexed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, product: the largest product of the frequencies of a word's two parts, over all cuts that are known."""
    splits = binary_splits(words.select(*keys, "word"))
    part = lambda name, freq: indexed.select(*keys, F.col("word").alias(name), F.col("freq").cast("double").alias(freq))
    known = splits.join(part("prefix", "f1"), [*keys, "prefix"]).join(part("suffix", "f2"), [*keys, "suffix"])
    return known.groupBy(*keys, "word").agg(F.max(F.col("f1") * F.col("f2")).alias("product"))


def with_pmi(words: DataFrame, indexed: DataFrame, keys: tuple[str, ...] = (), total: DataFrame | None = None) -> DataFrame:
    """`words` with pmi, the pointwise mutual information of the weakest cut in bits; 0 where no cut is known.

    The sum of single characters' frequencies is one row (one for each key), so it is broadcast.
    """
    total = single_total(indexed, keys) if total is None else total
    found = words.join(best_product(words, indexed, keys), [*keys, "word"], "left")
    found = found.join(F.broadcast(total), list(keys), "left") if keys else found.crossJoin(F.broadcast(total))
    ratio = F.col("freq").cast("double") * F.col("total") / F.col("product")
    return found.withColumn("pmi", F.coalesce(F.when(ratio > 0, F.log2(ratio)), F.lit(0.0))).drop("product", "total")


def with_position(words: DataFrame, positions: DataFrame | None) -> DataFrame:
    """`words` with pos_prob: the smaller of the first character's P(start) and the last one's P(end), 0 if one is unknown.

    positions: ch, p_s, p_m, p_e, a row for a character, so it is bounded by the number of characters; None: 0 for all.
    """
    if positions is None:
        return words.withColumn("pos_prob", F.lit(0.0))
    first = F.broadcast(positions.select(F.col("ch").alias("_first"), "p_s"))
    last = F.broadcast(positions.select(F.col("ch").alias("_last"), "p_e"))
    found = words.join(first, F.substring("word", 1, 1) == F.col("_first"), "left").join(last, F.substring("word", -1, 1) == F.col("_last"), "left")
    both = F.when(F.col("p_s").isNotNull() & F.col("p_e").isNotNull(), F.least("p_s", "p_e")).otherwise(F.lit(0.0))
    return found.withColumn("pos_prob", both).drop("_first", "_last", "p_s", "p_e")


def without_artifacts(words: DataFrame, parts: tuple[str, ...] = BLOCKLIST) -> DataFrame:
    """`words` without those that hold a fragment of wrongly decoded text."""
    return words.where(~holds_any(F.col("word"), parts))


def with_tags(words: DataFrame, tags: DataFrame | None) -> DataFrame:
    """`words` with pos: the part of speech by a dictionary (word, tag) of any size, "x" if it isn't in it."""
    if tags is None:
        return words.withColumn("pos", F.lit("x"))
    # A dictionary's size isn't bounded, so the planner chooses the join.
    one = tags.groupBy("word").agg(F.max("tag").alias("tag"))
    return words.join(one, "word", "left").withColumn("pos", F.coalesce("tag", F.lit("x"))).drop("tag")


def extract_words(merged: DataFrame, indexed: DataFrame, positions: DataFrame | None = None, pmi: float = 1.0, position: float = 0.1, blocklist: tuple[str, ...] = BLOCKLIST, keys: tuple[str, ...] = (), total: DataFrame | None = None) -> DataFrame:
    """`keys`, word, freq, pmi, entropy, pos_prob of the words that pass all filters; the cheap filters come first.

    Without positions, or with an empty table, the filter by position is left out.
    """
    if positions is not None and positions.isEmpty():
        positions = None
    words = without_artifacts(merged.where(F.length("word") >= 2), blocklist)
    scored = with_position(words, positions)
    scored = scored.where(F.col("pos_prob") >= position) if positions is not None else scored
    scored = with_pmi(scored, indexed, keys, total).where(F.col("pmi") >= pmi)
    return scored.select(*keys, "word", "freq", "pmi", "entropy", "pos_prob")


def ordered(words: DataFrame) -> DataFrame:
    """By frequency, the highest first; ties by the word's code points."""
    return words.orderBy(F.col("freq").desc(), F.col("word").asc())
