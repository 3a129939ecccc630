"""Counts of contexts to frequency and boundary entropy of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import all_han, six_places

#: Frequent words that may be broadcast to prune contexts (some 60 bytes each).
BROADCAST_WORDS = 400_000


def entropy_bits(counts: Column, total: Column) -> Column:
    """Aggregate: Shannon entropy of `counts`, which sum to `total`; null counts take no part; never below 0."""
    return six_places(F.greatest(F.lit(0.0), F.log2(total.cast("double")) - F.sum(counts * F.log2(counts)) / total))


def word_freq(grams: DataFrame, min_freq: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, freq of words that occur `min_freq` times or more."""
    return grams.groupBy(*keys, "word").agg(F.sum("c").alias("freq")).where(F.col("freq") >= min_freq)


def side_entropy(counted: DataFrame, min_freq: int = 0, min_entropy: float = -1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, freq, entropy of one side's counts (word, ctx, c)."""
    c, total = F.col("c").cast("double"), F.sum("c")
    out = counted.groupBy(*keys, "word").agg(total.alias("freq"), entropy_bits(c, total).alias("entropy"))
    return out.where((F.col("freq") >= min_freq) & (F.col("entropy") >= min_entropy))


def merged_entropy(right: DataFrame, left: DataFrame, min_entropy: float = -1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, freq (of the right side) and the smaller entropy, of words that both sides hold."""
    other = left.select(*keys, "word", F.col("entropy").alias("_left"))
    both = right.join(other, [*keys, "word"]).select(*keys, "word", "freq", F.least("entropy", "_left").alias("entropy"))
    return both.where(F.col("entropy") >= min_entropy)


def statistics(counted: DataFrame, min_freq: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, freq, right_entropy, left_entropy of both sides' counts (word, side, ctx, c), by one aggregate and no join."""
    c = F.col("c").cast("double")
    right, left = F.when(F.col("side") == "r", c), F.when(F.col("side") == "l", c)
    total = F.sum(F.when(F.col("side") == "r", F.col("c")))
    out = counted.groupBy(*keys, "word").agg(total.alias("freq"), entropy_bits(right, total).alias("right_entropy"), entropy_bits(left, total).alias("left_entropy"))
    return out.where(F.col("freq") >= min_freq)


def of_frequent(grams: DataFrame, frequent: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The n-grams of frequent words only, so that contexts of the many rare ones are never shuffled.

    frequent must be cheap to count; it is broadcast only up to `BROADCAST_WORDS` words, and joined by shuffle beyond.
    """
    words = frequent.select(*keys, "word")
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return grams.join(F.broadcast(words) if few else words, [*keys, "word"], "left_semi")


def index(stats: DataFrame, min_freq: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, freq: the table that parts of words are looked up in."""
    return stats.where((F.col("freq") >= min_freq) & all_han(F.col("word"))).select(*keys, "word", "freq")


def single_total(indexed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, total: the frequencies of all words of one character, summed; one row without keys."""
    one = F.sum(F.when(F.length("word") == 1, F.col("freq")))
    return indexed.groupBy(*keys).agg(F.coalesce(one, F.lit(0)).cast("long").alias("total"))
