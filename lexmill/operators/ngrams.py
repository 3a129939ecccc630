"""Tokens to n-grams with their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.config import EDGE

#: Starts that are cut from one stretch of a token, so that cutting a very long run takes time in proportion to its length.
STRETCH = 256


def ngrams(counted: DataFrame, max_len: int = 6, keys: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """`keys`, word, l, r, c: all substrings of `least` to `max_len` characters with the characters beside them.

    counted holds tok and c (how often it occurs). At a token's edge the neighbour is `EDGE`. One row gives both neighbours,
    so texts are never reversed.
    """
    n = F.length("tok")
    stretches = counted.select(*keys, "c", n.alias("n"), F.concat(F.lit(EDGE), F.col("tok"), F.lit(EDGE)).alias("t"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int"))).alias("k"))
    first = F.col("k") * STRETCH
    cut = stretches.where("n > 0").select(*keys, "c", (F.col("n") - first).alias("left"), F.substring("t", first + 1, F.lit(STRETCH + max_len + 1)).alias("t"))
    starts = cut.select(*keys, "c", "t", "left", F.explode(F.sequence(F.lit(1), F.least(F.col("left"), F.lit(STRETCH)))).alias("i"))
    longest = F.least(F.lit(max_len), F.col("left") - F.col("i") + 1)
    ends = starts.where(longest >= least).select(*keys, "c", "t", "i", F.explode(F.sequence(F.lit(least), longest)).alias("j"))
    i, j = F.col("i"), F.col("j")
    return ends.select(*keys, F.substring("t", i + 1, j).alias("word"), F.substring("t", i, F.lit(1)).alias("l"), F.substring("t", i + j + 1, F.lit(1)).alias("r"), "c")


def side_contexts(grams: DataFrame, side: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, ctx, c: how often each character stands right (side "r") or left ("l") of each word."""
    return grams.groupBy(*keys, "word", F.col(side).alias("ctx")).agg(F.sum("c").alias("c"))


def contexts(grams: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, side, ctx, c: the counts of both sides by one aggregate."""
    sides = F.explode(F.array(F.struct(F.lit("r").alias("side"), F.col("r").alias("ctx")), F.struct(F.lit("l").alias("side"), F.col("l").alias("ctx"))))
    both = grams.select(*keys, "word", "c", sides.alias("s")).select(*keys, "word", "s.side", "s.ctx", "c")
    return both.groupBy(*keys, "word", "side", "ctx").agg(F.sum("c").alias("c"))


def binary_splits(words: DataFrame) -> DataFrame:
    """All columns of `words`, and s, prefix and suffix for each way to cut its word in two."""
    cut = words.where(F.length("word") >= 2).withColumn("s", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    return cut.withColumn("prefix", F.substring("word", F.lit(1), F.col("s"))).withColumn("suffix", F.substring("word", F.col("s") + 1, F.length("word")))
