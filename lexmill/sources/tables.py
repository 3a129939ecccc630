"""Small tab-separated tables: positions, parts of speech, statistics, n-grams."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.staging import hadoop_path

log = logging.getLogger(__name__)
POSITIONS = "ch string, p_s double, p_m double, p_e double"
TAGS = "word string, tag string"
STATISTICS = "word string, freq long, entropy double"


def _exists(spark: SparkSession, path: str) -> bool:
    store, found = hadoop_path(spark, path)
    return store.exists(found)


def _fields(spark: SparkSession, path: str, n: int, strip: bool = False) -> tuple[DataFrame, list[Column]]:
    """Lines of exactly n fields, and their fields as columns."""
    value = F.regexp_replace("value", r"^\s+|\s+$", "") if strip else F.col("value")
    lines = spark.read.text(path).select(value.alias("value"), F.monotonically_increasing_id().alias("nth"))
    parts = F.split("value", "\t", -1)
    return lines.where(F.size(parts) == n), [parts[k] for k in range(n)]


def position_table(spark: SparkSession, path: str | None) -> DataFrame:
    """ch, p_s, p_m, p_e of a file; lines that don't parse are passed over, and the last line of a character counts.

    Without a file the table is empty, with a warning, and the filter by position is left out.
    """
    if path is None or not _exists(spark, path):
        log.warning("no table of positions (%s): words will not be filtered by position", path)
        return spark.createDataFrame([], POSITIONS)
    lines, (ch, *rest) = _fields(spark, path, 4, strip=True)
    number = [F.trim(x).try_cast("double").alias(n) for x, n in zip(rest, ("p_s", "p_m", "p_e"), strict=True)]
    rows = lines.select("nth", ch.alias("ch"), *number).dropna(subset=["p_s", "p_m", "p_e"])
    last = rows.groupBy("ch").agg(F.max_by(F.struct("p_s", "p_m", "p_e"), "nth").alias("x"))
    return last.select("ch", "x.*")


def tag_table(spark: SparkSession, path: str | None) -> DataFrame | None:
    """word, tag of a file (word, tag; the last line of a word counts); None without a path."""
    if path is None:
        return None
    lines, (word, tag) = _fields(spark, path, 2)
    return lines.groupBy(word.alias("word")).agg(F.max_by(F.trim(tag), "nth").alias("tag"))


def installed_tags(spark: SparkSession) -> DataFrame | None:
    """The dictionary of the jieba package where it is installed; None elsewhere."""
    try:
        import jieba.posseg as posseg
    except ImportError:
        return None
    posseg.dt.initialize()
    return spark.createDataFrame(list(posseg.dt.word_tag_tab.items()), TAGS)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """word, freq, entropy of a file of three fields; other lines are passed over."""
    lines, (word, freq, entropy) = _fields(spark, path, 3)
    rows = lines.select(word.alias("word"), F.trim(freq).try_cast("long").alias("freq"), F.trim(entropy).try_cast("double").alias("entropy"))
    return rows.dropna(subset=["freq", "entropy"])


def read_ngrams(spark: SparkSession, path: str, counted: bool = False) -> DataFrame:
    """word, ctx, c (1) of a file of n-grams: cut at the first tab; lines without a word before it are passed over.

    counted: c is what stands behind the last tab, as `sinks.write_ngrams` writes it; lines without it are passed over too.
    """
    at = F.instr("value", "\t")
    lines = spark.read.text(path).where(at > 1)
    if counted:
        last = F.substring_index("value", "\t", -1)
        ctx = F.col("value").substr(at + 1, F.length("value") - at - 1 - F.length(last))
        rows = lines.where(F.length("value") - F.length(last) > at).select(F.col("value").substr(F.lit(1), at - 1).alias("word"), ctx.alias("ctx"), last.try_cast("long").alias("c"))
        return rows.dropna(subset=["c"])
    rest = F.regexp_replace(F.col("value").substr(at + 1, F.length("value")), r"[\r\n]+$", "")
    return lines.select(F.col("value").substr(F.lit(1), at - 1).alias("word"), rest.alias("ctx"), F.lit(1).cast("long").alias("c"))
