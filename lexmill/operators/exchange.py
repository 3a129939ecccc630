"""Partitionings of rows by word, for exports and for stores that want them; plans themselves leave this to the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import bucket_hash


#: Tables up to this size are dealt anew before costly work.
SPREAD_BYTES = 256 << 20


def bucket_count(total_bytes: int, bucket_bytes: int = 4 << 30, most: int | None = None) -> int:
    """Buckets for so many bytes, at least one; as many as it takes unless `most` is given."""
    n = total_bytes // bucket_bytes + 1
    return min(n, most) if most else n


def buckets(rows: DataFrame, n: int, word: str = "word") -> DataFrame:
    """`rows` with bucket: the CRC of the word, modulo n, the same in every run and engine."""
    return rows.withColumn("bucket", (bucket_hash(F.col(word)) % n).cast("int"))


def sorted_buckets(rows: DataFrame, n: int, word: str = "word") -> DataFrame:
    """`rows` dealt to n partitions by bucket, each sorted by word."""
    return buckets(rows, n, word).repartition(n, "bucket").sortWithinPartitions("bucket", word)


def sorted_ranges(rows: DataFrame, n: int, word: str = "word") -> DataFrame:
    """`rows` in n ranges of words of about equal size, each sorted: a total order over the partitions."""
    return rows.repartitionByRange(n, word).sortWithinPartitions(word)


def sharded(rows: DataFrame, n: int) -> DataFrame:
    """`rows` dealt to n partitions in turn."""
    return rows.repartition(n)


def spread(rows: DataFrame, most_bytes: int = SPREAD_BYTES) -> DataFrame:
    """A small table dealt to all cores, as a file of one row group is read by one task; a larger one is left as it is.

    The planner's estimate of size decides, so no job is run.
    """
    session = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(session.sparkContext.defaultParallelism) if size <= most_bytes else rows


def concatenated(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
