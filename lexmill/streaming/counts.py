"""Context counts of a growing corpus, kept up to date by Structured Streaming.

An extension: entropies aren't sums, but the counts they rest on are. Each batch writes its own counts under its number, so a
batch that runs again after a failure replaces what it wrote, and a lexicon of all batches is one more sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexmill.config import Settings
from lexmill.operators.ngrams import contexts, ngrams
from lexmill.operators.statistics import statistics
from lexmill.operators.tokens import token_counts, tokens


def counted(stream: DataFrame, folder: str, checkpoint: str, text: str = "text", settings: Settings = Settings()) -> StreamingQuery:
    """Start the query that writes each batch's counts (word, side, ctx, c) below `folder`, and goes on from `checkpoint`."""

    def write(batch: DataFrame, number: int) -> None:
        toks = token_counts(tokens(batch, text, stopwords=settings.stopwords))
        contexts(ngrams(toks, settings.max_len)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark: SparkSession, folder: str) -> DataFrame:
    """word, side, ctx, c: the sum of all batches."""
    return spark.read.parquet(folder).groupBy("word", "side", "ctx").agg(F.sum("c").alias("c"))


def current(spark: SparkSession, folder: str, settings: Settings = Settings()) -> DataFrame:
    """The word statistics of all batches so far."""
    return statistics(compacted(spark, folder), settings.min_freq)
