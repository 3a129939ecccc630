"""Lines to tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.config import STOPWORDS
from lexmill.functions.text import han_runs, run_pattern, without_stopwords


def tokens(lines: DataFrame, text: str | Column = "text", keys: tuple[str, ...] = (), stopwords: str = STOPWORDS) -> DataFrame:
    """`keys` and tok, a row for each token. A null text has none."""
    column = F.col(text) if isinstance(text, str) else text
    return lines.select(*keys, F.explode(han_runs(column, stopwords)).alias("tok"))


def token_offsets(lines: DataFrame, text: str | Column = "text", keys: tuple[str, ...] = (), stopwords: str = STOPWORDS) -> DataFrame:
    """`keys`, tok, start and end (code points, end exclusive): each token's place in its line."""
    column = without_stopwords(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), stopwords)
    found = han_runs(column, "")
    # A token starts behind all tokens before it and the gaps between them; sums over a line take time in proportion.
    pairs = F.arrays_zip(F.slice(F.split(column, run_pattern(), -1), 1, F.size(found)).alias("gap"), found.alias("tok"))
    numbered = lines.select(*keys, F.monotonically_increasing_id().alias("_row"), pairs.alias("_pairs"))
    cut = numbered.select(*keys, "_row", F.posexplode("_pairs").alias("_nth", "_x"))
    ends = F.sum(F.length("_x.gap") + F.length("_x.tok")).over(Window.partitionBy("_row").orderBy("_nth"))
    return cut.withColumn("_end", ends).select(*keys, "_x.tok", (F.col("_end") - F.length("_x.tok")).cast("int").alias("start"), F.col("_end").cast("int").alias("end"))


def token_counts(toks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, tok, c: equal tokens counted, with partial counts before the shuffle, so that each is cut up once."""
    return toks.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("c"))
