"""The plan from text to lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.config import Settings
from lexmill.operators.exchange import spread
from lexmill.operators.ngrams import contexts, ngrams
from lexmill.operators.scoring import extract_words, ordered, with_tags
from lexmill.operators.statistics import index, of_frequent, statistics, word_freq
from lexmill.operators.tokens import token_counts, tokens
from lexmill.staging import staged

COLUMNS = ("word", "freq", "pmi", "entropy", "pos_prob", "pos")


def word_statistics(lines: DataFrame, text: str | Column = "text", settings: Settings = Settings(), keys: tuple[str, ...] = (), prune: bool = False) -> DataFrame:
    """`keys`, word, freq, right_entropy, left_entropy of all words of `min_freq` or more.

    Equal tokens are counted before they are cut up. With prune, the frequencies come first, and contexts are counted for
    frequent words only: two passes over the distinct tokens, yet much less to shuffle where most substrings are rare.
    """
    column = F.col(text) if isinstance(text, str) else text
    counted = token_counts(tokens(spread(lines.select(*keys, column.alias("_text"))), "_text", keys, settings.stopwords), keys)
    if prune:
        counted = staged(counted, "tokens")
    grams = ngrams(counted, settings.max_len, keys)
    if prune:
        grams = of_frequent(grams, staged(word_freq(grams, settings.min_freq, keys), "frequent"), keys)
    return statistics(contexts(grams, keys), settings.min_freq, keys)


def merged(stats: DataFrame, min_entropy: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, word, freq, entropy (the smaller side's) of statistics of both sides."""
    return stats.select(*keys, "word", "freq", F.least("right_entropy", "left_entropy").alias("entropy")).where(F.col("entropy") >= min_entropy)


def lexicon_of(stats: DataFrame, settings: Settings = Settings(), positions: DataFrame | None = None, tags: DataFrame | None = None, keys: tuple[str, ...] = (), candidates: DataFrame | None = None) -> DataFrame:
    """`keys` and the columns of a lexicon, unordered; `stats` is read several times, so it should be staged.

    candidates: `merged` statistics, where they are at hand.
    """
    indexed = index(stats, settings.min_freq, keys)
    candidates = merged(stats, settings.entropy, keys) if candidates is None else candidates
    words = extract_words(candidates, indexed, positions, settings.pmi, settings.position, settings.blocklist, keys)
    return with_tags(words, tags).select(*keys, *COLUMNS)


def lexicon(lines: DataFrame, text: str | Column = "text", settings: Settings = Settings(), positions: DataFrame | None = None, tags: DataFrame | None = None, keys: tuple[str, ...] = (), prune: bool = False) -> DataFrame:
    """The ordered lexicon of a table with a text column; with keys, one lexicon for each."""
    stats = staged(word_statistics(lines, text, settings, keys, prune), "statistics")
    out = lexicon_of(stats, settings, positions, tags, keys)
    return out.orderBy(*keys, F.col("freq").desc(), "word") if keys else ordered(out)
