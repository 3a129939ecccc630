"""Column functions on text: built-in expressions only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.config import HAN_FIRST, HAN_LAST, STOPWORDS

HAN = f"[{HAN_FIRST}-{HAN_LAST}]"
# The 26 characters for a to z, of the test transform.
FIXTURE = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


def clean(text: Column, stopwords: str = STOPWORDS) -> Column:
    """Each sign, space, control or mark, and each stopword, as one space."""
    return F.regexp_replace(text, rf"[\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}\x{{3000}}{stopwords}]", " ")


def han_runs(text: Column, stopwords: str = STOPWORDS, least: int = 2) -> Column:
    """The tokens of a text: maximal runs of Han characters without stopwords, of `least` characters or more.

    Cleaning needs no pass of its own, as no Han character is among the signs that it replaces.
    """
    return F.regexp_extract_all(without_stopwords(text, stopwords), F.lit(run_pattern(least)), F.lit(0))


def run_pattern(least: int = 2) -> str:
    """The pattern of runs of `least` Han characters or more, in a text without stopwords."""
    return f"{HAN}{{{least},}}" if least > 1 else f"{HAN}+"


def without_stopwords(text: Column, stopwords: str = STOPWORDS) -> Column:
    """Each stopword as one space, so places stay. A class of characters without them costs a look at each of them for every character."""
    return F.translate(text, stopwords, " " * len(stopwords)) if stopwords else text


def is_han(char: Column) -> Column:
    """Whether the string is one Han character."""
    return char.rlike(rf"\A{HAN}\z")


def all_han(word: Column) -> Column:
    """Whether all characters are Han; true for the empty string."""
    return word.rlike(rf"\A{HAN}*\z")


def holds_any(word: Column, parts: tuple[str, ...]) -> Column:
    """Whether the word holds any of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | word.contains(p)
    return out


def bucket_hash(line: Column) -> Column:
    """The 31-bit CRC of what stands before the first tab; of the whole line if there is none or it comes first."""
    key = F.when(F.instr(line, "\t") > 1, F.substring_index(line, "\t", 1)).otherwise(line)
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long")


def six_places(x: Column) -> Column:
    """Rounded to six places, never negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def fixture(text: Column, letters: str = FIXTURE) -> Column:
    """The test transform: Latin letters as Han characters, for corpora that hold none."""
    return F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", letters)
