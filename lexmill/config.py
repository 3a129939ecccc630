"""Settings of a lexicon, and fixed values."""

from __future__ import annotations

from dataclasses import dataclass

# Single characters that part tokens.
STOPWORDS = "的很了么呢是嘛个都也比还这于不与才上用就好在和对挺去后没说"
# Fragments of wrongly decoded text.
BLOCKLIST = ("锟斤拷", "拷斤拷", "烫烫烫", "屯屯屯", "铪铪", "锟斤", "斤拷")
# The characters of words.
HAN_FIRST, HAN_LAST = "一", "龥"
# Fixed value: the context of a word at a token's edge; one ordinary symbol.
EDGE = "$"
# Names of text files.
EXTENSIONS = (".txt", ".csv", ".json", ".sql", ".md", ".html", ".htm")
OUTPUT_SUFFIX = "words_sort.data"
# Fixed values of encoding detection: bytes of a sample; least share of Han characters to keep UTF-8, and to take another
# encoding; largest share of replacement characters in damaged UTF-8.
SAMPLE_BYTES = 64 * 1024
UTF8_HAN, OTHER_HAN, UTF8_DAMAGE = 0.005, 0.01, 0.05
OTHER_ENCODINGS = ("gb18030", "gbk", "big5")
# Files of one or few huge lines.
LONG_LINE_BYTES, LONG_LINE_BREAKS, LONG_LINE_SAMPLE = 100 * 1024 * 1024, 10, 4 * 1024 * 1024
# Fixed value: intermediate data as a multiple of the input.
ROOM_FACTOR = 8


@dataclass(frozen=True)
class Settings:
    """Thresholds; all comparisons are "at least"."""

    # The defaults.
    max_len: int = 6
    min_freq: int = 10
    pmi: float = 1.0
    entropy: float = 2.0
    position: float = 0.1
    stopwords: str = STOPWORDS
    blocklist: tuple[str, ...] = BLOCKLIST

    def __post_init__(self) -> None:
        if not 2 <= self.max_len <= 32:
            raise ValueError(f"max_len must be from 2 to 32, not {self.max_len}")
        if self.min_freq < 1:
            raise ValueError(f"min_freq must be 1 or more, not {self.min_freq}")
