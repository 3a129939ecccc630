"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths over capacity / (k + 1) up to capacity / k, and each
of its bins takes exactly k pieces. A document gives whole sequences of `CAPACITY` tokens and a rest. A rest that would
leave more than `SLACK` of its bin's share empty is first cut at the class bound below it (capacity // (k + 1)), and what
remains is classed the same way; remainders shrink so fast that three cuts are rare.

Workers pack their partitions each for itself, in one pass and without a shuffle. Bins that are not full at a partition's
end are laid end to end, cut anew at the capacity, and the last part is cut into powers of two, which need no padding. A
sequence's id is its partition's number, times 2**40, plus its place there, so a task that runs again gives the same ids.

Tokens: a Hugging Face tokenizer file, no special tokens added, then id 1 after each document. Texts are first cut at literal
special tokens, which keep their own ids as in the library. The vocabulary's pre-tokens never span white space, so the rest
is split there and each distinct chunk is encoded once; the cache is bounded.

Defined results: a null or empty text is the single token 1; rows that repeat are packed each for itself; an empty table
gives an empty result; a document of any length is cut into as many sequences as it fills; rows without an id keep null.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import tidy

CAPACITY = 2048
END = 1
#: Of its share of a bin, the part that a piece may leave empty.
SLACK = 0.03
#: Distinct chunks that a worker's cache holds; as many of the generation before, and words.
CACHE = 300_000
#: Tokens of finished sequences that a worker holds.
HELD = 1 << 18
#: Texts whose new words are merged together, and their characters (a longer text is a group of its own).
GROUP, GROUP_CHARS = 1024, 1 << 21
#: Words, and their bytes when padded to one width, that are merged in one sweep of arrays.
SWEEP, SWEEP_BYTES = 8192, 1 << 18
VOCABULARY = "word_bpe_49k.json"
_ODD = re.compile("[\x1c-\x1f]")
#: A comma or full stop at a chunk's end that a sign stands before, with which it is one pre-token.
_SIGN_RUN = re.compile(r"[^a-z\xdf-\xf6\xf8-\xff0-9 \n][,.][ \n]")
#: Small letters whose form is their own normal form: a chunk of them is one pre-token.
_PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]{1,128}").fullmatch
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
NO_RANK = np.iinfo(np.int32).max
_WIDTHS = (0, 4, 8, 12, 16, 24, 40, 80, 160, 512)


class WordMerger:
    """Byte-pair merges of many words at once: all words' best pairs merge in one sweep of arrays."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[letters[b] + "</w>"] for b in range(256)], dtype=np.int64)
        # Open addressing in a sparse table; probes are swept together.
        self.bits = 19
        self.table = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        self.probes = 0
        todo, ranks, step = keys, np.arange(len(keys), dtype=np.int32), 0
        while len(todo):
            at = (self._hash(todo) + step) & ((1 << self.bits) - 1)
            free = self.table[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.table[at[first]], self.rank[at[first]] = todo[first], ranks[first]
            rest = np.ones(len(todo), dtype=bool)
            rest[first] = False
            todo, ranks, step = todo[rest], ranks[rest], step + 1
        self.probes = step

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits))).view(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        at = self._hash(keys)
        held = self.table[at]
        out = np.where(held == keys, self.rank[at], NO_RANK)
        todo = np.flatnonzero((held != keys) & (held != -1))
        for step in range(1, self.probes):
            if not len(todo):
                break
            at = (self._hash(keys[todo]) + step) & ((1 << self.bits) - 1)
            held = self.table[at]
            found = held == keys[todo]
            out[todo[found]] = self.rank[at[found]]
            todo = todo[~found & (held != -1)]
        return out

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for low, high in zip(_WIDTHS, _WIDTHS[1:], strict=False):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            step = min(SWEEP, SWEEP_BYTES // high)
            for part in range(0, len(rows), step):
                self._merge(rows[part : part + step], words, lengths, high, out)
        return out

    def _merge(self, rows: np.ndarray, words: list[bytes], lengths: np.ndarray, width: int, out: list[bytes]) -> None:
        flat = np.frombuffer(b"".join([words[r].ljust(width, b"\0") for r in rows.tolist()]), dtype=np.uint8).reshape(-1, width)
        n = lengths[rows]
        ids = self.inner[flat]
        every = np.arange(len(rows))
        ids[every, n - 1] = self.last[flat[every, n - 1]]
        ids[np.arange(width) >= n[:, None]] = -1
        final = np.full(ids.shape, -1, dtype=np.int32)
        live = every
        keys = (ids[:, :-1] << 32) | ids[:, 1:]
        ranks = np.where(ids[:, 1:] >= 0, self.ranks(keys.ravel()).reshape(keys.shape), NO_RANK)
        places = np.arange(width)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            ended = best == NO_RANK
            if ended.any():
                final[live[ended]] = ids[ended]
                going = ~ended
                live, ids, ranks, at, best = live[going], ids[going], ranks[going], at[going], best[going]
            if not len(live):
                break
            here = np.arange(len(live))
            over = places[None, :-1] > at[:, None]
            ids[here, at] = self.merged[best]
            ids[:, :-1] = np.where(over, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(over[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            for left in (at - 1, at):
                ok = np.flatnonzero((left >= 0) & (left < width - 1))
                a, b = ids[ok, left[ok]], ids[ok, np.minimum(left[ok] + 1, width - 1)]
                ranks[ok, left[ok]] = np.where(b >= 0, self.ranks((a << 32) | b), NO_RANK)
        for r, m, size in zip(rows.tolist(), final, (final >= 0).sum(1).tolist(), strict=True):
            out[r] = m[:size].tobytes()


class ChunkEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers, by a cache of white-space separated chunks.

    Chunks of Latin letters and signs are split by the vocabulary's own pattern and merged here, many at once; chunks with
    any other character go to the tokenizer library.
    """

    def __init__(self, path: str, cache: int = CACHE, group_chars: int = GROUP_CHARS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = WordMerger(path)
        added = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: Keys that no chunk of a text has, as chunks hold no space.
        self.special = {f" {c}": n.to_bytes(4, "little") for c, n in added.items()}
        self.literal = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None
        self.limit, self.young, self.old = cache, dict(self.special), {}
        self.group_chars = group_chars
        self.words: dict[str, bytes] = {}

    def _learn(self, missing: list[str]) -> None:
        plain = list(filter(_PLAIN, missing))
        self.young.update(zip(plain, self.merge([w.encode() for w in plain]), strict=True))
        if len(plain) == len(missing):
            return
        missing = [c for c in missing if c not in self.young]
        split: list[tuple[str, list[str]]] = []
        hard = []
        for chunk in missing:
            if len(chunk) > _WIDTHS[-1] // 4 or max(chunk) >= "\u0250":
                hard.append(chunk)
                continue
            low = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
            core = low.rstrip(",.")
            if core.isalpha():
                split.append((chunk, [core] if core == low else [core, low[len(core) :]]))
            else:
                split.append((chunk, _PRETOKEN.findall(low)))
        known = self.words
        new = list({w for _, parts in split for w in parts if w not in known})
        known.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
        self.young.update((c, known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p])) for c, p in split)
        if hard:
            self.young.update((c, np.array(e.ids, dtype="<u4").tobytes()) for c, e in zip(hard, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False), strict=True))
        if len(known) > self.limit:
            self.words = {}

    def _cut(self, text: str) -> list[str]:
        if not self.literal or "<|" not in text and not self.literal.search(text):
            return _chunks(text)
        # Every second part is a special token.
        return [c for n, part in enumerate(self.literal.split(text)) for c in ([f" {part}"] if n % 2 else _chunks(part))]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Texts are taken in groups, so that the words new to a group are merged together."""
        for texts_of in _text_groups(texts, self.group_chars):
            group = [self._cut(t) if t else [] for t in texts_of]
            if len(self.young) > self.limit:
                self.old, self.young = self.young, dict(self.special)
            young, old = self.young, self.old
            missing = set().union(*group).difference(young)
            if missing:
                kept = missing.intersection(old)
                young.update((c, old[c]) for c in kept)
                self._learn(list(missing - kept))
            for chunks in group:
                yield b"".join(map(young.__getitem__, chunks))


def _text_groups(texts: list[str | None], most_chars: int) -> Iterator[list[str | None]]:
    """The texts in runs of at most `GROUP` texts and `most_chars` characters, or one text."""
    first = held = 0
    for n, text in enumerate(texts):
        size = len(text or "")
        if n > first and (n - first == GROUP or held + size > most_chars):
            yield texts[first:n]
            first, held = n, 0
        held += size
    if first < len(texts):
        yield texts[first:]


def _chunks(text: str) -> list[str]:
    """The text cut at white space, where no pre-token spans; case doesn't count.

    Where commas and full stops at chunks' ends follow letters or digits, they are cut off too, as pre-tokens of their own:
    the chunks are then plain words, and far fewer are distinct.
    """
    if _ODD.search(text):
        return [c for c in _SPACES.split(text) if c]
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split()
    low = text.lower()
    if _SIGN_RUN.search(low):
        return low.split()
    return low.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ").replace(",\n", " , ").split()


def cuts(rest: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a rest below the capacity, in the order of its tokens."""
    pieces = []
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity or rest <= capacity // 32:
            pieces.append((rest, k))
            break
        k += 1
        pieces.append((capacity // k, k))
        rest -= capacity // k
    return pieces


class HarmonicPacker:
    """Bins of one worker. `put` and `close` give finished sequences: lists of (document, start, length).

    hold: what a bin keeps of a document for a piece (document, start, length).
    """

    def __init__(self, capacity: int = CAPACITY, slack: float = SLACK, hold: Callable[[Any, int, int], Any] = lambda doc, start, length: doc):
        self.capacity, self.slack, self.hold = capacity, slack, hold
        self.bins: dict[int, list[tuple[Any, int, int]]] = {}

    def put(self, doc: Any, tokens: int) -> Iterator[list[tuple[Any, int, int]]]:
        start = 0
        while tokens - start >= self.capacity:
            yield [(doc, start, self.capacity)]
            start += self.capacity
        for length, k in cuts(tokens - start, self.capacity, self.slack):
            held = self.bins.setdefault(k, [])
            held.append((self.hold(doc, start, length), start, length))
            start += length
            if len(held) == k:
                yield self.bins.pop(k)

    def close(self) -> Iterator[list[tuple[Any, int, int]]]:
        left = [p for k in sorted(self.bins) for p in self.bins[k]]
        self.bins = {}
        total = sum(p[2] for p in left)
        at = 0
        for _ in range(total // self.capacity):
            taken, at = self._take(left, at, self.capacity)
            yield taken
        rest = total % self.capacity
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                taken, at = self._take(left, at, 1 << bit)
                yield taken

    @staticmethod
    def _take(left: list[tuple[Any, int, int]], at: int, room: int) -> tuple[list[tuple[Any, int, int]], int]:
        taken = []
        while room:
            doc, start, length = left[at]
            part = min(room, length)
            taken.append((doc, start, part))
            room -= part
            if part == length:
                at += 1
            else:
                left[at] = (doc, start + part, length - part)
        return taken, at


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(vocabulary: Callable[[], str], capacity: int, slack: float, with_ids: bool, cache: int = CACHE, group_chars: int = GROUP_CHARS) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    end = END.to_bytes(4, "little")

    def part(doc: tuple[int | None, bytes, int], start: int, length: int) -> tuple[int | None, bytes, int]:
        """Only the piece's own ids, so that a bin doesn't keep whole documents alive."""
        doc_id, ids, tokens = doc
        return (doc_id, _Part(ids[4 * start : 4 * (start + length)], start), tokens) if length < tokens else doc

    def rows(done: list[list], first: int) -> pd.DataFrame:
        out = []
        for n, sequence in enumerate(done, first):
            offset = 0
            for (doc_id, ids, tokens), start, length in sequence:
                part = ids[4 * start : 4 * (start + length)]
                out.append((doc_id, start, length, zlib.crc32(part), tokens, n, offset, *([np.frombuffer(part, dtype="<u4").astype(np.int32)] if with_ids else [])))
                offset += length
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"doc_id": "Int64"})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder(vocabulary(), cache, group_chars)
        packer = HarmonicPacker(capacity, slack, part)
        first = TaskContext.get().partitionId() << 40
        for frame in frames:
            done = []
            held = 0
            for doc_id, ids in zip(frame["doc_id"], encoder.encode(frame["text"].tolist()), strict=True):
                ids += end
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                tokens = len(ids) // 4
                done += packer.put((doc_id, ids, tokens), tokens)
                held += tokens
                if held > HELD:
                    yield rows(done, first)
                    first += len(done)
                    done, held = [], 0
            yield rows(done, first)
            first += len(done)
        yield rows(list(packer.close()), first)

    return pack


class _Part(bytes):
    """The ids of a part of a document, addressed as in the whole document."""

    def __new__(cls, part: bytes, start: int):
        self = super().__new__(cls, part)
        self.start = start
        return self

    def __getitem__(self, key: Any) -> Any:
        return bytes.__getitem__(self, slice(key.start - 4 * self.start, key.stop - 4 * self.start)) if isinstance(key, slice) else bytes.__getitem__(self, key)


def public_vocabulary(name: str = VOCABULARY) -> Callable[[], str]:
    """The place of an installed vocabulary file, looked up where it is read."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: Callable[[], str] | None = None, capacity: int = CAPACITY, slack: float = SLACK, with_ids: bool = False, cache: int = CACHE, group_chars: int = GROUP_CHARS, hand_back: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its token ids.

    capacity must be a power of two; cache, group_chars and hand_back (of freed memory, at a task's end) trade memory for time and don't change results. Memory: the cache, a batch of documents, finished sequences of `HELD` tokens, and the
    open bins: a hundred classes or so, each with less than a sequence's ids, in up to capacity pieces of a class.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    work = _pack(vocabulary or public_vocabulary(), capacity, slack, with_ids, cache, group_chars)
    return kept.mapInPandas(tidy(work) if hand_back else work, schema)
