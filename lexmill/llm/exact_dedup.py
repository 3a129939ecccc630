"""Exact deduplication by a cuckoo-filter index of live digests.

Texts are equal when identical after each run of ASCII white space became one space. A text's key is the SHA-256 of that
form. The index is a cuckoo filter whose slots hold a 16-bit fingerprint and the place of the key in a compact store: a
lookup without an equal fingerprint in its two filter buckets proves a key new; a hit is verified against the stored key.
Nothing else finds keys. Keys can be deleted again; when no slot can be freed, the filter is rebuilt with twice the room
from the stored keys.

Map tasks fold their rows in an index of bounded size: when it is full, keys of one row are handed on and deleted, and keys that
have come up again stay. What is handed on is dealt by leading bits of the key, more of them the more documents there are, and
each such bucket is folded in an index of its own.

Defined results: a null text counts as empty, so all null and empty texts are one group; of equal texts the smallest
doc_id stays, and rows that repeat a doc_id with equal text are all marked kept with it; a row without an id is a group of
its own and stays; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE, boxed, few, staged, text_or_empty, without_ids

SLOTS = 4
KICKS = 200
KEY_BYTES = 32
#: Keys that one map task holds before it hands groups on.
HELD_KEYS = 1 << 14
#: Keys of a bucket, about, and the fewest bits that buckets are made by.
BUCKET_KEYS, LEAST_BITS = 1 << 16, 12
_FP = 0xFFFF


class CuckooIndex:
    """Live keys with the smallest id and the number of their rows."""

    def __init__(self, capacity: int = 64):
        self.keys, self.low, self.count = bytearray(), array("q"), array("q")
        self.free: list[int] = []
        self.resized = 0
        self._clear(capacity)

    def __len__(self) -> int:
        return len(self.low) - len(self.free)

    def _clear(self, capacity: int) -> None:
        self.n = 1 << max(4, (max(1, capacity) * 5 // 4 // SLOTS - 1).bit_length())
        # 0: free; else the key's place, counted from 1, and its fingerprint.
        self.slots = array("Q", bytes(8 * SLOTS * self.n))

    def _buckets(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[16:18], "little")
        i = int.from_bytes(digest[8:16], "little") & (self.n - 1)
        return fp, i, self._other(i, fp)

    def _other(self, i: int, fp: int) -> int:
        return i ^ ((fp + 1) * 0x5BD1E995 >> 3) & (self.n - 1)

    def _find(self, digest: bytes) -> int:
        """The slot of a key; -1: not live."""
        fp, i, j = self._buckets(digest)
        for first in (i * SLOTS, j * SLOTS):
            for at in range(first, first + SLOTS):
                held = self.slots[at]
                if held and held & _FP == fp:  # a hit, verified by the stored key
                    place = (held >> 16) - 1
                    if self.keys[KEY_BYTES * place : KEY_BYTES * (place + 1)] == digest:
                        return at
        return -1

    def _put(self, fp: int, i: int, j: int, held: int) -> bool:
        """False when no room was found; the filter must then be rebuilt, as some key has lost its slot."""
        for k in (i, j):
            for at in range(k * SLOTS, (k + 1) * SLOTS):
                if not self.slots[at]:
                    self.slots[at] = held
                    return True
        k = j
        for turn in range(KICKS):
            at = k * SLOTS + turn % SLOTS
            self.slots[at], held = held, self.slots[at]
            k = self._other(k, held & _FP)
            for at in range(k * SLOTS, (k + 1) * SLOTS):
                if not self.slots[at]:
                    self.slots[at] = held
                    return True
        return False

    def add(self, digest: bytes, doc_id: int, rows: int = 1) -> bool:
        """Count `rows` rows of the key; True when the key is new."""
        at = self._find(digest)
        if at >= 0:
            place = (self.slots[at] >> 16) - 1
            self.low[place] = min(self.low[place], doc_id)
            self.count[place] += rows
            return False
        if self.free:
            place = self.free.pop()
            self.keys[KEY_BYTES * place : KEY_BYTES * (place + 1)] = digest
            self.low[place], self.count[place] = doc_id, rows
        else:
            place = len(self.low)
            self.keys += digest
            self.low.append(doc_id)
            self.count.append(rows)
        fp, i, j = self._buckets(digest)
        if not self._put(fp, i, j, place + 1 << 16 | fp):
            self._grow()
        return True

    def discard(self, digest: bytes, rows: int = 1) -> bool:
        """Take `rows` rows of the key away; without rows left, the key leaves the index. False when it isn't live."""
        at = self._find(digest)
        if at < 0:
            return False
        place = (self.slots[at] >> 16) - 1
        self.count[place] -= rows
        if self.count[place] <= 0:
            self.count[place] = 0
            self.slots[at] = 0
            self.free.append(place)
        return True

    def _grow(self) -> None:
        room = self.n * SLOTS
        while True:
            room *= 2
            self.resized += 1
            self._clear(room)
            if all(self._put(*self._buckets(digest), place + 1 << 16 | int.from_bytes(digest[16:18], "little")) for place, digest, _, _ in self.live()):
                return

    def live(self) -> Iterator[tuple[int, bytes, int, int]]:
        """(place, key, smallest id, rows) of each live key."""
        for place, rows in enumerate(self.count):
            if rows:
                yield place, bytes(self.keys[KEY_BYTES * place : KEY_BYTES * (place + 1)]), self.low[place], rows

    def groups(self) -> pd.DataFrame:
        return _frame([x[1:] for x in self.live()])

    def evicted(self) -> pd.DataFrame:
        """The groups of one row, taken out; all groups where those are less than half."""
        out = [x[1:] for x in self.live() if x[3] == 1]
        if 2 * len(out) < len(self):
            out = [x[1:] for x in self.live()]
        for digest, _, rows in out:
            self.discard(digest, rows)
        return _frame(out)


def _frame(groups: list[tuple[bytes, int, int]]) -> pd.DataFrame:
    return pd.DataFrame(groups, columns=["digest", "keep_id", "group_size"]).astype({"keep_id": "int64", "group_size": "int64"})


def normalised(text: Column | str = "text") -> Column:
    """The text with each run of ASCII white space as one space; empty for null."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the binary SHA-256 of the normalised text, wholly in the JVM."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"))


_GROUP = "digest binary, keep_id long, group_size long"


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = CuckooIndex(4096)
    for frame in frames:
        for digest, doc_id in zip(frame["digest"], frame["doc_id"], strict=True):
            index.add(bytes(digest), doc_id)
            if len(index) >= HELD_KEYS:
                yield index.evicted()
    yield index.groups()


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket, so one bucket's index is held at a time."""
    index, at = CuckooIndex(), None
    done: list[pd.DataFrame] = []
    for frame in frames:
        for bucket, digest, keep, rows in zip(frame["bucket"], frame["digest"], frame["keep_id"], frame["group_size"], strict=True):
            if bucket != at:
                done.append(index.groups())
                index, at = CuckooIndex(), bucket
            index.add(bytes(digest), keep, rows)
        if done:
            yield pd.concat(done)
            done = []
    yield index.groups()


def digest_groups(keyed: DataFrame, rows: int) -> DataFrame:
    """One row for each key of about `rows` rows: digest, keep_id, group_size.

    Each map task first folds its own rows in an index, so a key that holds a third of all rows sends few rows a task.
    """
    partial = keyed.where("doc_id is not null").mapInPandas(_partial, _GROUP)
    bits = min(32, max(LEAST_BITS, (rows // BUCKET_KEYS).bit_length()))
    leading = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    dealt = partial.withColumn("bucket", F.shiftright(leading, 32 - bits))
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_merge, _GROUP)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (lower-case hex).

    Only keys of more than one row join back; the join is on the key, and adaptive execution splits a hot one.
    """
    keyed = staged(digests(docs, text, doc_id), "digests")
    shared = digest_groups(keyed, keyed.count()).where("group_size > 1")
    own = F.col("doc_id").isNull() | F.col("group_size").isNull()
    return keyed.join(shared, "digest", "left").select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(own, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (own | (F.col("keep_id") == F.col("doc_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that repeat both id and text, one.

    Ids without a kept row are taken away by the id. Only rows of ids that have both kept and other rows, or several kept
    ones, are told apart by their texts, so others' texts are neither hashed again nor, while such ids are few, shuffled.
    """
    verdict = staged(exact_dedup(docs).where("doc_id is not null").select("doc_id", "kept", "text_sha256"), "verdict")
    per = staged(verdict.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay")), "per-id")
    out = without_ids(docs, per.where("stay = 0 or rows > 1").select("doc_id"))
    odd = per.where("stay > 0 and rows > 1").select(F.col("doc_id").alias("odd_id"))
    if not odd.limit(1).count():
        return out
    kept = verdict.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    own = boxed(docs).withColumn("id", F.col("doc.doc_id").cast("long")).join(F.broadcast(odd) if few(odd) else odd, F.col("id") == F.col("odd_id"), "left_semi")
    own = own.withColumn("sha", F.sha2(normalised(F.col("doc.text")), 256))
    found = own.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi").dropDuplicates(["id", "sha"])
    return out.unionByName(found.select("doc.*"))


SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256 from t join g on t.norm = g.norm
"""
