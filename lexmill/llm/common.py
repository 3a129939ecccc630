"""What the operators share: tables, staged results in the shared folder, and text expressions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.staging import dropped, release, shared_dir, staged

#: The white space of all contracts, as a character class of Java and RE2.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Ids that may be broadcast to take rows away (some 16 bytes each); beyond it, the rows are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of a batch of rows for a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
__all__ = ["BATCH_BYTES", "BROADCAST_IDS", "SPACE", "WORD", "boxed", "doc_fold", "dropped", "few", "release", "shared_dir", "small_batches", "staged", "table", "text_or_empty", "tidy", "without_ids"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, read by Spark only, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one, `doc`, so that further columns can't clash with them; `select("doc.*")` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("doc"))


def text_or_empty(text: Column | str = "text") -> Column:
    """The text, with the empty string for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def doc_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`: the fold that contracts hold out by."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % mod).cast("int")


def few(rows: DataFrame, most: int | None = None) -> bool:
    """Whether there are at most `most` rows (`BROADCAST_IDS` by default)."""
    most = BROADCAST_IDS if most is None else most
    return rows.limit(most + 1).count() <= most


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Python workers get batches of about `BATCH_BYTES`, unless it has a bound of its own.

    Spark bounds batches by 10,000 rows first, which are 20 MB and more of texts, held several times over on both sides.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def tidy(work: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """`work` of mapInPandas or mapInArrow; at a task's end its worker, which later stages use again, hands freed memory back."""

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        yield from work(frames)
        _hand_back()

    return run


def _hand_back() -> None:
    """Allocators keep what is freed, unless told."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose doc_id isn't in the single column of `ids`.

    Ids are counted first: few are broadcast, so that texts stay where they are; otherwise both sides are shuffled.
    """
    gone = staged(ids.toDF("gone").where("gone is not null").distinct(), "gone")
    small = few(gone)
    return boxed(docs).join(F.broadcast(gone) if small else gone, F.col("doc.doc_id").cast("long") == F.col("gone"), "left_anti").select("doc.*")
