"""Text files of any store that Hadoop reads: listing, encodings, and lines as a table."""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import EXTENSIONS, LONG_LINE_BREAKS, LONG_LINE_BYTES, LONG_LINE_SAMPLE, SAMPLE_BYTES
from lexmill.sources.encoding import detect
from lexmill.staging import hadoop_path

#: Encodings in which the bytes 0A and 0D only ever end lines.
LINE_SAFE = re.compile(r"utf[-_]?8|ascii|gbk|gb2312|gb18030|big5|latin|iso[-_]?8859|cp125|windows", re.I)
BLOCK = 8 << 20
#: Bytes of a file that executors read whole to find its encoding; files from which on they do; driver threads for other files.
SMALL_FILE, FEW_FILES, SAMPLERS = 8 << 20, 32, 16
LINES = "path string, encoding string, value string"
_BEYOND_HAN = re.compile(r"[^一-龥]")


@dataclass(frozen=True)
class TextFile:
    path: str
    size: int
    encoding: str = "utf-8"
    long_lines: bool = False

    @property
    def hidden(self) -> bool:
        """Whether Spark's readers pass over the name."""
        return os.path.basename(self.path)[:1] in "_."


def list_files(spark: SparkSession, path: str) -> list[TextFile]:
    """The file itself, whatever its name; of a folder, all files below it with a text extension, by path.

    A folder may hold none. FileNotFoundError if there is neither.
    """
    store, found = hadoop_path(spark, path)
    if not store.exists(found):
        raise FileNotFoundError(f"no such file or folder: {path}")
    status = store.getFileStatus(found)
    plain = lambda s: s.getPath().toString().removeprefix("file:") if "://" not in path else s.getPath().toString()
    if status.isFile():
        return [TextFile(plain(status), status.getLen())]
    out, every = [], store.listFiles(found, True)
    while every.hasNext():
        s = every.next()
        if os.path.splitext(s.getPath().getName())[1].lower() in EXTENSIONS:
            out.append(TextFile(plain(s), s.getLen()))
    return sorted(out, key=lambda f: f.path)


def read_range(spark: SparkSession, path: str, first: int, n: int) -> bytes:
    """Up to n bytes of a file from `first`."""
    store, found = hadoop_path(spark, path)
    stream = store.open(found)
    try:
        stream.seek(first)
        bounded = spark.sparkContext._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
    finally:
        stream.close()


def samples(spark: SparkSession, file: TextFile, n: int = SAMPLE_BYTES) -> list[bytes]:
    """n bytes of the head, the middle and the tail; the whole of a file that is no longer than n."""
    if file.size <= n:
        return [read_range(spark, file.path, 0, file.size)] if file.size else [b""]
    return [read_range(spark, file.path, at, n) for at in (0, max(0, (file.size - n) // 2), file.size - n)]


def has_long_lines(spark: SparkSession, file: TextFile, least: int = LONG_LINE_BYTES, n: int = LONG_LINE_SAMPLE) -> bool:
    """Whether a large file has few line breaks in three samples."""
    return file.size >= least and sum(s.count(b"\n") for s in samples(spark, file, n)) <= LONG_LINE_BREAKS


def described(spark: SparkSession, path: str) -> list[TextFile]:
    """The files below `path` with their encodings.

    Executors read files of up to `SMALL_FILE` bytes and send back their encodings only. Of larger files, which are few for
    their bytes, samples go to the driver, several files at a time.
    """
    files = list_files(spark, path)
    small = [f for f in files if f.size <= SMALL_FILE and not f.hidden]
    found = _small_encodings(spark, small) if len(small) > FEW_FILES else {}
    rest = [f for f in files if f.path not in found]
    with ThreadPoolExecutor(SAMPLERS) as pool:
        found |= dict(zip((f.path for f in rest), pool.map(lambda f: (detect(samples(spark, f)), has_long_lines(spark, f)), rest), strict=True))
    return [TextFile(f.path, f.size, *found[f.path]) for f in files]


def _small_encodings(spark: SparkSession, files: list[TextFile]) -> dict[str, tuple[str, bool]]:
    """Encoding and whether lines are long, by path; files come whole to the executors."""
    n = SAMPLE_BYTES
    # Cut in the JVM, so that only samples go to Python.
    content, size = F.col("content"), F.col("length").cast("int")
    parts = F.when(size <= n, F.array("content")).otherwise(F.array(*[F.substring(content, at + 1, F.lit(n)) for at in (F.lit(0), F.floor((size - n) / 2).cast("int"), size - n)]))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "encoding": [detect([bytes(b) for b in own] or [b""]) for own in frame["parts"]]})

    read = spark.read.format("binaryFile").load([f.path for f in files]).select("path", parts.alias("parts"))
    plain = {f.path.removeprefix("file://").removeprefix("file:"): f.path for f in files}
    rows = read.mapInPandas(each, "path string, encoding string").collect()
    return {plain[unquote(r["path"]).removeprefix("file://").removeprefix("file:")]: (r["encoding"], False) for r in rows}


def decoded(encoding: str) -> Callable[[pd.Series], pd.Series]:
    """A pandas UDF that decodes bytes, damage replaced, as Python's codec does."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else b.decode(encoding, errors="replace"))

    return decode


def streamed(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, encoding, value of whole files (path, encoding), one file a task, cut at characters that are not Han.

    For what Spark's line reader can't cut: encodings whose line breaks aren't single bytes, huge lines in them, and names
    that it passes over. No token crosses a cut, so the lexicon is that of the whole text. The paths must be open to workers.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, encoding in zip(frame["path"], frame["encoding"], strict=True):
                decoder, kept = codecs.getincrementaldecoder(encoding)(errors="replace"), ""
                with open(path.removeprefix("file:"), "rb") as f:
                    while data := f.read(block):
                        kept += decoder.decode(data)
                        ends = [m.end() for m in _BEYOND_HAN.finditer(kept, max(0, len(kept) - 4096))] or [m.end() for m in _BEYOND_HAN.finditer(kept)]
                        if ends:
                            yield pd.DataFrame({"path": [path], "encoding": [encoding], "value": [kept[: ends[-1]]]})
                            kept = kept[ends[-1] :]
                    kept += decoder.decode(b"", final=True)
                if kept:
                    yield pd.DataFrame({"path": [path], "encoding": [encoding], "value": [kept]})

    return paths.repartition(max(1, paths.count()), "path").mapInPandas(read, LINES)


def read_lines(spark: SparkSession, files: list[TextFile]) -> DataFrame:
    """path, encoding, value of all lines of all files. A file of any length is split among tasks where its encoding allows."""
    parts: list[DataFrame] = []
    groups: dict[tuple[str, bool], list[str]] = {}
    apart: list[tuple[str, str]] = []
    for f in files:
        if not f.size:
            continue
        utf8 = f.encoding.lower() in ("utf-8", "utf_8", "ascii")
        if f.hidden or not LINE_SAFE.match(f.encoding) or (f.long_lines and not utf8):
            apart.append((f.path, f.encoding))
        else:
            groups.setdefault((f.encoding, f.long_lines), []).append(f.path)
    for (encoding, long_lines), paths in sorted(groups.items()):
        # The full stop is no part of any token, and as good a place to cut huge UTF-8 lines as a line break.
        reader = spark.read.option("lineSep", "。") if long_lines else spark.read
        lines = reader.text(paths)
        raw = F.col("value")
        value = raw if encoding.lower() in ("utf-8", "utf_8", "ascii") else decoded(encoding)(raw.cast("binary"))
        parts.append(lines.select(F.col("_metadata.file_path").alias("path"), F.lit(encoding).alias("encoding"), value.alias("value")))
    if apart:
        parts.append(streamed(spark.createDataFrame(apart, "path string, encoding string")))
    if not parts:
        return spark.createDataFrame([], LINES)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
