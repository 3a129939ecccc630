"""Results as files."""

from __future__ import annotations

import os
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexmill.config import OUTPUT_SUFFIX
from lexmill.staging import hadoop_path


def six_decimals(x: Column) -> Column:
    return F.format_string("%.6f", x)


def default_output(spark: SparkSession, input_path: str, today: date | None = None) -> str:
    """name_date_suffix beside a file, or in a folder. Its extension isn't one of text files, so it is never read back."""
    day = f"{today or date.today():%Y%m%d}"
    store, found = hadoop_path(spark, input_path)
    if store.exists(found) and store.getFileStatus(found).isFile():
        folder, name = os.path.split(input_path)
        return os.path.join(folder or ".", f"{os.path.splitext(name)[0]}_{day}_{OUTPUT_SUFFIX}")
    name = os.path.basename(input_path.rstrip("/"))
    return os.path.join(input_path, f"{name}_{day}_{OUTPUT_SUFFIX}")


def _one_file(lines: DataFrame, path: str, header: str | None) -> None:
    """The single column of `lines`, in order, as one file of text.

    The sort is spread over tasks; the parts, which are in order, are joined by the store. A lexicon is small beside its
    corpus, and no task holds it whole.
    """
    spark = lines.sparkSession
    store, target = hadoop_path(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parent = target.getParent() or jvm.org.apache.hadoop.fs.Path(".")
    folder = jvm.org.apache.hadoop.fs.Path(parent, f".{target.getName()}-{uuid.uuid4().hex}")
    try:
        lines.write.text(folder.toString())
        draft = jvm.org.apache.hadoop.fs.Path(folder, "_whole")
        out = store.create(draft, True)
        try:
            if header is not None:
                out.write(bytearray(f"{header}\n".encode()))
            parts = sorted((s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
            for p in parts:
                source = store.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
        finally:
            out.close()
        store.delete(target, False)
        if not store.rename(draft, target):
            raise OSError(f"can't write {path}")
        # Local stores put a checksum beside each file, which other programs' changes to the file would make wrong.
        store.delete(jvm.org.apache.hadoop.fs.Path(parent, f".{target.getName()}.crc"), False)
    finally:
        store.delete(folder, True)


def write_lexicon(words: DataFrame, path: str) -> None:
    """A lexicon as one tab-separated file with a header, floats with six decimals, in the order of frequency and word."""
    names = ("word", "freq", "pmi", "entropy", "pos_prob", "pos")
    line = F.concat_ws("\t", *[six_decimals(F.col(n)) if n in ("pmi", "entropy", "pos_prob") else F.col(n).cast("string") for n in names])
    _one_file(words.orderBy(F.col("freq").desc(), "word").select(line.alias("value")), path, "\t".join(names))


def write_statistics(stats: DataFrame, path: str) -> int:
    """word, freq, entropy (six decimals) as one file by word, without a header; the number of rows."""
    line = F.concat_ws("\t", "word", F.col("freq").cast("string"), six_decimals(F.col("entropy")))
    seen = Observation()
    _one_file(stats.orderBy("word").select(line.alias("value")).observe(seen, F.count(F.lit(1)).alias("rows")), path, None)
    return seen.get["rows"]


def write_ngrams(grams: DataFrame, folder: str, side: str = "r", counted: bool = False) -> None:
    """word and neighbour, as a folder of files: a line for each occurrence, or, if counted, a line for each row, with its c as third field.

    Lines for each occurrence take many times the room of the text; counted ones grow with the distinct pairs only.
    """
    if counted:
        grams.select(F.concat_ws("\t", "word", side, F.col("c").cast("string")).alias("value")).write.mode("overwrite").text(folder)
        return
    every = grams.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    every.select(F.concat_ws("\t", "word", side).alias("value")).write.mode("overwrite").text(folder)


def single_session(name: str = "lexmill", memory_mb: int | None = None, workers: int | None = None) -> SparkSession:
    """The running session, or a local one of so many threads and so much memory."""
    if active := SparkSession.getActiveSession():
        return active
    builder = SparkSession.builder.appName(name).config("spark.ui.enabled", "false")
    if "SPARK_MASTER" not in os.environ and not os.environ.get("PYSPARK_SUBMIT_ARGS"):
        builder = builder.master(f"local[{workers or '*'}]")
    if memory_mb:
        builder = builder.config("spark.driver.memory", f"{memory_mb}m")
    return builder.getOrCreate()
