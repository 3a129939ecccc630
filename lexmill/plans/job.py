"""Whole runs from files to a lexicon file, in stages that a later run may resume from."""

from __future__ import annotations

import json
import logging
import os
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexmill.config import ROOM_FACTOR, Settings
from lexmill.plans.lexicon import lexicon_of, merged, word_statistics
from lexmill.sources.files import TextFile, described, list_files, read_lines
from lexmill.sources.sinks import default_output, single_session, write_lexicon
from lexmill.sources.tables import installed_tags, position_table, tag_table
from lexmill.staging import delete, hadoop_path, shared_dir

log = logging.getLogger(__name__)
LARGE = 2 << 30


class Stages:
    """Parquet tables in a folder, each complete when its `_SUCCESS` is there, and the signature of what they rest on."""

    names = ("statistics", "merged")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def done(self, name: str) -> bool:
        store, found = hadoop_path(self.spark, f"{self._path(name)}/_SUCCESS")
        return store.exists(found)

    def made(self, name: str, df: DataFrame | None) -> DataFrame:
        """The stage's table; written first from `df` unless it is complete."""
        if not self.done(name):
            seen = Observation(name)
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(self._path(name))
            log.info("%s: %d rows", name, seen.get["rows"])
        return self.spark.read.parquet(self._path(name))

    def clear(self) -> None:
        """Delete the stages and the signature, and nothing else of the folder."""
        for name in (*self.names, "signature.json"):
            delete(self.spark, self._path(name))

    def signature(self) -> dict[str, Any] | None:
        store, found = hadoop_path(self.spark, self._path("signature.json"))
        if not store.exists(found):
            return None
        try:
            return json.loads("".join(r[0] for r in self.spark.read.text(self._path("signature.json")).collect()))
        except ValueError:
            return {}

    def sign(self, signature: dict[str, Any]) -> None:
        store, found = hadoop_path(self.spark, self._path("signature.json"))
        out = store.create(found, True)
        out.write(bytearray(json.dumps(signature).encode()))
        out.close()


def signature_of(input_path: str, files: list[TextFile], settings: Settings) -> dict[str, Any]:
    """What stages rest on. The thresholds of PMI and position aren't part of it, as the last step always runs."""
    path = input_path if "://" in input_path else os.path.abspath(input_path)
    return {"input": path, "files": [[f.path, f.size] for f in files], "max_len": settings.max_len, "min_freq": settings.min_freq, "entropy": settings.entropy}


def check_room(folder: str, total: int) -> None:
    """RuntimeError if a local folder's disk has less free than the intermediate data is likely to take."""
    local = folder.removeprefix("file://")
    if "://" in local:
        return
    while not os.path.exists(local):  # it may not be made yet
        local = os.path.dirname(local) or "."
    free = shutil.disk_usage(local).free
    if free < total * ROOM_FACTOR:
        raise RuntimeError(f"{folder} has room for {free >> 20} MiB, but a corpus of {total >> 20} MiB may need {total * ROOM_FACTOR >> 20} MiB there for its stages")


def run(
    input_path: str,
    output_path: str | None = None,
    settings: Settings = Settings(),
    positions: str | None = None,
    tags: str | None = None,
    temp_dir: str | None = None,
    work_dir: str | None = None,
    force: bool = False,
    spark: SparkSession | None = None,
    prune: bool = False,
) -> str:
    """The lexicon of a file or folder, written as one file; its path.

    With work_dir, finished stages stay there when a run fails, and the next run of the same input and parameters goes on
    from them; a run that ends well clears them, and force clears them first. Without it, stages are in temp_dir (or the
    shared folder) and always removed.
    """
    spark = spark or single_session()
    files = list_files(spark, input_path)
    total = sum(f.size for f in files)
    log.info("%d text files (%.1f GB)", len(files), total / 1e9)
    if total > LARGE:
        log.warning("more than 2 GB of input: this may take long")
    output_path = output_path or default_output(spark, input_path)
    if work_dir:
        if temp_dir:
            log.warning("temp_dir isn't used when work_dir is given")
        folder = work_dir if "://" in work_dir else os.path.abspath(work_dir)
        os.makedirs(folder, exist_ok=True) if "://" not in folder else None
    else:
        folder = tempfile.mkdtemp(prefix="lexmill-", dir=temp_dir) if temp_dir else f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    stages = Stages(spark, folder)
    try:
        check_room(folder if work_dir or temp_dir else shared_dir(spark), total)
        signature = signature_of(input_path, files, settings)
        if work_dir:
            before = stages.signature()
            if force or (before is not None and before != signature):
                if not force:
                    log.warning("input or parameters have changed: starting over")
                stages.clear()
            stages.sign(signature)
        stats = None
        if not stages.done("statistics"):
            lines = read_lines(spark, described(spark, input_path))
            stats = word_statistics(lines, "value", settings, prune=prune)
        stats = stages.made("statistics", stats)
        candidates = stages.made("merged", merged(stats, settings.entropy))
        table = tag_table(spark, tags) if tags else installed_tags(spark)
        words = lexicon_of(stats, settings, position_table(spark, positions), table, candidates=candidates)
        write_lexicon(words, output_path)
        if work_dir:
            stages.clear()
    finally:
        if not work_dir:
            delete(spark, folder)
    return output_path
