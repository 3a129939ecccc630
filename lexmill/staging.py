"""Tables in the folder that all executors share, to cut lineage where a result is read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application's staged tables.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir, which all executors see.

    Where that is unset, a temporary folder of a local session; RuntimeError elsewhere, as executors would write to their own disks.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        base = context.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="lexmill-")
        _folders[context.applicationId] = f"{base.rstrip('/')}/lexmill-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete_at_exit, context._jvm, _folders[context.applicationId])
    return _folders[context.applicationId]


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table of the shared folder and read again.

    It cuts the lineage: an executor's loss after it costs no recomputation, and readers that need only some columns
    read only those. The files stay until `dropped`, `release`, or the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables; no result that still rests on them may be read after."""
    for table in tables:
        if path := getattr(table, "_staged_at", None):
            delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this application; no result that rests on them may be read after."""
    delete(spark, shared_dir(spark))


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any store."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def delete(spark: SparkSession, path: str) -> None:
    store, found = hadoop_path(spark, path)
    store.delete(found, True)


def _delete_at_exit(jvm, path: str) -> None:
    try:
        found = jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(found, True)
    except Exception:  # the session's process may be gone already
        pass
