"""Intermediate tables in the folder that driver and executors share.

They are Parquet folders below ``spark.checkpoint.dir``, in a folder of their application,
so a lost executor costs a re-read and no recomputation, and every executor and the driver
see the same rows. What an operator reads no more it drops itself; the rest goes when the
driver ends, or by ``clear_scratch``; what a killed driver left goes by ``sweep_scratch``.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tarnfield-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def store_of(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Paths of the scratch tables made so far, in turn.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which is deleted when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/tarnfield/{spark.sparkContext.applicationId}"
    at, store = store_of(spark, own)
    if not store.exists(at):
        store.mkdirs(at)
        store.deleteOnExit(at)  # of what doesn't exist this would take no note
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    at, store = store_of(spark, path)
    store.delete(at, True)


def drop_scratch(*tables: DataFrame) -> None:
    """Remove the scratch tables behind frames that ``scratch`` returned and nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df._scratch)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application: results that read them must have been written."""
    drop_path(spark, f"{shared_dir(spark)}/tarnfield/{spark.sparkContext.applicationId}")


def sweep_scratch(spark: SparkSession, hours: float = 72) -> list[str]:
    """Remove what other applications left and haven't touched for so many hours; returns their ids."""
    at, store = store_of(spark, f"{shared_dir(spark)}/tarnfield")
    old = []
    for entry in store.listStatus(at) if store.exists(at) else ():
        own = [entry.getModificationTime(), *(x.getModificationTime() for x in store.listStatus(entry.getPath()))]
        name = entry.getPath().getName()
        if name != spark.sparkContext.applicationId and max(own) < (time.time() - hours * 3600) * 1000:
            store.delete(entry.getPath(), True)
            old.append(name)
    return old


#: A table of narrow rows gets a file for each so many.
FILE_ROWS = 1 << 16


def scratch(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    Where the caller knows how many rows of a few numbers there are at most, files follow
    the rows and not the shuffle partitions: each file costs a commit and, on a local
    folder without Hadoop's native library, two child processes that set its permissions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Writes what ``make`` returns and drops the scratch tables that it has made on the way."""
    before = len(_made)
    kept = scratch(make(), name)
    for path in _made[before:]:
        if path != kept._scratch:
            drop_path(spark, path)
    _made[before:] = [kept._scratch]
    return kept
