"""Staged tables: a result that is used twice is written to the folder that all executors share and read back, so each row is computed
once (a model is called once), lineage is cut, and a lost executor costs a task. And broadcasts behind a check of their size."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of bytes that a checked broadcast may hold.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Batches of rows for Python end at so many bytes, as texts may be long; a smaller limit of the session's own stays."""
    if _bytes(spark.conf.get(BATCH_BYTES)) > _bytes(size):
        spark.conf.set(BATCH_BYTES, size)


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


_written: list[str] = []


def staged_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; what is written there goes with the staged tables."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_staged, spark)
    _written.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back."""
    path = staged_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Deletes the staged tables of this driver but for the first since ones. They are of no use after the results that read
    them are written; at the driver's end they go at the latest."""
    while len(_written) > since:
        name = _written.pop()
        with contextlib.suppress(Exception):  # the session may be gone by now
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """What is staged inside is deleted on leaving, for drivers that run for long: write the result inside."""
    since = len(_written)
    try:
        yield
    finally:
        drop_staged(spark, since)


def small_or_plain(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
