"""What several operators share: reading tables, scratch tables, checked broadcasts."""

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage is cut, and each row is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(drop_scratch, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this driver, which are of no use after the results that read them are written; at the driver's end at the latest."""
    while _written:
        name = _written.pop()
        with contextlib.suppress(Exception):  # the session may be gone by now
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_plain(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def key_of(id_col: str, text_col: str) -> list:
    """A document's key: its id as whole_id() gives it, and h, a hash of its text."""
    return [*whole_id(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")]


def whole_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document's key, and row: all of its columns, so that no name can clash with those of an operator."""
    return docs.select(*key_of(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def whole_id(id_col: str) -> list:
    """An id as two columns without nulls, id and none: pandas would turn longs beside nulls into doubles."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("none")]


def restored_id():
    return F.when(~F.col("none"), F.col("id"))
