"""Stored tables kept by key: rows lie in buckets of their key's hash, and a change rewrites only the buckets that its keys fall into.

A table is a Parquet folder partitioned by bucket. Its buckets are set when it is created; a bucket should fit a task, so a table of
100 TB has some hundred thousand. Keys are never null. Each bucket has a row without keys, so one that loses its last row is still written.
Changed buckets are staged first, as they are read from the table that they replace; Spark moves the new files in when all are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from . import tables

BUCKETS, BUCKET = 64, "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def _write(rows: DataFrame, numbers: DataFrame, path: str, mode: str) -> None:
    """rows (with their bucket) and a row without keys for each of the bucket numbers."""
    whole = rows.unionByName(numbers.select(BUCKET), allowMissingColumns=True)
    whole.repartition(F.col(BUCKET)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create_table(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table of rows, which have each key once."""
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias(BUCKET))
    _write(rows.withColumn(BUCKET, bucket_of(keys, buckets)), every, path, "errorifexists")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return _whole(spark, path).filter(F.col(keys[0]).isNotNull()).drop(BUCKET)


def _change(spark: SparkSession, path: str, keys: list[str], changes: DataFrame, merge) -> list[int]:
    """Replaces the buckets that changes fall into by merge(their rows, changes); the numbers of these buckets."""
    buckets = _whole(spark, path).select(BUCKET).distinct().count()
    new = staged(changes.withColumn(BUCKET, bucket_of(keys, buckets)), "table-changes")
    touched = staged(new.select(BUCKET).distinct(), "touched-buckets")
    numbers = sorted(r[0] for r in touched.collect())  # as many as the table has buckets at most
    if not numbers:
        return numbers
    # The numbers are in the filter, so files of other buckets aren't opened.
    old = _whole(spark, path).filter(F.col(BUCKET).isin(numbers)).filter(F.col(keys[0]).isNotNull())
    columns = [c for c in old.columns if c != BUCKET]
    merged = merge(old.select(*columns), new.drop(BUCKET)).select(*columns)
    _write(staged(merged.withColumn(BUCKET, bucket_of(keys, buckets)), "table-buckets"), touched, path, "overwrite")
    return numbers


def upsert(spark: SparkSession, path: str, keys: list[str], changes: DataFrame, order: list[Column]) -> list[int]:
    """Rows of changes replace those of equal keys; of several for a key the first in the given order."""
    winners = tables.upsert(changes, keys, order)
    return _change(spark, path, keys, winners, lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new))


def insert_ignore(spark: SparkSession, path: str, keys: list[str], changes: DataFrame, order: list[Column]) -> list[int]:
    """Rows whose key the table hasn't got are added: the first of equal ones in the given order."""
    return _change(spark, path, keys, changes, lambda old, new: tables.insert_ignore(old, new, keys, order))


def update(spark: SparkSession, path: str, key: str, changes: DataFrame, nulls_clear: bool = False) -> list[int]:
    """Values of changes (key once each) over those of the table; nulls keep the old value, or clear it with nulls_clear."""
    return _change(spark, path, [key], changes, lambda old, new: tables.apply_updates(old, new, key, nulls_clear))


def delete(spark: SparkSession, path: str, keys: list[str], gone: DataFrame) -> list[int]:
    return _change(spark, path, keys, gone.select(*keys).distinct(), lambda old, new: tables.exclude(old, new, keys))
