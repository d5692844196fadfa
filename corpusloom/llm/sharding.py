"""Feistel sharding: a keyed permutation of global row numbers gives each row its shard and slot.

Row numbers are counted without a global sort: rows are dealt to hash buckets of bounded size, each bucket is
ordered by the key columns, and a prefix sum over the bucket counts gives each bucket its first number. The number
depends on the rows alone, not on files, partitions or tasks. Rows equal in every key column are one aggregated
row with a count until they have their numbers, so any number of repetitions is one row in the shuffle.

Defined cases: null text has size 1 and checksum 0; null ids take part as a value of their own; rows equal in id
and text get different slots; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table

ROUNDS, BLOCK = 6, 4096


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as the Feistel round function."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def round_keys(seed: int) -> list[int]:
    return [int(_mix(np.array([r + 1], dtype=np.uint64), seed * 2654435761 % 2**63)[0]) for r in range(ROUNDS)]


def _pass(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        left, right = right, left ^ (_mix(right, k) & mask)
    return (left << np.uint64(half)) | right


def _unpass(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in reversed(keys):
        left, right = right ^ (_mix(left, k) & mask), left
    return (left << np.uint64(half)) | right


def _half_bits(n: int) -> int:
    return max(1, math.ceil(math.log2(max(n, 2)) / 2))


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The place of each of the row numbers 0..n-1 in a permutation of 0..n-1, by cycle walking in the next square power of two."""
    half, keys, step = _half_bits(n), round_keys(seed), _unpass if inverse else _pass
    out = step(numbers.astype(np.uint64), half, keys)
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = step(out[outside], half, keys)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int) -> int:
    """The row number in a shard's slot: a reader can compute any place without a lookup."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, inverse=True)[0])


def number_rows(df: DataFrame, keys: list[str], bucket_rows: int = 20_000, chunk: int = 10_000) -> tuple[DataFrame, int]:
    """Columns keys and row_no (0..n-1 without gaps), and n. Rows are ordered by a hash of the keys, then the keys."""
    groups = scratch(df.groupBy(*keys).agg(F.count("*").alias("_copies")), "shard-rows")
    n = int(groups.agg(F.sum("_copies")).first()[0] or 0)
    buckets = max(1, math.ceil(n / bucket_rows))
    dealt = groups.withColumn("_hash", F.xxhash64(*keys)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    # First numbers by two prefix sums: over the buckets of each block of BLOCK buckets, and over the blocks, of which there are n / (bucket_rows * BLOCK).
    totals = scratch(dealt.groupBy("_bucket").agg(F.sum("_copies").alias("_rows")).withColumn("_block", F.expr(f"_bucket div {BLOCK}")), "shard-buckets")
    before = lambda window: F.coalesce(F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("_block").agg(F.sum("_rows").alias("_rows")).select("_block", before(Window.orderBy("_block")).alias("_base"))
    first = totals.withColumn("_inner", before(Window.partitionBy("_block").orderBy("_bucket"))).join(blocks, "_block").select("_bucket", (F.col("_base") + F.col("_inner")).alias("_first"))
    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(first, "_bucket")
    start = F.col("_first") + F.col("_before")
    chunks = placed.select(*keys, start.alias("_start"), "_copies", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(chunk))).alias("_at"))
    upto = F.least(F.col("_at") + chunk, F.col("_copies")) - 1
    return chunks.select(*keys, "_start", F.explode(F.sequence(F.col("_at"), upto)).alias("_no")).select(*keys, (F.col("_start") + F.col("_no")).alias("row_no")), n


def feistel_shards(df: DataFrame, keys: list[str], n_shards: int = 8, seed: int = 20_240_601) -> DataFrame:
    """Columns keys, row_no, shard and slot. Shard sizes differ by one row at most; slots count from 0 in each shard."""
    numbered, n = number_rows(df, keys)

    @F.pandas_udf("long")
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), n, seed))

    at = numbered.withColumn("_place", place("row_no"))
    return at.select(*keys, "row_no", F.pmod("_place", F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"_place div {n_shards}").alias("slot"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = feistel_shards(docs, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
