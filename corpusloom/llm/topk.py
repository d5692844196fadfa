"""Exact top-k search by distributed histogram selection.

All queries are scored against all candidates in blocks. Each round every pair of blocks scores its rows and emits
a histogram of the scores around each query's k-th value; the histograms are summed over all blocks and the bin that
holds the k-th value becomes the next round's range, until a bin is one integer wide. Then the k-th value of each
query is known exactly: all rows above it are kept, and ties at it are broken by the smaller id. A block's own k best
rows bound what it can add to the global k best, so a block emits k histogram entries and at most k ties a query.

Scores are integer inner products of floor(scale * x), exact at any size: float64 where every sum stays below 2**53,
else Python integers (a score beyond 64 bits is returned as the nearest long). Rows without a vector, or with a null or
non-finite component, or without an id take no part; vectors of another length than the query's are no candidates of
it. Fewer candidates than k: all are returned. Queries and candidates are rows: of those that share an id each is a query and each is ranked,
and a query's own row is one candidate equal to it in id and vector. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table

BLOCK_ROWS, QUERY_ROWS, BINS = 8192, 2048, 1024
LONG = 2**63 - 1


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, dim and components as whole doubles, of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & fine & (F.size(vec_col) > 0))
    # floor() of a double is a long and would wrap beyond 64 bits; doubles from 2**52 on are whole already.
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return usable.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), whole.alias("v"))


def _matrix(ids: bytes, m: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a block, which holds int16 or float64."""
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(m, "<i2" if len(m) == 2 * dim * len(i) else "<f8").reshape(len(i), dim).astype("f8")


def pack_blocks(rows: DataFrame, block_rows: int, n: int, key: str = "id") -> DataFrame:
    """One row for each block: dim, block, keys, ids and matrix as bytes, in order of the key. Rows equal in id and vector stand in one block."""
    blocks = max(1, math.ceil(n / block_rows))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable")
        m = np.vstack(part["v"].to_numpy())
        m = m.astype("<i2") if np.abs(m).max() < 2**15 else m.astype("<f8")
        return pd.DataFrame({"dim": [int(part["dim"].iloc[0])], "block": [int(part["block"].iloc[0])], "keys": [part[key].to_numpy("<i8").tobytes()], "ids": [part["id"].to_numpy("<i8").tobytes()], "m": [m.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, keys binary, ids binary, m binary")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: float64, or Python integers where a partial sum could pass 2**53."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] >= 2**53:
        as_int = np.vectorize(int, otypes=[object])
        return as_int(q) @ as_int(c).T
    return q @ c.T


def _best(scores: np.ndarray, k: int) -> list[int]:
    if scores.dtype == object or len(scores) <= k:
        return sorted(map(int, scores), reverse=True)[:k]
    return np.partition(scores, len(scores) - k)[-k:].astype("i8").tolist()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of highest score for each query row, its own row left out."""
    spark = queries.sparkSession
    # Equal query rows have equal results. The numbers (no) are read from the table, so they stay.
    one = quantise(queries, id_col, vec_col, scale).groupBy("id", "dim", "v").agg(F.count("*").alias("copies"))
    q_rows, c_rows = scratch(one.select(F.monotonically_increasing_id().alias("no"), "*"), "topk-q"), scratch(quantise(candidates, id_col, vec_col, scale), "topk-c")
    norm = F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")
    q_n, (c_n, reach) = q_rows.count(), c_rows.agg(F.count("*"), F.max(norm)).first()
    if not q_n or not c_n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_blocks, c_blocks = scratch(pack_blocks(q_rows, QUERY_ROWS, q_n, "no"), "topk-qb"), scratch(pack_blocks(c_rows, BLOCK_ROWS, c_n), "topk-cb")
    # Only block numbers are gathered, one for each block of vectors.
    q_of, c_of = (b.groupBy("dim").agg(F.collect_set("block").alias("others")) for b in (q_blocks, c_blocks))
    c_all = c_blocks.join(q_of, "dim").select("dim", F.explode("others").alias("qb"), F.col("block").alias("cb"), "ids", "m")

    # A query's range: |score| is at most the product of the norms. Whole numbers are strings here, as they may pass 64 bits.
    state_schema = "no long, dim int, qb int, lo string, span string, above int"
    q_count = max(1, math.ceil(q_n / QUERY_ROWS))

    def first_range(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            top = [int(x * reach * 1.000001) + 1 for x in p["norm"]]
            yield p[["no", "dim", "qb"]].assign(lo=[str(-t) for t in top], span=[str(2 * t + 1) for t in top], above=0)

    state = scratch(q_rows.select("no", "dim", F.pmod(F.xxhash64("id", "v"), F.lit(q_count)).cast("int").alias("qb"), norm.alias("norm")).mapInPandas(first_range, state_schema), "topk-range")
    widest = 2 * int(float(q_rows.agg(F.max(norm)).first()[0]) * reach * 1.000001) + 3

    def over_pairs(state: DataFrame, found, schema: str) -> DataFrame:
        """found(numbers of the queries, their ranges, ids of the candidates, scores, for each query the place of its own row or -1) for each query block beside each candidate block."""
        ranges = state.groupBy("dim", "qb").agg(F.collect_list(F.struct("no", "lo", "span", "above")).alias("ranges"))
        q = q_blocks.withColumnRenamed("block", "qb").join(ranges, ["dim", "qb"]).join(c_of, "dim").select("dim", "qb", F.explode("others").alias("cb"), "keys", "ids", "m", "ranges")
        names = [x.split()[0] for x in schema.split(", ")]

        def of_pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame([], columns=names)
            dim = int(left["dim"].iloc[0])
            qid, qm = _matrix(left["ids"].iloc[0], left["m"].iloc[0], dim)
            cid, cm = _matrix(right["ids"].iloc[0], right["m"].iloc[0], dim)
            own = [next((j for j in np.flatnonzero(cid == i).tolist() if (cm[j] == m).all()), -1) for i, m in zip(qid.tolist(), qm)]
            numbers = np.frombuffer(left["keys"].iloc[0], "<i8")
            at = {x["no"]: (int(x["lo"]), int(x["span"]), int(x["above"])) for x in left["ranges"].iloc[0]}
            return pd.DataFrame(found(numbers, at, cid, _scores(qm, cm), own), columns=names)

        return q.groupBy("dim", "qb", "cb").cogroup(c_all.groupBy("dim", "qb", "cb")).applyInPandas(of_pair, schema)

    def histogram(numbers, at, cid, s, own):
        for i, q in enumerate(numbers.tolist()):
            lo, span, _ = at[q]
            width, bins = -(-span // BINS), {}
            for v in _best(s[i] if own[i] < 0 else np.delete(s[i], own[i]), k):
                if lo <= v < lo + span:
                    bins[(v - lo) // width] = bins.get((v - lo) // width, 0) + 1
            yield from ((q, b, n) for b, n in bins.items())

    def narrowed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The range becomes the bin with the k-th value (chosen), of whose rows more lie higher; a query without a filled bin keeps its range."""
        for p in parts:
            out = []
            for x in p.to_dict("records"):
                lo, span, width = int(x["lo"]), int(x["span"]), -(-int(x["span"]) // BINS)
                if x["chosen"] >= 0:
                    start = int(x["chosen"]) * width
                    lo, span = lo + start, min(width, span - start)
                out.append((x["no"], x["dim"], x["qb"], str(lo), str(span), x["above"] + x["more"]))
            yield pd.DataFrame(out, columns=["no", "dim", "qb", "lo", "span", "above"])

    downwards = Window.partitionBy("no").orderBy(F.col("bin").desc())
    while widest > 1:
        sums = over_pairs(state, histogram, "no long, bin long, n long").groupBy("no", "bin").agg(F.sum("n").alias("n"))
        # The highest bin up to which k rows are reached; the lowest filled one where there are fewer rows.
        reached = sums.join(state.select("no", "above"), "no").withColumn("upto", F.sum("n").over(downwards)).withColumn("enough", F.col("above") + F.col("upto") >= k)
        chosen = reached.groupBy("no").agg(F.coalesce(F.max(F.when(F.col("enough"), F.col("bin"))), F.min("bin")).alias("chosen"))
        higher = sums.join(chosen, "no").groupBy("no", "chosen").agg(F.sum(F.when(F.col("bin") > F.col("chosen"), F.col("n")).otherwise(0)).alias("more"))
        told = state.join(higher, "no", "left").select("no", "dim", "qb", "lo", "span", "above", F.coalesce("chosen", F.lit(-1)).alias("chosen"), F.coalesce("more", F.lit(0)).alias("more"))
        state = scratch(told.mapInPandas(narrowed, state_schema), "topk-range")
        widest = -(-widest // BINS)

    def winners(numbers, at, cid, s, own):
        """Rows above the k-th value, and the block's smallest ids at it: ids rise within a block. over: by how much the score is above it, and its number of digits."""
        for i, q in enumerate(numbers.tolist()):
            kth, _, above = at[q]
            other = np.arange(len(cid)) != own[i]
            for j in [*np.flatnonzero(other & (s[i] > kth)), *np.flatnonzero(other & (s[i] == kth))[: k - above]]:
                over = str(int(s[i][j]) - kth)
                yield q, cid[j], len(over), over, max(-LONG - 1, min(LONG, int(s[i][j])))

    best = over_pairs(state, winners, "no long, vec_id long, digits int, over string, score long")
    order = Window.partitionBy("no").orderBy(F.col("digits").desc(), F.col("over").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = ranked.join(q_rows.select("no", F.col("id").alias("query_id"), "copies"), "no")
    return named.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def op5_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors)
