"""Model calls as pluggable functions in Arrow batches: embedding behind a cache, image descriptions, questions and answers,
query expansion, reranking, summaries, titles. Each call is retried in its task; Spark's own retry is for lost executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fallback_title, parse_qa_lines, parse_subqueries, sanitize_title
from ..functions.vectors import hash_embedding
from ..staging import staged
from . import retrieval, tables

BATCH, RETRIES, WAIT = 64, 3, 0.5


class ModelError(Exception):
    """A failed call with the status that the service gave."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def with_retry(call: Callable, attempts: int = RETRIES, wait: float = WAIT) -> Callable:
    """call, tried again after 429 and 5xx, waiting twice as long each time."""

    def tried(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except ModelError as e:
                if n + 1 == attempts or not (e.status == 429 or e.status >= 500):
                    raise
                time.sleep(wait * 2**n)

    return tried


def answer_column(rows: DataFrame, column: str, call: Callable[[str], str], out: str = "response") -> DataFrame:
    """rows with the model's answer to a column; a failing call gives null."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"`{out}` string"])

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tried = with_retry(call)

        def safe(value):
            try:
                return tried(value)
            except ModelError:
                return None

        for p in parts:
            yield p.assign(**{out: [safe(v) for v in p[column]]})

    return rows.mapInPandas(ask, schema)


def embed(rows: DataFrame, cache: DataFrame, model: str, call: Callable[[list[str]], list[list[float]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (text) with embedding, and the cache with what was new. Equal texts are embedded once; without a call the hashing embedder is used.

    What is new is staged, so the model is called once for it, whatever reads the two results."""
    hashed = rows.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("model", F.lit(model))
    new = tables.cache_misses(hashed.select("model", "text_hash", "text").dropDuplicates(["text_hash"]), cache)
    if call is None:
        made = new.select("model", "text_hash", hash_embedding(F.col("text")).alias("embedding"))
    else:

        def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tried = with_retry(call)
            for p in parts:
                for at in range(0, len(p), BATCH):
                    batch = p.iloc[at : at + BATCH]
                    vectors = tried(batch["text"].tolist())
                    if len(vectors) != len(batch) or not all(len(v) for v in vectors):
                        raise ValueError(f"{len(batch)} texts, {len(vectors)} vectors")
                    yield pd.DataFrame({"model": batch["model"], "text_hash": batch["text_hash"], "embedding": vectors})

        made = new.mapInPandas(ask, "model string, text_hash string, embedding array<double>")
    whole = tables.usable_cache(cache).select("model", "text_hash", "embedding").unionByName(staged(made, "embedded"))
    return hashed.join(whole, ["model", "text_hash"], "left"), whole


def describe_images(images: DataFrame, cache: DataFrame, model: str, call: Callable[[bytes], str]) -> tuple[DataFrame, DataFrame]:
    """images (doc_id, idx, data) with description, and the grown cache; a failure is an empty description."""
    hashed = images.withColumn("image_hash", F.sha2("data", 256)).withColumn("model", F.lit(model))
    new = hashed.select("model", "image_hash", "data").dropDuplicates(["image_hash"]).join(cache.select("model", "image_hash"), ["model", "image_hash"], "left_anti")
    made = staged(answer_column(new, "data", call, "desc_text").drop("data"), "described")
    whole = cache.select("model", "image_hash", "desc_text").unionByName(made.filter(F.coalesce("desc_text", F.lit("")) != ""))
    return hashed.join(whole, ["model", "image_hash"], "left").withColumn("description", F.coalesce("desc_text", F.lit(""))).drop("desc_text"), whole


def qa_index(parents: DataFrame, call: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """Leaves (chunk_id, question, text) of question and answer for each parent, and the parents that got none."""
    asked = staged(answer_column(parents.select("chunk_id", "text"), "text", call), "answers")
    pairs = asked.select(F.col("chunk_id").alias("parent_id"), F.posexplode(parse_qa_lines(F.col("response"))).alias("no", "pair"))
    leaves = pairs.select("parent_id", "no", F.col("pair.question").alias("question"), F.concat("pair.question", F.lit("\n"), "pair.answer").alias("text"), F.lit("qa").alias("kind"))
    return leaves, parents.join(leaves.select(F.col("parent_id").alias("chunk_id")), "chunk_id", "left_anti")


def summary_index(parents: DataFrame, call: Callable[[str], str]) -> DataFrame:
    asked = answer_column(parents, "text", call)
    return asked.filter(F.btrim(F.coalesce("response", F.lit(""))) != "").select(F.col("chunk_id").alias("parent_id"), F.btrim("response").alias("text"), F.lit("summary").alias("kind"))


def expand_queries(queries: DataFrame, call: Callable[[str], str] | None = None) -> DataFrame:
    """query_id, query_no, query: the query itself as 0, and at most two others; a failing call adds none."""
    own = queries.select("query_id", F.lit(0).alias("query_no"), "query")
    if call is None:
        return own
    more = answer_column(queries.select("query_id", "query"), "query", call)
    found = more.select("query_id", F.posexplode(parse_subqueries(F.coalesce("response", F.lit("")), F.col("query"))).alias("no", "sub"))
    return own.unionByName(found.select("query_id", (F.col("no") + 1).alias("query_no"), F.col("sub").alias("query")))


def rerank(candidates: DataFrame, call: Callable[[str, list[str]], list[tuple[int, float]]]) -> DataFrame:
    """candidates (query_id, query, chunk_id, rank, text) in the order of the model's scores; at most 20 candidates a query."""

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        try:
            scored = with_retry(call)(part["query"].iloc[0], part["text"].tolist())
        except ModelError:
            scored = []
        rows = [(part["query_id"].iloc[0], i, float(s)) for i, s in scored if 0 <= i < len(part)]
        return pd.DataFrame(rows, columns=["query_id", "idx", "relevance"])

    scores = candidates.groupBy("query_id").applyInPandas(ask, "query_id long, idx int, relevance double")
    return retrieval.rerank_merge(candidates, scores)


def summarise(heads: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """session_id and summary of the rows (session_id, seq, role, text) to be summarised; null where the call failed."""
    line = F.concat("role", F.lit(": "), "text")
    joined = heads.groupBy("session_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])).alias("prompt"))
    return answer_column(joined, "prompt", call, "summary").select("session_id", "summary")


def title(first: DataFrame, call: Callable[[str], str]) -> DataFrame:
    asked = answer_column(first, "text", call)
    return asked.select("session_id", F.coalesce(F.nullif(sanitize_title(F.col("response")), F.lit("")), fallback_title(F.col("text"))).alias("title"))
