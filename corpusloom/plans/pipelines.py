"""The composite pipelines: ingest, search, compact, display, assemble."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import est_tokens
from ..functions.vectors import hash_embedding
from ..operators import chunking, history, models, retrieval, tables
from ..sources import files as sources
from ..staging import staged
from ..streaming import assembly


def ingest(docs: DataFrame, cache: DataFrame, model: str = "hash", call: Callable | None = None, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents, chunks, vectors, postings, stats and cache of docs (kb_id, doc_id, text, created). Copies within a base are not chunked, nor
    are copies of what stands in existing (documents of earlier runs); documents without text, or with an error if docs have that
    column, have the status failed. Chunks and vectors are staged, so each text is cut once and embedded once for all tables."""
    docs = docs if "error" in docs.columns else docs.withColumn("error", F.lit(None).cast("string"))
    docs = docs.withColumn("error", F.coalesce("error", F.when(F.coalesce(F.btrim("text"), F.lit("")) == "", "no text")))
    hashed = docs.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("ready"))
    known = tables.find_duplicates(hashed, existing).withColumn("status", F.when(F.col("status") == "failed", "failed").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("ready"))
    known = staged(known, "documents")
    chunks = staged(chunking.parent_child(known.filter("status = 'ready'")).withColumn("token_count", est_tokens(F.col("text"))), "chunks")
    leaves, grown = models.embed(chunks.filter("parent_id IS NOT NULL"), cache, model, call)
    texts = chunks.filter("parent_id IS NOT NULL").select("kb_id", "chunk_id", "text")
    counts = chunks.groupBy("kb_id", "doc_id").agg(F.count_if(F.col("parent_id").isNotNull()).alias("chunk_total"))
    return {"documents": known.join(counts, ["kb_id", "doc_id"], "left"), "chunks": chunks, "vectors": leaves.select("kb_id", "chunk_id", "embedding"), "postings": retrieval.postings(texts), "stats": retrieval.stats_of(texts), "cache": grown}


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = retrieval.FINAL_K, expand: Callable | None = None, reranker: Callable | None = None, floor: float = retrieval.FLOOR, embedder=hash_embedding, index: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """query_id, found_id, found_text, score, rank of each query (query_id, kb_id, query): vectors and phrases fused, reranked, lifted to parents.

    index and stats: the stored postings and trigram statistics of the leaves; without them they are made for this batch of queries."""
    asked = models.expand_queries(queries, expand).join(queries.select("query_id", "kb_id"), "query_id").withColumn("sub_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("query_no").cast("string")))
    asked = staged(asked, "asked")  # the model is asked once, though both routes need the answers
    leaves = chunks.filter("parent_id IS NOT NULL")
    embedded = staged(asked.select(F.col("sub_id").alias("query_id"), "kb_id", embedder(F.col("query")).alias("q")), "query-vectors")
    by_vector = retrieval.knn_join(embedded, vectors.withColumnRenamed("embedding", "v"))
    by_phrase = retrieval.phrase_topk(asked.select(F.col("sub_id").alias("query_id"), "kb_id", F.col("query").alias("phrase")), leaves.select("kb_id", "chunk_id", "text"), index=index, stats=stats)
    lists = by_vector.select("query_id", "chunk_id", "rank", "distance").unionByName(by_phrase.select("query_id", "chunk_id", "rank", F.lit(None).cast("double").alias("distance")))
    lists = lists.withColumnRenamed("query_id", "sub_id").join(asked.select("sub_id", "query_id", "query_no"), "sub_id")
    fused = retrieval.hydrate(retrieval.fused_topk(retrieval.rrf(lists)), leaves).join(queries.select("query_id", "query"), "query_id")
    if reranker is None:
        ranked = fused.withColumn("relevance", F.lit(None).cast("double")).withColumn("reranked", F.lit(False))
    else:
        ranked = models.rerank(fused, reranker)
    found = retrieval.final_topk(retrieval.parent_lookup(ranked, chunks), k)
    scored = found.withColumn("score", retrieval.score_case(F.col("relevance"), F.col("reranked"), F.col("distance")))
    return retrieval.similarity_threshold(scored, floor).select("query_id", "found_id", "found_text", "score", "rank")


def compact(messages: DataFrame, window: int, keep: int, call: Callable[[str], str]) -> DataFrame:
    """Sessions that fill 60 % of their window: old tool output pruned, the head summarised into one row."""
    due = history.window_usage(history.history_tokens(messages), window).filter("due").select("session_id")
    pruned = history.prune_history(messages, window).withColumn("text", F.col("new_text")).drop("new_text", "pruned")
    rows = pruned.withColumn("has_calls", F.coalesce(F.col("has_calls"), F.lit(False)) if "has_calls" in messages.columns else F.lit(False))
    cuts = history.split_head_tail(rows.join(due, "session_id", "left_semi"), keep)
    numbered = rows.withColumn("_i", F.row_number().over(history.session_window()) - 1)
    heads = numbered.join(cuts.filter("head_end < n"), "session_id").filter("_i < head_end")
    return history.compact_prefix(rows, cuts, models.summarise(heads.select("session_id", "seq", "role", "text"), call))


def display(messages: DataFrame) -> DataFrame:
    """Rows to show: calls beside their results with a stable id and readable arguments, other rows as they are, in order. messages: session_id, seq, role, text, tool_calls, tool_call_id; tool_calls may be its JSON text."""
    if dict(messages.dtypes)["tool_calls"] == "string":
        messages = messages.withColumn("tool_calls", tx.parse_tool_calls(F.col("tool_calls")))
    rows = history.pair_tool_results(messages)
    call = F.col("kind") == "call"
    shown = rows.withColumn("display_id", F.when(call, tx.stable_display_id(F.concat_ws("-", "session_id", "seq"), F.col("call_id")))).withColumn("text", F.when(call, tx.display_tool_args(F.col("text"))).otherwise(F.col("text")))
    return shown.orderBy("session_id", "seq", "call_no")


def assemble(frames: DataFrame, late: str = "10 seconds", idle_ms: int | None = None) -> DataFrame:
    """Rows (assembly.ROW) of frames (value): assistant turns with their calls, tool rows, and a row for each ended run with its usage and rate.

    A stream gives them in append mode as its watermark passes (assembly.write_rows stores them); a table gives those of the whole log."""
    events = assembly.frame_events(frames)
    return assembly.assemble_stream(events, late, idle_ms) if frames.isStreaming else assembly.assemble_batch(events)


def extract(files: DataFrame, describe: Callable[[bytes], str] | None = None, image_cache: DataFrame | None = None, model: str = "image") -> DataFrame:
    """path, text and error of files (path, content) of mixed formats: Word documents with their images described at their places, workbooks
    as Markdown tables, plain text and Markdown as they are. What can't be read is a row with an error and no text.

    files should be a stored table: each format reads its own rows of it."""
    kind = tx.route_parser(F.lit(""), F.element_at(F.split("path", "/"), -1))
    typed = files.select("path", "content", kind.alias("kind"))
    plain = typed.filter("kind IN ('md', 'txt')").select("path", sources.text_of(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    other = typed.filter("kind NOT IN ('md', 'txt', 'docx', 'xlsx')").select("path", F.lit("").alias("text"), F.concat(F.lit("no reader for "), "kind").alias("error"))
    word = staged(sources.extract_docx(typed.filter("kind = 'docx'")), "word-texts")
    images = word.select(F.col("path").alias("doc_id"), F.explode("images").alias("i")).select("doc_id", "i.idx", "i.data")
    if describe is None:
        described = images.select("doc_id", "idx", F.lit("").alias("description"))
    else:
        cache = image_cache if image_cache is not None else files.sparkSession.createDataFrame([], "model string, image_hash string, desc_text string")
        described = models.describe_images(images, cache, model, describe)[0].select("doc_id", "idx", "description")
    filled = sources.fill_placeholders(word.select(F.col("path").alias("doc_id"), "text"), described).withColumnRenamed("doc_id", "path")
    word = word.select("path", "error").join(filled, "path").select("path", "text", "error")
    rows = staged(sources.extract_xlsx(typed.filter("kind = 'xlsx'")), "sheet-rows")
    broken = rows.filter("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))
    sheets = typed.filter("kind = 'xlsx'").select("path").join(broken, "path", "left").join(sources.markdown_table(rows), "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"), "error")
    return plain.unionByName(other).unionByName(word).unionByName(sheets)


STORED = {
    "raw": "kb_id string, doc_id string, path string, created timestamp, content binary, batch long",
    "control": "kb_id string, doc_id string, paused boolean, at timestamp",
    "documents": "kb_id string, doc_id string, content_hash string, status string, error string, created timestamp, duplicate_of string, chunk_total long, batch long",
    "chunks": "kb_id string, doc_id string, chunk_id string, parent_id string, kind string, ordinal int, text string, token_count long, batch long",
    "vectors": "kb_id string, chunk_id string, embedding array<double>, batch long",
    "postings": f"{retrieval.POSTINGS}, batch long",
    "stats": "kb_id string, n_chunks long, sum_len long, batch long",
    "progress": "kb_id string, doc_id string, chunk_done long, chunk_total long, batch long",
    "cache": "model string, text_hash string, embedding array<double>, batch long",
}


def stored(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of an ingest's target, or no rows where it hasn't been written yet."""
    try:
        return spark.read.schema(STORED[name]).parquet(f"{target}/{name}")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED[name])


def put(rows: DataFrame, target: str, name: str, batch: int, mode: str = "overwrite") -> None:
    """rows as the batch's folder of a table."""
    kinds = dict(c.split(maxsplit=1) for c in STORED[name].split(", ") if not c.startswith("batch "))
    rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).write.mode(mode).parquet(f"{target}/{name}/batch={batch}")


def ingest_batch(files: DataFrame, target: str, kb_id: str, batch: int, model: str = "hash", call: Callable | None = None, describe: Callable | None = None) -> None:
    """Files (path, modificationTime, content) to the tables under target, one folder a batch in each.

    Raw files are stored first: from then on a document is processing, and can be resumed. Its row in documents is written last, so
    what has one is whole. A batch that runs again, after any of its writes, writes the same folders; what its first run embedded is in
    the cache by then and isn't embedded again. Documents that are paused, or that another batch has finished, are left out."""
    spark = files.sparkSession
    ident = F.sha2(F.col("path").cast("binary"), 256)
    raw = files.select(F.lit(kb_id).alias("kb_id"), ident.alias("doc_id"), "path", F.col("modificationTime").alias("created"), "content")
    if batch >= 0:  # a resumed document's file is stored already
        put(raw, target, "raw", batch)
        raw = stored(spark, target, "raw").filter(F.col("batch") == batch).drop("batch")
    others = stored(spark, target, "documents").filter(F.col("batch") != batch)
    paused = control_states(spark, target).filter("paused").select("kb_id", "doc_id")
    go = raw.join(others.select("kb_id", "doc_id"), ["kb_id", "doc_id"], "left_anti").join(paused, ["kb_id", "doc_id"], "left_anti")
    go = staged(go, "files")
    docs = go.drop("content").join(extract(go, describe), "path").drop("path")
    cache = stored(spark, target, "cache").drop("batch")
    made = ingest(docs, cache, model, call, others)
    new = made["cache"].join(cache.select("model", "text_hash"), ["model", "text_hash"], "left_anti")
    put(staged(new, "new-vectors"), target, "cache", batch, "append")
    done = made["documents"].select("kb_id", "doc_id", F.coalesce("chunk_total", F.lit(0)).alias("chunk_total"))
    put(done.withColumn("chunk_done", F.lit(0)), target, "progress", batch)
    for name in ("chunks", "vectors", "postings", "stats"):
        put(made[name], target, name, batch)
    put(done.withColumn("chunk_done", F.col("chunk_total")), target, "progress", batch)
    put(made["documents"], target, "documents", batch)


def incremental_ingest(files: DataFrame, target: str, checkpoint: str, kb_id: str, model: str = "hash", call: Callable | None = None, describe: Callable | None = None):
    """New files of a stream (binaryFile) to the tables under target, by ingest_batch. The checkpoint says which files are new; maxFilesPerTrigger is the throttle."""

    def batch(rows: DataFrame, number: int) -> None:
        ingest_batch(rows, target, kb_id, number, model, call, describe)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def control_states(spark: SparkSession, target: str) -> DataFrame:
    """kb_id, doc_id and paused: the last word on each document."""
    return stored(spark, target, "control").groupBy("kb_id", "doc_id").agg(F.max_by("paused", "at").alias("paused"))


def set_paused(docs: DataFrame, target: str, paused: bool = True) -> None:
    """Pauses documents (kb_id, doc_id), or lets them go on; they are left out of batches, and resumed by resume_ingest."""
    docs.select("kb_id", "doc_id", F.lit(paused).alias("paused"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{target}/control")


def document_states(spark: SparkSession, target: str) -> DataFrame:
    """kb_id, doc_id, raw_path, status, chunk_done and chunk_total of every document that was ever given; ingest_progress sums them up."""
    keys = ["kb_id", "doc_id"]
    given = stored(spark, target, "raw").groupBy(*keys).agg(F.max_by("path", "batch").alias("raw_path"))
    ended = stored(spark, target, "documents").groupBy(*keys).agg(F.max_by("status", "batch").alias("ended"))
    progress = stored(spark, target, "progress").groupBy(*keys).agg(F.max("chunk_done").alias("chunk_done"), F.max("chunk_total").alias("chunk_total"))
    known = given.join(ended, keys, "left").join(control_states(spark, target), keys, "left").join(progress, keys, "left")
    status = F.coalesce("ended", F.when(F.coalesce("paused", F.lit(False)), "paused").otherwise("processing"))
    return known.select(*keys, "raw_path", status.alias("status"), F.coalesce("chunk_done", F.lit(0)).alias("chunk_done"), F.coalesce("chunk_total", F.lit(0)).alias("chunk_total"))


def resume_ingest(spark: SparkSession, target: str, kb_id: str, model: str = "hash", call: Callable | None = None, describe: Callable | None = None) -> None:
    """Documents that are still in processing, as after a crash or a pause that was lifted, are ingested from their stored files as a batch of their own."""
    due = tables.processing_docs(document_states(spark, target).filter(F.col("kb_id") == kb_id)).filter("status = 'processing'").select("kb_id", "doc_id")
    files = stored(spark, target, "raw").join(due, ["kb_id", "doc_id"], "left_semi").select("path", F.col("created").alias("modificationTime"), "content")
    files = staged(files.dropDuplicates(["path"]), "resumed-files")
    if files.isEmpty():
        return
    # Batches of a stream count up from 0, those of resumes down from -1.
    least = stored(spark, target, "documents").agg(F.min("batch")).first()[0]
    ingest_batch(files, target, kb_id, min(0, least if least is not None else 0) - 1, model, call, describe)


def rebuild_documents(docs: DataFrame, tables_: dict[str, DataFrame], cache: DataFrame, model: str = "hash", call: Callable | None = None) -> dict[str, DataFrame]:
    """The tables of an ingest (documents, chunks, vectors, postings, stats) with docs (kb_id, doc_id, text, created) made anew: what they had is cleared first, then they are ingested from zero."""
    again = docs.select("kb_id", "doc_id")
    gone = staged(tables_["chunks"].join(again, ["kb_id", "doc_id"], "left_semi").select("kb_id", "chunk_id", "parent_id", "text"), "cleared-chunks")
    rest = {name: tables.exclude(tables_[name], again, ["kb_id", "doc_id"]) for name in ("documents", "chunks")}
    rest["vectors"] = tables.exclude(tables_["vectors"], gone, ["kb_id", "chunk_id"])
    rest["postings"] = retrieval.without_chunks(tables_["postings"], gone.filter("parent_id IS NOT NULL"))
    minus = retrieval.stats_of(gone.filter("parent_id IS NOT NULL")).select("kb_id", (-F.col("n_chunks")).alias("n_chunks"), (-F.col("sum_len")).alias("sum_len"))
    rest["stats"] = tables_["stats"].unionByName(minus, allowMissingColumns=True)
    made = ingest(docs, cache, model, call, rest["documents"])
    return {name: rest[name].unionByName(made[name], allowMissingColumns=True) for name in rest} | {"cache": made["cache"]}
