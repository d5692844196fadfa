"""The registered queries: the operators on the given tables, whole.

documents play the corpus (source is the knowledge base), embeddings the chunk vectors, conversations the messages (every
fourth assistant turn counts as a tool result), events the stream events, benchmark the phrase queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import hash_counts, hash_embedding, l2_distance
from ..operators import chunking, history, retrieval, stored, tables
from ..sources import files
from ..staging import staged, staged_path
from ..streaming import turns
from . import pipelines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "tool").otherwise(F.col("role"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), role.alias("role"), "text")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("kb_id"), "doc_id", "text")


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """documents with a status by doc_id."""
    k = F.col("doc_id") % 10
    status = F.when(k == 0, "processing").when(k == 1, "failed").when(k == 2, "paused").when(k == 3, "duplicate").otherwise("ready")
    return table(spark, d, "documents").select(F.col("source").alias("kb_id"), "doc_id", status.alias("status"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.col("doc_id").alias("created"), (F.col("n_chars") % 7).alias("chunk_done"), (F.col("n_chars") % 7 + F.col("doc_id") % 3).alias("chunk_total"))


def vector_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries: the vectors whose id is divisible by 100. Both sides have the label as their base."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("kb_id"), F.col("embedding").alias("v"))
    return vectors.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "kb_id", F.col("v").alias("q")), vectors


def near(spark: SparkSession, d: str, k: int) -> DataFrame:
    queries, vectors = vector_batch(spark, d)
    return retrieval.knn_join(queries, vectors, k)


def vector_topk(spark, d):
    return near(spark, d, 20).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


def vector_threshold(spark, d):
    hits = retrieval.similarity_threshold(retrieval.with_score(near(spark, d, 20)))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def phrase_queries(spark, d):
    """Every sentence of every item, in every base."""
    bases = table(spark, d, "documents").select(F.col("source").alias("kb_id")).distinct()
    phrases = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("no", "phrase")).withColumn("phrase", F.btrim("phrase"))
    return phrases.join(bases, F.lit(True)).select(F.concat_ws("/", "item_id", "no", "kb_id").alias("query_id"), "kb_id", "phrase")


def doc_chunks(spark, d):
    return corpus(spark, d).withColumnRenamed("doc_id", "chunk_id")


def phrase_match(spark, d):
    return retrieval.phrase_match(phrase_queries(spark, d), doc_chunks(spark, d)).select("query_id", "chunk_id", F.col("tf").cast("long").alias("tf"))


def phrase_bm25(spark, d):
    return retrieval.phrase_topk(phrase_queries(spark, d), doc_chunks(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def trigram_stats(spark, d):
    return retrieval.trigram_stats(doc_chunks(spark, d)).select("kb_id", "n_chunks", F.round("avg_len", 6).alias("avg_len"))


def id_route(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id and rank: the first k vectors of the query's base by (31 * chunk_id + query_id) modulo 97, then by id.

    That order is the same for all queries of a base with one remainder, and only the first k of each remainder of a base's vectors
    can come first; so no query meets all vectors."""
    rest = lambda x: F.pmod(x, F.lit(97))
    order = [F.col("o"), F.col("chunk_id")]
    first = retrieval.top_per(vectors.select("kb_id", "chunk_id", rest(F.col("chunk_id") * 31).alias("part")), ["kb_id", "part"], [F.col("chunk_id")], k)
    asked = queries.select("query_id", "kb_id", rest(F.col("query_id")).alias("rest"))
    met = first.join(asked.select("kb_id", "rest").distinct(), "kb_id").select("kb_id", "rest", "chunk_id", rest(F.col("part") + F.col("rest")).alias("o"))
    best = retrieval.top_per(met, ["kb_id", "rest"], order, k).drop("rank")
    return retrieval.top_per(best.join(asked, ["kb_id", "rest"]), ["query_id"], order, k)


def two_routes(spark, d):
    """A vector route, and a second one by the difference of ids modulo 97, in place of phrases on vectors."""
    queries, vectors = vector_batch(spark, d)
    first = retrieval.knn_join(queries, vectors, 20).select("query_id", F.lit(0).alias("query_no"), "chunk_id", "rank", "distance")
    second = id_route(queries, vectors, 20).select("query_id", F.lit(1).alias("query_no"), "chunk_id", "rank", F.lit(None).cast("double").alias("distance"))
    return first.unionByName(second)


def rrf_fusion(spark, d):
    return retrieval.fused_topk(retrieval.rrf(two_routes(spark, d))).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.round("distance", 6).alias("distance"), "rank")


def fake_relevance(fused: DataFrame) -> DataFrame:
    """Scores of a reranker that knows only ids, for two of three queries."""
    return fused.filter("(query_id / 100) % 3 <> 0 AND rank % 5 <> 0").select("query_id", (F.col("rank") - 1).alias("idx"), (F.pmod(F.col("chunk_id") * 17, F.lit(101)) / 101.0).alias("relevance"))


def rerank_merge(spark, d):
    fused = retrieval.fused_topk(retrieval.rrf(two_routes(spark, d))).select("query_id", "chunk_id", "rank")
    return retrieval.rerank_merge(fused, fake_relevance(fused)).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), "rank")


def hybrid_search(spark, d):
    """Fusion, the first 5, parents (chunk_id div 4), the case of scores and the floor."""
    fused = retrieval.fused_topk(retrieval.rrf(two_routes(spark, d)))
    found = fused.withColumn("found_id", F.expr("chunk_id div 4"))
    kept = retrieval.final_topk(found).withColumn("score", retrieval.score_case(F.lit(None).cast("double"), F.lit(False), F.col("distance")))
    return retrieval.similarity_threshold(kept).select("query_id", "found_id", F.round("score", 6).alias("score"), "rank")


def searchable(spark, d):
    """Chunks of all documents by windows, and the vectors of their leaves."""
    chunks = staged(chunking.parent_child(corpus(spark, d), cut=lambda text, size, overlap: tx.fixed_windows(text, size)), "chunks")
    # Staged, as the search asks several things of each vector and each would be embedded for every one of them.
    return chunks, staged(chunks.filter("parent_id IS NOT NULL").select("kb_id", "chunk_id", hash_embedding(F.col("text")).alias("embedding")), "vectors")


def search_documents(spark, d):
    """The whole retrieval: the longest sentence of each document whose id is divisible by 100, over the chunks of its base."""
    sentences = F.transform(F.split("text", r"[.!?\n]+"), lambda s, i: F.struct(F.length(F.btrim(s)).alias("n"), (-i).alias("at"), F.btrim(s).alias("s")))
    queries = corpus(spark, d).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "kb_id", F.array_max(sentences)["s"].alias("query"))
    chunks, vectors = searchable(spark, d)
    return pipelines.search(queries, chunks, vectors).select("query_id", "found_id", F.round("score", 6).alias("score"), "rank", F.length("found_text").alias("n"))


def retrieval_audit(spark, d):
    hits = retrieval.with_score(near(spark, d, 5)).withColumn("text", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")))
    return retrieval.retrieval_audit(hits, 0.9).select("query_id", "chunk_id", "rank", "verdict", "preview")


def parent_lookup(spark, d):
    """Documents as chunks: ids not divisible by 4 have the one below that is as parent; ids divisible by 3 are question-answer pairs."""
    docs = corpus(spark, d)
    parent = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") - F.col("doc_id") % 4)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), parent.alias("parent_id"), F.when(F.col("doc_id") % 3 == 0, "qa").otherwise("content").alias("kind"), "text")
    return retrieval.parent_lookup(chunks, chunks).select("chunk_id", "found_id", F.length("found_text").alias("n"))


def context_block(spark, d):
    hits = near(spark, d, 5).withColumn("found_text", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")))
    return retrieval.context_block(hits)


def dedup_documents(spark, d):
    return tables.find_duplicates(statuses(spark, d)).select("kb_id", "doc_id", "duplicate_of")


def docs_per_kb(spark, d):
    docs = statuses(spark, d)
    return tables.docs_per_kb(docs.select("kb_id").distinct(), docs)


def status_summary(spark, d):
    return tables.status_summary(statuses(spark, d))


def ingest_progress(spark, d):
    return tables.ingest_progress(statuses(spark, d))


def processing_docs(spark, d):
    docs = statuses(spark, d).withColumn("raw_path", F.when(F.col("doc_id") % 20 == 0, F.lit("")).otherwise(F.concat(F.lit("/raw/"), F.col("doc_id").cast("string"))))
    return tables.processing_docs(docs).select("doc_id", "status", "error")


def fixed_windows(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(tx.fixed_windows(F.col("text"), 500)).alias("no", "piece")).select("doc_id", "no", F.md5(F.col("piece").cast("binary")).alias("piece_md5"), F.length("piece").alias("n"))


def parent_child_windows(spark, d):
    windows = lambda text, size, overlap: tx.fixed_windows(text, size)
    chunks = chunking.parent_child(corpus(spark, d), cut=windows)
    return chunks.select("doc_id", "kind", "ordinal", "chunk_id", F.length("text").alias("n"))


def chunk_documents(spark, d):
    chunks = chunking.parent_child(corpus(spark, d))
    return chunks.select("doc_id", "kind", "ordinal", "chunk_id", "parent_id", F.length("text").alias("n"), tx.est_tokens(F.col("text")).alias("token_count"))


def split_leaves(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(chunking.split_leaves(F.col("text"), 200)).alias("no", "piece")).select("doc_id", "no", F.length("piece").alias("n"))


def token_estimate(spark, d):
    return corpus(spark, d).select("doc_id", tx.est_tokens(F.col("text")).alias("tokens"), F.round(tx.est_tokens_float(F.col("text")), 6).alias("tokens_exact"))


def content_hash(spark, d):
    return corpus(spark, d).select("doc_id", tx.sha256_hex(F.col("text")).alias("hash"), tx.stable_display_id(F.col("kb_id"), F.col("doc_id").cast("string")).alias("display_id"), tx.index_name(F.concat(F.lit("KB-"), F.col("kb_id"))).alias("index_name"))


def history_tokens(spark, d):
    return history.history_tokens(messages(spark, d))


def window_usage(spark, d):
    return history.window_usage(history.history_tokens(messages(spark, d)), 1000).select("session_id", "tokens", "usage", "due")


PRUNE = {"window": 900, "reserve": 80, "buffer": 20, "protected": 40, "min_gain": 10, "kept": 1, "head": 60, "mark": "…"}


def prune_history(spark, d):
    return history.prune_history(messages(spark, d), **PRUNE).select("session_id", "seq", "pruned", F.length("new_text").alias("n"))


def with_calls(spark, d):
    """An assistant turn calls a tool if its session's next turn is a tool's."""
    of = Window.partitionBy("session_id").orderBy("seq")
    return messages(spark, d).withColumn("has_calls", (F.col("role") == "assistant") & F.coalesce(F.lead("role").over(of) == "tool", F.lit(False)))


def head_tail_split(spark, d):
    return history.split_head_tail(with_calls(spark, d), 300)


def compact_prefix(spark, d):
    rows = with_calls(spark, d)
    cuts = history.split_head_tail(rows, 300)
    summaries = cuts.filter("session_id % 5 <> 0").select("session_id", F.concat(F.lit("summary of "), F.col("head_end").cast("string")).alias("summary"))
    return history.compact_prefix(rows, cuts, summaries).select("session_id", "seq", "role", F.length("text").alias("n"))


def truncate_after(spark, d):
    rows = messages(spark, d)
    cuts = rows.filter("role = 'user'").groupBy("session_id").agg(F.max("seq").alias("cut_seq")).filter("session_id % 2 = 0")
    return history.truncate_after(rows, cuts).select("session_id", "seq", "role")


def edit_and_truncate(spark, d):
    rows = messages(spark, d)
    edits = rows.groupBy("session_id").agg((F.max("seq") - 1).alias("edit_seq")).withColumn("new_text", F.lit("edited"))
    return history.edit_and_truncate(rows, edits).select("session_id", "seq", F.length("text").alias("n"))


def merge_system(spark, d):
    return history.merge_system(messages(spark, d), "context").select("session_id", "seq", "role", F.length("text").alias("n"))


def last_user_text(spark, d):
    return history.last_user_text(messages(spark, d)).select("session_id", tx.truncate(F.col("text"), 80).alias("text"))


def fallback_title(spark, d):
    first = history.last_user_text(messages(spark, d))
    return first.select("session_id", tx.fallback_title(F.col("text")).alias("title"))


def tool_budget(spark, d):
    calls = messages(spark, d).filter("role = 'tool'").select("session_id", F.col("seq").alias("turn"), (F.length("text") % 4 + 1).alias("n_calls"))
    return history.tool_budget(calls, 3).select("session_id", "turn", F.col("calls_before").cast("long").alias("calls_before"), "allowed")


def checkpoint_marks(spark, d):
    return history.checkpoint_marks(messages(spark, d), 4).select("session_id", "seq", "checkpoint")


def usage_rollup(spark, d):
    rows = messages(spark, d).withColumn("tokens_in", F.length("text").cast("long")).withColumn("tokens_out", tx.est_tokens(F.col("text")))
    return history.usage_rollup(rows).select("session_id", "seq", "run_in", "run_out")


def called(spark, d):
    """Assistant turns with two calls: ids s-n-0 and s-n-1, the first answered by the session's next turn if that is a tool's."""
    s, n = F.col("session_id").cast("string"), F.col("seq").cast("string")
    call = lambda k: F.struct(F.concat_ws("-", s, n, F.lit(str(k))).alias("id"), F.lit("search").alias("name"), F.concat(F.lit('{"q":'), n, F.lit("}")).alias("args"))
    rows = messages(spark, d)
    calls = F.when(F.col("role") == "assistant", F.array(call(0), call(1))).otherwise(F.array().cast(tx.TOOL_CALLS))
    answers = F.when(F.col("role") == "tool", F.concat_ws("-", s, (F.col("seq") - 1).cast("string"), F.lit("0")))
    return rows.withColumn("tool_calls", calls).withColumn("tool_call_id", answers)


def pair_tool_results(spark, d):
    return history.pair_tool_results(called(spark, d)).select("session_id", "seq", "call_no", "kind", "call_id", F.length("result").alias("result_n"))


def orphan_calls(spark, d):
    rows = called(spark, d)
    calls = rows.select("session_id", F.explode("tool_calls.id").alias("call_id"))
    return history.orphan_calls(calls, rows.filter("role = 'tool'").select("session_id", F.col("tool_call_id").alias("call_id")))


def orphan_results(spark, d):
    rows = called(spark, d)
    calls = rows.select("session_id", F.explode("tool_calls.id").alias("call_id"))
    return history.orphan_calls(rows.filter("role = 'tool'").select("session_id", F.col("tool_call_id").alias("call_id")), calls)


def transcript_export(spark, d):
    return history.export_transcript(messages(spark, d)).select("session_id", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


def cached(spark, d):
    wanted = table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, "").otherwise("m1").alias("model"), F.md5(F.col("text").cast("binary")).alias("text_hash")).distinct()
    cache = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.lit("m1").alias("model"), F.md5(F.col("text").cast("binary")).alias("text_hash"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("embedding"))
    return wanted, cache


def cache_misses(spark, d):
    return tables.cache_misses(*cached(spark, d))


def cache_hits(spark, d):
    return tables.cache_hits(*cached(spark, d))


def insert_ignore(spark, d):
    docs = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_hash"), "doc_id")
    old = docs.filter("doc_id % 4 = 0").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    return tables.insert_ignore(old, docs.filter("doc_id % 4 <> 0"), ["text_hash"], [F.col("doc_id")])


def upsert_latest(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return tables.upsert(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


def markdown_tables(spark, d):
    """Customers as rows of workbooks: a nation is a file, three sheets each, cells of odd content and rows of odd width."""
    odd = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("|x"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" a\r\nb "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    cells = F.slice(F.array(F.col("c_name"), odd, F.col("c_custkey").cast("string"), F.lit("")), F.lit(1), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("path"), F.concat(F.lit("S"), (F.col("c_custkey") % 3).cast("string")).alias("sheet"), (F.col("c_custkey") % 3).alias("sheet_no"), F.col("c_custkey").alias("row_no"), cells.alias("cells"))
    return files.markdown_table(rows).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n"))


def placeholders(spark, d):
    """Documents with three image marks, of which the first is described, the second has a blank description and the third none."""
    mark = lambda i: F.lit(f"\0IMG:{i}\0")
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat(mark(0), "text", mark(1), F.lit("between"), mark(2)).alias("text"))
    described = docs.select("doc_id", F.lit(0).alias("idx"), F.col("source").alias("description")).unionByName(docs.select("doc_id", F.lit(1).alias("idx"), F.lit("").alias("description")))
    return files.fill_placeholders(docs.select("doc_id", "text"), described).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n"))


def cascade_delete(spark, d):
    orders, lines = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    gone = orders.filter("o_custkey % 10 = 0").select("o_orderkey")
    return tables.cascade_delete(orders, {"lines": (lines, "l_orderkey")}, gone, "o_orderkey")["lines"].groupBy("l_orderkey").agg(F.count("*").alias("n"))


def stored_orders(spark, d, keys, rows):
    """A stored table of rows, in a folder that goes with the other staged ones."""
    path = staged_path(spark, "orders-by-key")
    stored.create_table(rows, path, keys, 16)
    return path


def stored_upsert(spark, d):
    """The later orders of each customer over a stored table of the earlier ones, on disk."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    path = stored_orders(spark, d, ["o_custkey"], tables.upsert(orders.filter("o_orderdate < '1996-01-01'"), ["o_custkey"], order))
    stored.upsert(spark, path, ["o_custkey"], orders.filter("o_orderdate >= '1996-01-01'"), order)
    return stored.read_table(spark, path, ["o_custkey"]).select("o_custkey", "o_orderkey")


def stored_changes(spark, d):
    """Customers on disk: new ones put in where there is none, balances set or cleared, some deleted."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    path = stored_orders(spark, d, ["c_custkey"], rows.filter("c_custkey % 3 <> 0"))
    stored.insert_ignore(spark, path, ["c_custkey"], rows.filter("c_custkey % 2 = 0").withColumn("c_nationkey", F.lit(-1)), [F.col("c_custkey")])
    stored.update(spark, path, "c_custkey", rows.filter("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, 1.0).alias("c_acctbal")), nulls_clear=True)
    stored.delete(spark, path, ["c_custkey"], rows.filter("c_custkey % 7 = 0"))
    return stored.read_table(spark, path, ["c_custkey"])


def null_out_provider(spark, d):
    return tables.null_out(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], 3)


def apply_updates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source")
    updates = rows.filter("doc_id % 5 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit(None).cast("string").alias("source"))
    return tables.apply_updates(rows, updates, "doc_id")


def suppliers_as_providers(spark, d):
    kind = F.element_at(F.array(F.lit("chat"), F.lit("embed"), F.lit("rerank"), F.lit("")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("provider_id"), kind.alias("kind"), (F.col("s_suppkey") % 3 == 0).alias("is_default"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(None)).otherwise(F.lit("m")).alias("model"))


def default_by_kind(spark, d):
    return tables.default_by_kind(suppliers_as_providers(spark, d)).select("kind", "provider_id")


def resolve_provider(spark, d):
    bases = table(spark, d, "customer").select(F.col("c_custkey").alias("kb_id"), (F.col("c_custkey") % 150).alias("provider_id"))
    return tables.resolve_provider(bases, suppliers_as_providers(spark, d))


def missing_columns(spark, d):
    spec = {"kind": ("string", "content"), "doc_id": ("bigint", 0), "tokens": ("int", 0)}
    return tables.add_missing_columns(table(spark, d, "documents").select("doc_id", "lang"), spec)


def source_rollup(spark, d):
    return tables.source_rollup(table(spark, d, "documents"))


def grep_lines(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return tables.grep(docs, "licensed").select("path", F.col("line_no").cast("long").alias("line_no"), F.length("line").alias("n"))


def text_filter(spark, d):
    return tables.text_filter(table(spark, d, "documents").select("doc_id", "text"), " LICENSED ", ["text"]).select("doc_id")


def rules(spark):
    rows = [(1, "click", "k3", ""), (2, "view", "", "99"), (3, "view", "k1", ""), (4, "purchase", "", ""), (5, "click", "", "1")]
    return spark.createDataFrame(rows, "rule_seq int, tool string, match_key string, pattern string")


def match_rules(spark, d):
    calls = table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("key"), F.col("event_id").cast("string").alias("args"))
    return tables.match_rules(calls, rules(spark))


def tasks(spark, d):
    """Orders as tasks of their customer: one is blocked by the next two order numbers divided by 4."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("pending")
    return table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("session_id"), F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_orderkey") + 50, F.col("o_orderkey") + 100)).otherwise(F.array().cast("array<bigint>")).alias("blocked_by"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("subject"))


def unblocked_tasks(spark, d):
    return tables.unblocked_tasks(tasks(spark, d)).select("session_id", "id")


def task_board(spark, d):
    return tables.task_board(tasks(spark, d)).select("session_id", "pending", "in_progress", "completed", F.md5(F.col("board").cast("binary")).alias("board_md5"))


def merge_unique(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(F.col("event_type") == "click", F.col("event_id") % 20))).alias("a"), F.sort_array(F.collect_set(F.when(F.col("event_type") == "view", F.col("event_id") % 30))).alias("b"))
    return rows.select("user_id", F.concat_ws(",", tables.merge_unique(F.col("a"), F.col("b")).cast("array<string>")).alias("merged"))


def stream_events(spark, d):
    kind = F.when(F.col("event_type") == "view", "delta").when(F.col("event_type") == "click", "thinking").when(F.col("event_type") == "purchase", "tool_result").when(F.col("event_type") == "signup", "done").otherwise("error")
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), F.col("value"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("data"))


def token_rate_window(spark, d):
    """Events of the trailing 1.5 seconds, a token each, as a rate at every event."""
    return turns.token_rate(stream_events(spark, d).withColumn("tokens", F.lit(1))).select("seq", "rate")


def generation_rate(spark, d):
    """The value of an end is its usage's output tokens."""
    return turns.generation_rate(stream_events(spark, d).withColumn("tokens_out", F.floor("value")))


def token_rate_samples(spark, d):
    """The same rates at every full quarter of a second that an event's window reaches."""
    return turns.token_rate_stream(stream_events(spark, d).withColumn("tokens", F.lit(1))).select("session_id", F.unix_millis("at").alias("at"), "rate")


def turn_assembly(spark, d):
    found = turns.assemble_turns(stream_events(spark, d))
    return found.select("session_id", "turn_no", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("thinking").alias("thinking_n"), "closed_by")


def event_messages(spark, d):
    """Purchases as results and signups as calls of the call c (user id, event id divided by 100); one in seven has no id."""
    rows = stream_events(spark, d)
    call_id = F.when(F.col("seq") % 7 == 0, "").otherwise(F.concat_ws("-", F.lit("c"), F.col("session_id").cast("string"), F.expr("seq div 100").cast("string")))
    data = F.when(F.col("event") == "tool_result", F.to_json(F.struct(call_id.alias("call_id"), F.col("data").alias("content")))).when(F.col("event") == "done", F.to_json(F.struct(call_id.alias("call_id"), F.lit("buy").alias("tool"), F.struct(F.col("data").alias("raw")).alias("input")))).otherwise(F.col("data"))
    found = turns.assemble_messages(rows.withColumn("data", data).withColumn("event", F.when(F.col("event") == "done", "tool_call").otherwise(F.col("event"))))
    return found.select("session_id", "seq", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("thinking").alias("thinking_n"), F.concat_ws(",", "tool_calls.args").alias("args"), "tool_call_id")


def fragments(spark, d):
    """Events as pieces of calls: stream is the user, index the event's number modulo 3."""
    return table(spark, d, "events").select(F.col("user_id").alias("stream"), (F.col("event_id") % 3).alias("idx"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("id"), F.col("event_id").cast("string"))).alias("id"), F.when(F.col("event_id") % 11 == 0, F.col("event_type")).alias("name"), (F.col("event_id") % 10).cast("string").alias("args"))


def tool_call_fragments(spark, d):
    return turns.assemble_tool_calls(fragments(spark, d)).select("stream", "idx", "id", "name", F.md5(F.col("args").cast("binary")).alias("args_md5"), "first_seq")


def session_status(spark, d):
    return turns.session_status_stream(stream_events(spark, d))


def reasoning_split(spark, d):
    a = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return table(spark, d, "documents").select("doc_id", turns.reasoning_of(a, F.col("source")).alias("reasoning"))


def subquery_parse(spark, d):
    """The lines of a document as a model's answer."""
    rows = corpus(spark, d).select("doc_id", tx.parse_subqueries(F.col("text"), F.lit("The.")).alias("found"))
    return rows.select("doc_id", F.size("found").alias("n"), F.md5(F.concat_ws("\n", "found").cast("binary")).alias("found_md5"))


def qa_parse(spark, d):
    rows = corpus(spark, d).select("doc_id", F.posexplode(tx.parse_qa_lines(F.col("text"))).alias("no", "pair"))
    return rows.select("doc_id", "no", F.length("pair.question").alias("q"), F.length("pair.answer").alias("a"))


def hash_embed(spark, d):
    """The default embedder's counts before they are normalised."""
    slots = corpus(spark, d).select("doc_id", F.posexplode(hash_counts(F.col("text"))).alias("slot", "n"))
    return slots.filter("n > 0").select("doc_id", "slot", F.col("n").cast("long").alias("n"))


def route_parser(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".DOCX", ".xlsx", ".pdf", ".md", ".MD", ".txt"))), (F.col("page_id") % 6 + 1).cast("int"))
    mime = F.when(F.col("page_id") % 7 == 0, "application/pdf").when(F.col("page_id") % 5 == 0, "text/markdown").otherwise("")
    return table(spark, d, "pages").select("page_id", tx.route_parser(mime, F.concat(F.lit("f"), F.col("page_id").cast("string"), ext)).alias("parser"))


def path_escapes(spark, d):
    path = F.regexp_replace(F.col("url"), "^[a-z]+://[^/]*/", "../")
    return table(spark, d, "pages").select("page_id", tx.path_escapes(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/"), path)).otherwise(path)).alias("escapes"))


def display_rows(spark, d):
    return messages(spark, d).select("session_id", "seq", tx.trim_tool_output(F.col("text"), 40, "…").alias("head"), tx.subtask_result(F.col("text"), 30).alias("result"), tx.command_family(F.col("text")).alias("family"))


def short_times(spark, d):
    return table(spark, d, "events").select("event_id", tx.short_time(F.col("ts"), "2024-01-02").alias("shown"))


def group_by_source(spark, d):
    """Documents by source, one source first, blank ones last."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 0, F.col("source")).alias("source"))
    return tables.grouped(docs, "source", "doc_id", first="web").select("source", "group_no", "place", "doc_id")


def group_by_type(spark, d):
    """Events by the types that count."""
    return tables.grouped(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", known=("click", "view", "purchase")).select("event_type", "group_no", "place", "event_id")


def ordered_listing(spark, d):
    """All documents of each language in order of age."""
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return tables.ordered_listing(docs, ["lang"], [F.col("doc_id")]).select("lang", "doc_id", "place")


def chunk_listing(spark, d):
    """The first 100 chunks of each base by document and place: the listing's own limit."""
    chunks = chunking.parent_child(corpus(spark, d), cut=lambda text, size, overlap: tx.fixed_windows(text, size))
    return tables.ordered_listing(chunks, ["kb_id"], [F.col("doc_id"), F.col("ordinal")], 100).select("kb_id", "doc_id", "ordinal", "place")


def vector_pairs(spark, d):
    """Distances of consecutive vectors, and their unit norms."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(w, "vec_id").select("vec_id", F.round(l2_distance(F.col("embedding"), F.col("next")), 6).alias("distance"))


def single_topk(spark, d):
    """The 20 vectors nearest to the mean of all: one query needs no window."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    means = vectors.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda m: m["x"]).alias("q"))
    ranked = vectors.join(F.broadcast(centre), F.lit(True)).select("vec_id", l2_distance(F.col("q"), F.col("embedding")).alias("distance"))
    return ranked.orderBy(F.round("distance", 9), "vec_id").limit(20).select("vec_id", F.round("distance", 6).alias("distance"))


def outside_whitelist(spark, d):
    calls = table(spark, d, "events").select("event_id", F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("role"), F.col("event_type").alias("tool"))
    allowed = spark.createDataFrame([("r0", "click"), ("r0", "view"), ("r1", "view"), ("r2", "purchase")], "role string, tool string")
    return tables.outside_whitelist(calls, allowed).select("event_id", "role", "tool")


def exclude_deleted(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    return tables.exclude(rows, rows.filter("doc_id % 7 = 0"), ["doc_id"])


def hydrate(spark, d):
    """Hits of vectors with the document of the same number, and its file name."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "lang")
    named = docs.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename")).filter("doc_id % 2 = 0")
    return retrieval.attach_filename(retrieval.hydrate(near(spark, d, 5).select("query_id", "chunk_id", "rank"), docs), named).select("query_id", "chunk_id", "rank", "lang", "filename")


def union_lists(spark, d):
    return two_routes(spark, d).groupBy("query_id", "query_no").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


def role_projection(spark, d):
    rows = messages(spark, d).withColumn("role", F.when(F.col("role") == "system", "summary").otherwise(F.col("role")))
    return history.role_projection(rows).select("session_id", "seq", "role")


def exclusive_default(spark, d):
    return tables.set_exclusive_default(suppliers_as_providers(spark, d), 6, "rerank").select("provider_id", "kind", "is_default")


def list_level(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    return tables.list_level(paths, "", ("spam-farm.example.org",)).select("name", "is_dir")


def catalog_index(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description"))
    return tables.catalog_index(rows, "Nations:", "end")


def layered_rules(spark, d):
    return tables.layered_rules(table(spark, d, "nation").select(F.col("n_nationkey").alias("priority"), F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("body"), (F.col("n_regionkey") != 1).alias("enabled")))


def validate_entries(spark, d):
    name = F.concat(F.when(F.col("doc_id") % 4 == 0, "Bad ").otherwise("doc-"), F.col("doc_id").cast("string"))
    kind = F.when(F.col("doc_id") % 5 == 0, "other").otherwise("user")
    return tables.validate_entries(table(spark, d, "documents").select("doc_id", name.alias("name"), kind.alias("type"), F.col("text").alias("description"), F.col("text").alias("body"))).select("doc_id", "reason")


def live_text(spark, d):
    return turns.live_text(stream_events(spark, d)).select("session_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def first_by_id(spark, d):
    return retrieval.first_by(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


def clean_options(spark, d):
    """The sentences of a turn as options."""
    options = F.split("text", "[.]")
    return messages(spark, d).select("session_id", "seq", F.size(tx.clean_options(options)).alias("n"), tx.options_valid(options).alias("valid"))


def message_tokens(spark, d):
    rows = called(spark, d).withColumn("images", F.when(F.col("seq") % 3 == 0, F.array(F.col("text"), F.col("text"))).otherwise(F.array().cast("array<string>")))
    return rows.select("session_id", "seq", tx.est_message_tokens(F.col("text"), F.col("tool_calls"), F.col("images")).alias("tokens"))


def nonblank_turns(spark, d):
    return turns.nonblank_turns(turns.assemble_turns(stream_events(spark, d))).select("session_id", "turn_no", "incomplete")


def compact_stats(spark, d):
    rows = with_calls(spark, d)
    cuts = history.split_head_tail(rows, 300)
    summaries = cuts.filter("session_id % 5 <> 0").select("session_id", F.lit("summary").alias("summary"))
    return history.compact_stats(rows, cuts, summaries, 1000)


def called_tokens(spark, d):
    """Tokens of sessions whose assistant turns carry calls."""
    return history.history_tokens(called(spark, d))


def transcript_with_tools(spark, d):
    rows = messages(spark, d).withColumn("thinking", F.when(F.col("seq") % 4 == 3, F.concat(F.lit(" on "), F.col("seq").cast("string")))).withColumn("text", F.when(F.col("role") == "tool", F.concat(F.lit("find  x"), F.lit(history.RESULT_MARK), F.col("text"))).otherwise(F.col("text")))
    return history.export_transcript(rows, thinking=True, tools=True).select("session_id", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


def duplicates_of_stored(spark, d):
    """Documents with odd ids against those with even ids as stored ones."""
    docs = statuses(spark, d).withColumn("status", F.when(F.col("status") == "failed", "failed").otherwise("ready"))
    return tables.find_duplicates(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0")).select("kb_id", "doc_id", "duplicate_of")


def resolve_chat_provider(spark, d):
    """Orders as requests: of their customer as session, every third with an override of its own."""
    override = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 200)
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("session_id"), override.alias("override"))
    sessions = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 150).alias("provider_id"))
    return tables.resolve_chat_provider(requests, sessions, suppliers_as_providers(spark, d)).select("request_id", "provider_id")


def hidden_tools(spark, d):
    """Parts as tools: names by brand and key."""
    names = F.element_at(F.array(*map(F.lit, ("file_write", "web_search", "My_OCR_tool", "file_edit", "take_screenshot"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    tools = table(spark, d, "part").select("p_partkey", names.alias("tool"), (F.col("p_partkey") % 2 == 0).alias("plan_mode"), (F.col("p_partkey") % 3 == 0).alias("vision"), (F.col("p_partkey") % 4 != 0).alias("has_images"))
    return tables.hidden_tools(tools).select("p_partkey", "hidden")


def delete_provider(spark, d):
    """One nation gone, and the references of customers and suppliers to it cleared."""
    out = tables.delete_provider({"customers": (table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"])}, table(spark, d, "nation").select("n_nationkey"), 3, "n_nationkey")
    return out["customers"].join(out["providers"], F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_nationkey")


def menu_filter(spark, d):
    entries = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "global").otherwise("project").alias("source"))
    return tables.menu_filter(entries, " RED ", skills=True).select("p_partkey")


def validate_rules(spark, d):
    """Pages as rule files, one in eleven with a byte that no UTF-8 text has."""
    content = F.when(F.col("page_id") % 11 == 0, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("html", "UTF-8"))
    return tables.validate_rules(table(spark, d, "pages").select("page_id", content.alias("content")), 5000).select("page_id", "reason")


def rule_lines(spark, d):
    """Lines of documents as read by a viewer: from the second on, two of them."""
    return corpus(spark, d).select("doc_id", F.concat_ws("|", tx.read_lines(F.col("text"), 2, 2)).alias("shown"))


def chunk_preview(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(chunking.chunk(F.col("text"))).alias("ordinal", "piece")).select("doc_id", "ordinal", F.length("piece").alias("n"))


NOT_QUERIES = {"table", "messages", "corpus", "statuses", "vector_batch", "near", "phrase_queries", "doc_chunks", "id_route", "two_routes", "fake_relevance", "with_calls", "called", "cached", "suppliers_as_providers", "rules", "tasks", "stream_events", "fragments", "hash_counts", "hash_embedding", "l2_distance", "searchable", "stored_orders", "staged", "staged_path"}
QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and name not in NOT_QUERIES}
