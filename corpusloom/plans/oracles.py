"""The queries' results in DuckDB's SQL, where SQL expresses them."""

from __future__ import annotations

from ..functions.text import NUMBERING, QUOTES, TITLE_EDGE

M = "SELECT conv_id AS session_id, turn AS seq, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'tool' ELSE role END AS role, text FROM conversations"
S = """SELECT source AS kb_id, doc_id, CASE doc_id % 10 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' WHEN 2 THEN 'paused' WHEN 3 THEN 'duplicate' ELSE 'ready' END AS status,
 sha256(text) AS content_hash, n_chars % 7 AS chunk_done, n_chars % 7 + doc_id % 3 AS chunk_total FROM documents"""
E = """SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'delta' WHEN 'click' THEN 'thinking' WHEN 'purchase' THEN 'tool_result' WHEN 'signup' THEN 'done' ELSE 'error' END AS event,
 'e' || event_id AS data FROM events"""
V = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"
P = """SELECT o_orderkey % 50 AS session_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'in_progress' ELSE 'pending' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey + 50, o_orderkey + 100] ELSE [] END AS blocked_by, 'order ' || o_orderkey AS subject FROM orders"""
SUP = """SELECT s_suppkey AS provider_id, CASE s_suppkey % 4 WHEN 1 THEN 'embed' WHEN 2 THEN 'rerank' ELSE 'chat' END AS kind, s_suppkey % 3 = 0 AS is_default, s_suppkey % 5 <> 0 AS has_model FROM supplier"""


QUOTED = "'" + QUOTES.replace("'", "''") + "'"
EDGE = "'" + TITLE_EDGE.replace("'", "''") + "'"


def wide(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\x{{3000}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{ff00}}-\x{{ffef}}]', '', 'g'))"


def est(x: str) -> str:
    return f"CAST({wide(x)} + floor((length({x}) - {wide(x)}) / 4) AS BIGINT)"


def dist(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"


def near(k: int) -> str:
    return f"""SELECT * FROM (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM
 (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {dist("a.v", "b.v")} AS distance FROM ({V}) a JOIN ({V}) b ON a.label = b.label WHERE a.vec_id % 100 = 0)) WHERE rank <= {k}"""


ROUTES = f"""SELECT query_id, 0 AS query_no, chunk_id, rank, distance FROM ({near(20)})
 UNION ALL SELECT query_id, 1, chunk_id, rank, NULL FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY ((b.vec_id * 31 + a.vec_id) % 97), b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0) WHERE rank <= 20"""
FUSED = f"""SELECT * FROM (SELECT query_id, chunk_id, rrf, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, chunk_id) AS rank FROM
 (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(distance) AS distance FROM ({ROUTES}) GROUP BY ALL)) WHERE rank <= 20"""
SLOT = "CAST(('0x' || left(md5({}), 8))::BIGINT % 64 AS INTEGER)"
SENTENCES = r"list_transform(string_split_regex({}, '[.!?\n]+'), lambda x: trim(x))"
PQ = f"""SELECT item_id || '/' || (i - 1) || '/' || s.source AS query_id, s.source AS kb_id, lower(p[i]) AS phrase FROM (SELECT item_id, {SENTENCES.format("text")} AS p FROM benchmark),
 LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i), (SELECT DISTINCT source FROM documents) s WHERE length(p[i]) >= 3"""
HIT = f"""SELECT q.query_id, q.kb_id, d.doc_id AS chunk_id, len(list_filter(range(1, length(d.text) - length(q.phrase) + 2), lambda i: substring(lower(d.text), i, length(q.phrase)) = q.phrase)) AS tf, greatest(length(d.text) - 2, 0) AS len
 FROM ({PQ}) q JOIN documents d ON d.source = q.kb_id AND contains(lower(d.text), q.phrase)"""
CALLED = f"""SELECT *, CASE WHEN role = 'assistant' THEN [session_id || '-' || seq || '-0', session_id || '-' || seq || '-1'] ELSE [] END AS calls,
 CASE WHEN role = 'tool' THEN session_id || '-' || (seq - 1) || '-0' END AS tool_call_id FROM ({M})"""
CALLS = f"SELECT session_id, seq, i - 1 AS call_no, calls[i] AS call_id FROM ({CALLED}), LATERAL (SELECT unnest(range(1, len(calls) + 1)) AS i)"
WITH_CALLS = f"SELECT *, role = 'assistant' AND coalesce(lead(role) OVER (PARTITION BY session_id ORDER BY seq) = 'tool', false) AS has_calls FROM ({M})"
CUT = f"""SELECT session_id, count(*) AS n, coalesce(max(i) FILTER (suffix > 300 AND i >= 1 AND NOT (role = 'tool' OR has_calls)), count(*)) AS head_end FROM
 (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i, sum({est("text")}) OVER (PARTITION BY session_id ORDER BY seq DESC) AS suffix FROM ({WITH_CALLS})) GROUP BY session_id"""
TOKENS = f"SELECT session_id, CAST(sum({est('text')}) AS BIGINT) AS tokens, count(*) AS n_messages FROM ({M}) GROUP BY session_id"
TRIMMED = "CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END"
PRUNED = f"""WITH a AS (SELECT *, {est("text")} AS t, {est(TRIMMED)} AS tt, sum({est("text")}) OVER (PARTITION BY session_id) AS total,
  role = 'tool' AND row_number() OVER (PARTITION BY session_id, role = 'tool' ORDER BY seq DESC) > 1 AS cand FROM ({M})),
 b AS (SELECT *, cand AND coalesce(sum(CASE WHEN cand THEN t END) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 40 AS cuttable FROM a),
 c AS (SELECT *, CASE WHEN cuttable THEN t - tt END AS gain FROM b),
 d AS (SELECT *, sum(gain) OVER (PARTITION BY session_id ORDER BY seq) AS prefix FROM c),
 e AS (SELECT *, max(CASE WHEN cuttable THEN prefix END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM d),
 f AS (SELECT *, total > 800 AND cuttable AND (reached IS NULL OR reached < total - 800) AS cut FROM e),
 g AS (SELECT *, cut AND coalesce(sum(CASE WHEN cut THEN gain END) OVER (PARTITION BY session_id), 0) >= 10 AS pruned FROM f)
 SELECT session_id, seq, pruned, length(CASE WHEN pruned THEN {TRIMMED} ELSE text END) AS n FROM g"""
TURNS = """SELECT *, coalesce(sum(CASE WHEN event IN ('tool_result', 'done', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn_no FROM (%s)""" % E
WANTED = "SELECT DISTINCT CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'm1' END AS model, md5(text) AS text_hash FROM documents"
CACHE = "SELECT 'm1' AS model, md5(text) AS text_hash FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0"
WINDOWS = "SELECT doc_id, source, i AS no, substring(text, CAST(i * {0} + 1 AS BIGINT), {0}) AS piece FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / {0}.0) AS BIGINT))) AS i)"


def windows(size: int) -> str:
    return WINDOWS.format(size)


CHUNKS = f"""WITH p AS (SELECT doc_id, source, no AS ordinal, piece FROM ({windows(2000)})),
 k AS (SELECT doc_id, source, ordinal AS parent_no, i AS child_no, substring(piece, CAST(i * 500 + 1 AS BIGINT), 500) AS piece FROM p, LATERAL (SELECT unnest(range(0, CAST(ceil(length(piece) / 500.0) AS BIGINT))) AS i)),
 n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
 c AS (SELECT k.doc_id, source, parent_no, n.n + row_number() OVER (PARTITION BY k.doc_id ORDER BY parent_no, child_no) - 1 AS ordinal, piece FROM k JOIN n USING (doc_id)),
 u AS (SELECT doc_id, source, '' AS kind, 'parent' AS hashed, NULL AS parent_no, ordinal, piece FROM p UNION ALL SELECT doc_id, source, 'content', 'content', parent_no, ordinal, piece FROM c)
 SELECT doc_id, source, kind, parent_no, ordinal, piece, 'chunk_' || left(sha256(source || '|' || doc_id || '|' || hashed || '|' || ordinal), 26) AS chunk_id FROM u"""


ORACLES = {
    "vector_topk": f"SELECT query_id, chunk_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ({near(20)})",
    "vector_threshold": f"SELECT query_id, chunk_id, round(1 - distance * distance / 2, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({near(20)}) WHERE 1 - distance * distance / 2 >= 0.3",
    "phrase_match": f"SELECT query_id, chunk_id, tf FROM ({HIT})",
    "trigram_stats": "SELECT source AS kb_id, count(*) AS n_chunks, round(avg(greatest(length(text) - 2, 0)), 6) AS avg_len FROM documents GROUP BY source",
    "phrase_bm25": f"""WITH h AS ({HIT}), df AS (SELECT query_id, count(*) AS df FROM h GROUP BY query_id),
 st AS (SELECT source AS kb_id, count(*) AS n, avg(greatest(length(text) - 2, 0)) AS a FROM documents GROUP BY source),
 s AS (SELECT query_id, chunk_id, greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))) AS score FROM h JOIN df USING (query_id) JOIN st USING (kb_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM s)
 SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 20""",
    "rrf_fusion": f"SELECT query_id, chunk_id, round(rrf, 9) AS rrf, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ({FUSED})",
    "rerank_merge": f"""WITH f AS (SELECT query_id, chunk_id, rank FROM ({FUSED})),
 j AS (SELECT *, CASE WHEN (query_id // 100) % 3 <> 0 AND rank % 5 <> 0 THEN ((chunk_id * 17) % 101) / 101.0::DOUBLE END AS relevance FROM f),
 k AS (SELECT *, bool_or(relevance IS NOT NULL) OVER (PARTITION BY query_id) AS re FROM j)
 SELECT query_id, chunk_id, round(relevance, 6) AS relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, rank, chunk_id) AS INTEGER) AS rank FROM k WHERE relevance IS NOT NULL OR NOT re""",
    "hybrid_search": f"""WITH f AS (SELECT *, chunk_id // 4 AS found_id FROM ({FUSED}) WHERE rank <= 5),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id, found_id ORDER BY rank) AS rn FROM f)
 SELECT query_id, found_id, round(CASE WHEN distance IS NULL THEN 1.0::DOUBLE ELSE 1 - distance * distance / 2 END, 6) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rn = 1 AND (distance IS NULL OR 1 - distance * distance / 2 >= 0.3)""",
    "retrieval_audit": f"SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, CASE WHEN 1 - distance * distance / 2 >= 0.9 THEN 'INJECT' ELSE 'DROP' END AS verdict, 'chunk ' || chunk_id AS preview FROM ({near(5)})",
    "context_block": f"SELECT query_id, string_agg('[' || rank || '] chunk ' || chunk_id, chr(10) ORDER BY rank) AS context FROM ({near(5)}) GROUP BY query_id",
    "parent_lookup": """WITH c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id - doc_id % 4 END AS parent_id, doc_id % 3 = 0 AS qa, text FROM documents)
 SELECT c.chunk_id, coalesce(p.chunk_id, c.chunk_id) AS found_id, CAST(length(coalesce(p.text, c.text)) AS INTEGER) AS n FROM c LEFT JOIN c p ON c.parent_id = p.chunk_id AND NOT c.qa""",
    "dedup_documents": f"""WITH s AS ({S}), r AS (SELECT kb_id, content_hash, min(doc_id) AS f FROM s WHERE status = 'ready' GROUP BY ALL)
 SELECT s.kb_id, s.doc_id, CASE WHEN f <> s.doc_id THEN f END AS duplicate_of FROM s LEFT JOIN r USING (kb_id, content_hash)""",
    "docs_per_kb": f"SELECT kb_id, count(*) AS doc_count FROM ({S}) GROUP BY kb_id",
    "status_summary": f"""SELECT kb_id, count_if(status = 'ready') AS ready, count_if(status = 'processing') AS processing, count_if(status = 'failed') AS failed, count_if(status = 'duplicate') AS duplicate, count_if(status = 'paused') AS paused,
 count_if(status NOT IN ('ready', 'processing', 'failed', 'duplicate', 'paused')) AS other FROM ({S}) GROUP BY kb_id""",
    "ingest_progress": f"SELECT kb_id, CAST(sum(chunk_done) AS BIGINT) AS done, CAST(sum(chunk_total) AS BIGINT) AS total, round(CASE WHEN sum(chunk_total) > 0 THEN sum(chunk_done) * 100.0::DOUBLE / sum(chunk_total) ELSE 0 END, 6) AS percent FROM ({S}) GROUP BY kb_id",
    "processing_docs": f"SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN doc_id % 20 = 0 THEN 'raw file is missing' END AS error FROM ({S}) WHERE status = 'processing'",
    "fixed_windows": f"SELECT doc_id, CAST(no AS INTEGER) AS no, md5(piece) AS piece_md5, CAST(length(piece) AS INTEGER) AS n FROM ({windows(500)})",
    "parent_child_windows": f"SELECT doc_id, kind, CAST(ordinal AS INTEGER) AS ordinal, chunk_id, CAST(length(piece) AS INTEGER) AS n FROM ({CHUNKS})",
    "search_documents": f"""WITH u AS ({CHUNKS}), l AS (SELECT * FROM u WHERE parent_no IS NOT NULL),
 q AS (SELECT doc_id AS query_id, source AS kb_id, s AS query FROM (SELECT doc_id, source, x[i] AS s, row_number() OVER (PARTITION BY doc_id ORDER BY length(x[i]) DESC, i) AS r
  FROM (SELECT doc_id, source, {SENTENCES.format("text")} AS x FROM documents WHERE doc_id % 100 = 0), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)) WHERE r = 1),
 t AS (SELECT 'q' AS side, CAST(query_id AS VARCHAR) AS id, lower(query) AS low FROM q UNION ALL SELECT 'l', chunk_id, lower(piece) FROM l),
 g AS (SELECT side, id, {SLOT.format("substring(low, i, 3)")} AS slot, count(*) AS n FROM t, LATERAL (SELECT unnest(range(1, length(low) - 1)) AS i) GROUP BY ALL),
 e AS (SELECT side, id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY side, id)) AS x FROM g), has AS (SELECT DISTINCT side, id FROM e),
 dot AS (SELECT a.id AS qid, b.id AS cid, sum(a.x * b.x) AS d FROM e a JOIN e b ON a.side = 'q' AND b.side = 'l' AND a.slot = b.slot GROUP BY ALL),
 far AS (SELECT query_id, chunk_id, sqrt(greatest(0, (EXISTS (FROM has WHERE side = 'q' AND id = CAST(query_id AS VARCHAR)))::INT + (EXISTS (FROM has WHERE side = 'l' AND id = chunk_id))::INT - 2 * coalesce(d, 0))) AS distance
  FROM q JOIN l ON l.source = q.kb_id LEFT JOIN dot ON qid = CAST(query_id AS VARCHAR) AND cid = chunk_id),
 v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM far),
 h AS (SELECT query_id, kb_id, chunk_id, len(list_filter(range(1, length(piece) - length(query) + 2), lambda i: substring(lower(piece), i, length(query)) = lower(query))) AS tf, greatest(length(piece) - 2, 0) AS len
  FROM q JOIN l ON l.source = q.kb_id AND length(query) >= 3 AND contains(lower(piece), lower(query))),
 df AS (SELECT query_id, count(*) AS df FROM h GROUP BY query_id), st AS (SELECT source AS kb_id, count(*) AS c, avg(greatest(length(piece) - 2, 0)) AS a FROM l GROUP BY source),
 b AS (SELECT query_id, chunk_id, greatest(ln((c - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))) AS score FROM h JOIN df USING (query_id) JOIN st USING (kb_id)),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b),
 lists AS (SELECT query_id, chunk_id, rank, distance FROM v WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, NULL FROM p WHERE rank <= 20),
 f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(distance) AS distance FROM lists GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, chunk_id) AS rank FROM f),
 up AS (SELECT k.query_id, par.chunk_id AS found_id, k.rank, k.distance, length(par.piece) AS n FROM k JOIN l USING (chunk_id) JOIN u par ON par.doc_id = l.doc_id AND par.parent_no IS NULL AND par.ordinal = l.parent_no WHERE k.rank <= 5),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id, found_id ORDER BY rank) AS r FROM up)
 SELECT query_id, found_id, round(CASE WHEN distance IS NULL THEN 1.0::DOUBLE ELSE 1 - distance * distance / 2 END, 6) AS score, CAST(rank AS INTEGER) AS rank, CAST(n AS INTEGER) AS n FROM o
 WHERE r = 1 AND (distance IS NULL OR 1 - distance * distance / 2 >= 0.3)""",
    "token_estimate": f"SELECT doc_id, {est('text')} AS tokens, round({wide('text')} + (length(text) - {wide('text')}) / 4.0::DOUBLE, 6) AS tokens_exact FROM documents",
    "content_hash": "SELECT doc_id, sha256(text) AS hash, left(sha1(source || ':' || doc_id), 16) AS display_id, 'vec_kb_' || regexp_replace(lower(source), '[^a-z0-9]', '_', 'g') AS index_name FROM documents",
    "history_tokens": TOKENS,
    "window_usage": f"SELECT session_id, tokens, round(tokens / 1000.0::DOUBLE, 6) AS usage, tokens * 100 >= 60000 AS due FROM ({TOKENS})",
    "prune_history": PRUNED,
    "head_tail_split": f"SELECT session_id, n, CAST(head_end AS BIGINT) AS head_end FROM ({CUT})",
    "compact_prefix": f"""WITH c AS ({CUT}), k AS (SELECT session_id, head_end FROM c WHERE head_end < n AND session_id % 5 <> 0),
 r AS (SELECT m.*, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i FROM ({M}) m),
 t AS (SELECT r.session_id, CAST(seq AS DOUBLE) AS seq, role, text FROM r LEFT JOIN k USING (session_id) WHERE head_end IS NULL OR i >= head_end
  UNION ALL SELECT r.session_id, seq - 0.5, 'summary', 'summary of ' || head_end FROM r JOIN k USING (session_id) WHERE i = head_end)
 SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq, role, CAST(length(text) AS INTEGER) AS n FROM t""",
    "truncate_after": f"""WITH m AS ({M}), c AS (SELECT session_id, max(seq) AS cut FROM m WHERE role = 'user' AND session_id % 2 = 0 GROUP BY session_id)
 SELECT session_id, seq, role FROM m LEFT JOIN c USING (session_id) WHERE cut IS NULL OR seq <= cut""",
    "edit_and_truncate": f"""WITH m AS ({M}), e AS (SELECT session_id, max(seq) - 1 AS edit_seq FROM m GROUP BY session_id), v AS (SELECT e.* FROM e JOIN m ON m.session_id = e.session_id AND m.seq = e.edit_seq AND m.role = 'user')
 SELECT m.session_id, seq, CAST(length(CASE WHEN seq = edit_seq THEN 'edited' ELSE text END) AS INTEGER) AS n FROM m LEFT JOIN v USING (session_id) WHERE edit_seq IS NULL OR seq <= edit_seq""",
    "merge_system": f"""WITH m AS (SELECT *, role = 'system' AND row_number() OVER (PARTITION BY session_id, role ORDER BY seq) = 1 AS f FROM ({M}))
 SELECT session_id, seq, role, CAST(length(CASE WHEN f THEN 'context' || chr(10) || chr(10) || text ELSE text END) AS INTEGER) AS n FROM m
 UNION ALL SELECT session_id, min(seq) - 1, 'system', 7 FROM m GROUP BY session_id HAVING NOT bool_or(f)""",
    "last_user_text": f"SELECT session_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS text FROM (SELECT session_id, arg_max(text, seq) AS t FROM ({M}) WHERE role = 'user' GROUP BY session_id)",
    "tool_budget": f"""WITH c AS (SELECT session_id, seq AS turn, length(text) % 4 + 1 AS n FROM ({M}) WHERE role = 'tool'),
 b AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS calls_before FROM c) SELECT session_id, turn, calls_before, calls_before < 3 AS allowed FROM b""",
    "checkpoint_marks": f"SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) % 4 = 0 AS checkpoint FROM ({M})",
    "usage_rollup": f"""SELECT session_id, seq, CASE WHEN l THEN i END AS run_in, CASE WHEN l THEN o END AS run_out FROM (SELECT session_id, seq, role = 'assistant' AND row_number() OVER (PARTITION BY session_id, role ORDER BY seq DESC) = 1 AS l,
 CAST(sum(length(text)) OVER (PARTITION BY session_id) AS BIGINT) AS i, CAST(sum({est("text")}) OVER (PARTITION BY session_id) AS BIGINT) AS o FROM ({M}))""",
    "pair_tool_results": f"""WITH m AS ({CALLED}), c AS ({CALLS}), r AS (SELECT session_id, tool_call_id AS call_id, arg_max(text, seq) AS result FROM m WHERE role = 'tool' GROUP BY ALL)
 SELECT c.session_id, c.seq, CAST(call_no AS INTEGER) AS call_no, 'call' AS kind, c.call_id, CAST(length(result) AS INTEGER) AS result_n FROM c LEFT JOIN r USING (session_id, call_id)
 UNION ALL SELECT session_id, seq, -1, role, NULL, NULL FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = m.session_id AND c.call_id = m.tool_call_id)""",
    "orphan_calls": f"SELECT session_id, call_id FROM ({CALLS}) c WHERE NOT EXISTS (SELECT 1 FROM ({CALLED}) m WHERE m.session_id = c.session_id AND m.tool_call_id = c.call_id)",
    "orphan_results": f"SELECT session_id, tool_call_id AS call_id FROM ({CALLED}) m WHERE role = 'tool' AND NOT EXISTS (SELECT 1 FROM ({CALLS}) c WHERE m.session_id = c.session_id AND m.tool_call_id = c.call_id)",
    "cache_misses": f"SELECT model, text_hash FROM ({WANTED}) w WHERE NOT EXISTS (SELECT 1 FROM ({CACHE}) c WHERE c.model = w.model AND c.text_hash = w.text_hash)",
    "cache_hits": f"SELECT model, text_hash FROM ({WANTED}) w WHERE EXISTS (SELECT 1 FROM ({CACHE}) c WHERE c.model = w.model AND c.text_hash = w.text_hash)",
    "insert_ignore": """WITH o AS (SELECT md5(text) AS text_hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 4 = 0 GROUP BY 1), n AS (SELECT md5(text) AS text_hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1)
 SELECT * FROM o UNION ALL SELECT * FROM n WHERE text_hash NOT IN (SELECT text_hash FROM o)""",
    "upsert_latest": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "cascade_delete": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0) GROUP BY l_orderkey",
    "null_out_provider": "SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey FROM customer",
    "apply_updates": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE lang END AS lang, source FROM documents",
    "default_by_kind": f"SELECT kind, min(provider_id) AS provider_id FROM ({SUP}) WHERE is_default GROUP BY kind",
    "resolve_provider": f"SELECT c_custkey AS kb_id, coalesce(p.provider_id, (SELECT min(provider_id) FROM ({SUP}) WHERE is_default AND kind = 'embed')) AS provider_id FROM customer c LEFT JOIN ({SUP}) p ON p.provider_id = c.c_custkey % 150 AND has_model",
    "missing_columns": "SELECT doc_id, lang, 'content' AS kind, CAST(0 AS INTEGER) AS tokens FROM documents",
    "source_rollup": "SELECT coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (source)",
    "grep_lines": "SELECT doc_id AS path, i AS line_no, CAST(length(l[i]) AS INTEGER) AS n FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE contains(l[i], 'licensed')",
    "text_filter": "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed')",
    "match_rules": """WITH r(rule_seq, tool, match_key, pattern) AS (VALUES (1, 'click', 'k3', ''), (2, 'view', '', '99'), (3, 'view', 'k1', ''), (4, 'purchase', '', ''), (5, 'click', '', '1'))
 SELECT event_id AS call_id, CAST(min(rule_seq) AS INTEGER) AS rule_seq FROM events JOIN r ON r.tool = event_type AND (match_key = 'k' || (user_id % 5) OR (match_key = '' AND (pattern = '' OR contains(CAST(event_id AS VARCHAR), pattern)))) GROUP BY event_id""",
    "unblocked_tasks": f"""WITH p AS ({P}), e AS (SELECT session_id, id, unnest(blocked_by) AS b FROM p)
 SELECT session_id, id FROM p WHERE NOT EXISTS (SELECT 1 FROM e LEFT JOIN p q ON q.session_id = e.session_id AND q.id = e.b WHERE e.session_id = p.session_id AND e.id = p.id AND q.status IS DISTINCT FROM 'completed')""",
    "task_board": f"""SELECT session_id, count_if(status = 'pending') AS pending, count_if(status = 'in_progress') AS in_progress, count_if(status = 'completed') AS completed,
 md5(string_agg('[' || CASE status WHEN 'completed' THEN 'x' WHEN 'in_progress' THEN '>' ELSE ' ' END || '] #' || id || ' ' || subject, chr(10) ORDER BY CASE status WHEN 'in_progress' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, id)) AS board_md5 FROM ({P}) GROUP BY session_id""",
    "merge_unique": """WITH g AS (SELECT user_id, list_sort(list_distinct(list(event_id % 20) FILTER (event_type = 'click'))) AS a, list_sort(list_distinct(list(event_id % 30) FILTER (event_type = 'view'))) AS b FROM events GROUP BY user_id)
 SELECT user_id, array_to_string(list_concat(coalesce(a, []), list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS merged FROM g""",
    "token_rate_window": f"SELECT seq, round(count(*) OVER (PARTITION BY session_id ORDER BY us RANGE BETWEEN 1499999 PRECEDING AND CURRENT ROW) / 1.5::DOUBLE, 6) AS rate FROM ({E})",
    "generation_rate": """WITH e AS (SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) AS us, event_type, CAST(floor(value) AS BIGINT) AS tokens FROM events),
g AS (SELECT session_id, min(us) FILTER (event_type IN ('view', 'click')) AS f, arg_max(us, seq) FILTER (event_type = 'signup') AS l, arg_max(tokens, seq) FILTER (event_type = 'signup') AS tokens FROM e GROUP BY session_id)
SELECT session_id, round(CASE WHEN tokens > 0 AND l > f THEN tokens * 1e6::DOUBLE / (l - f) END, 9) AS rate FROM g""",
    "turn_assembly": f"""WITH t AS ({TURNS}), g AS (SELECT session_id, turn_no, coalesce(string_agg(data, '' ORDER BY seq) FILTER (event = 'delta'), '') AS text, coalesce(string_agg(data, '' ORDER BY seq) FILTER (event = 'thinking'), '') AS thinking,
 max(event) FILTER (event IN ('tool_result', 'done', 'error')) AS closed_by FROM t GROUP BY ALL) SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, md5(text) AS text_md5, CAST(length(thinking) AS INTEGER) AS thinking_n, closed_by FROM g WHERE text <> '' OR thinking <> ''""",
    "tool_call_fragments": """WITH g AS (SELECT user_id AS stream, event_id % 3 AS idx, arg_max('id' || event_id, event_id) FILTER (event_id % 7 = 0) AS id, arg_max(event_type, event_id) FILTER (event_id % 11 = 0) AS name,
 md5(string_agg(CAST(event_id % 10 AS VARCHAR), '' ORDER BY event_id)) AS args_md5, min(event_id) AS first_seq FROM events GROUP BY ALL) SELECT * FROM g WHERE id IS NOT NULL AND name IS NOT NULL""",
    "session_status": f"SELECT session_id, arg_max(event, seq) AS status, max(seq) AS seq FROM ({E}) GROUP BY session_id",
    "reasoning_split": "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN lang ELSE source END AS reasoning FROM documents",
    "qa_parse": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, i, l[i] AS line FROM l, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE contains(l[i], '|')),
 y AS (SELECT doc_id, i, trim(left(line, instr(line, '|') - 1)) AS q, trim(substring(line, instr(line, '|') + 1)) AS a FROM x)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS no, CAST(length(q) AS INTEGER) AS q, CAST(length(a) AS INTEGER) AS a FROM y WHERE q <> '' AND a <> ''""",
    "hash_embed": """WITH t AS (SELECT doc_id, substring(lower(text), i, 3) AS t FROM documents, LATERAL (SELECT unnest(range(1, length(text) - 1)) AS i))
 SELECT doc_id, CAST(('0x' || left(md5(t), 8))::BIGINT % 64 AS INTEGER) AS slot, count(*) AS n FROM t GROUP BY ALL""",
    "route_parser": """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'docx' WHEN page_id % 6 = 1 THEN 'xlsx' WHEN page_id % 7 = 0 OR page_id % 6 = 2 THEN 'pdf' WHEN page_id % 5 = 0 OR page_id % 6 = 3 THEN 'md' ELSE 'txt' END AS parser FROM pages""",
    "display_rows": f"""SELECT session_id, seq, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS head, CASE WHEN trim(text) = '' THEN '(no output)' WHEN length(trim(text)) > 30 THEN left(trim(text), 30) || '…' ELSE trim(text) END AS result,
 CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS family FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM ({M}))""",
    "short_times": "SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-02' THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%m-%d %H:%M') END AS shown FROM events",
    "ordered_listing": "SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS place FROM documents",
    "chunk_listing": f"""SELECT kb_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(place AS INTEGER) AS place FROM
 (SELECT source AS kb_id, doc_id, ordinal, row_number() OVER (PARTITION BY source ORDER BY doc_id, ordinal) AS place FROM ({CHUNKS})) WHERE place <= 100""",
    "vector_pairs": f"SELECT a.vec_id, round({dist('a.v', 'b.v')}, 6) AS distance FROM ({V}) a JOIN ({V}) b ON b.vec_id = a.vec_id + 1",
    "single_topk": f"""WITH m AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(v[i]) AS x FROM ({V}), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY i))
 SELECT b.vec_id, round({dist('a.v', 'b.v')}, 6) AS distance FROM m a, ({V}) b ORDER BY round({dist('a.v', 'b.v')}, 9), b.vec_id LIMIT 20""",
    "outside_whitelist": "SELECT event_id, 'r' || (user_id % 3) AS role, event_type AS tool FROM events WHERE NOT ((user_id % 3 = 0 AND event_type IN ('click', 'view')) OR (user_id % 3 = 1 AND event_type = 'view') OR (user_id % 3 = 2 AND event_type = 'purchase'))",
    "exclude_deleted": "SELECT doc_id, source FROM documents WHERE doc_id % 7 <> 0",
    "hydrate": f"SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, lang, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id || '.txt' END AS filename FROM ({near(5)}) JOIN documents ON doc_id = chunk_id",
    "union_lists": f"SELECT query_id, CAST(query_no AS INTEGER) AS query_no, count(*) AS n, CAST(sum(chunk_id) AS BIGINT) AS ids FROM ({ROUTES}) GROUP BY ALL",
    "role_projection": f"SELECT session_id, seq, role FROM ({M})",
    "exclusive_default": "SELECT s_suppkey AS provider_id, CASE s_suppkey % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'embed' WHEN 2 THEN 'rerank' ELSE '' END AS kind, CASE WHEN s_suppkey % 4 = 2 THEN s_suppkey = 6 ELSE s_suppkey % 3 = 0 END AS is_default FROM supplier",
    "list_level": """WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages)
 SELECT DISTINCT string_split(p, '/')[1] AS name, contains(p, '/') AS is_dir FROM p WHERE string_split(p, '/')[1] NOT IN ('spam-farm.example.org', '')""",
    "catalog_index": "SELECT 'Nations:' || chr(10) || string_agg('- ' || n_name || ': region ' || n_regionkey, chr(10) ORDER BY n_name) || chr(10) || 'end' AS index FROM nation",
    "layered_rules": "SELECT string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS rules FROM nation WHERE n_regionkey <> 1",
    "validate_entries": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'name' WHEN doc_id % 5 = 0 THEN 'type' WHEN length(text) > 200 THEN 'description' WHEN octet_length(encode(text)) > 8192 THEN 'body' END AS reason FROM documents",
    "live_text": f"SELECT session_id, md5(ltrim(string_agg(data, '' ORDER BY seq))) AS text_md5 FROM ({E}) WHERE event = 'delta' GROUP BY session_id",
    "first_by_id": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "clean_options": f"""SELECT session_id, seq, CAST(len(list_distinct(list_filter(list_transform(o, lambda x: trim(x)), lambda x: x <> ''))) AS INTEGER) AS n,
 len(o) BETWEEN 2 AND 4 AND len(list_distinct(list_filter(list_transform(o, lambda x: trim(x)), lambda x: x <> ''))) >= 2 AS valid FROM (SELECT *, string_split(text, '.') AS o FROM ({M}))""",
    "message_tokens": f"""SELECT session_id, seq, {est("text")} + CASE WHEN role = 'assistant' THEN 2 * ((6 + length(CAST(seq AS VARCHAR))) // 4) ELSE 0 END + CASE WHEN seq % 3 = 0 THEN CAST(floor(2 * octet_length(encode(text)) / 750) AS BIGINT) ELSE 0 END AS tokens FROM ({M})""",
    "nonblank_turns": f"""WITH g AS (SELECT session_id, turn_no, coalesce(string_agg(data, '' ORDER BY seq) FILTER (event = 'delta'), '') AS text, max(event) FILTER (event IN ('tool_result', 'done', 'error')) AS closed_by FROM ({TURNS}) GROUP BY ALL)
 SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, coalesce(closed_by, 'error') = 'error' AS incomplete FROM g WHERE text <> ''""",
    "fallback_title": f"""SELECT session_id, left(trim(regexp_replace(trim(string_split_regex(trim(t, chr(10) || chr(13) || chr(9) || ' '), '[\\n\\r]')[1], {EDGE}), '\\s+', ' ', 'g')), 20) AS title FROM (SELECT session_id, arg_max(text, seq) AS t FROM ({M}) WHERE role = 'user' GROUP BY session_id)""",
    "transcript_export": f"""SELECT session_id, md5('# Conversation' || chr(10) || chr(10) || string_agg(CASE role WHEN 'user' THEN '## User' ELSE '## Assistant' END || chr(10) || chr(10) || CASE role WHEN 'user' THEN text ELSE trim(text) END, chr(10) || chr(10) ORDER BY seq)) AS transcript_md5
 FROM ({M}) WHERE role NOT IN ('system', 'summary', 'warning', 'tool') AND (role <> 'assistant' OR trim(text) <> '') GROUP BY session_id""",
    "transcript_with_tools": f"""WITH m AS (SELECT *, chr(10) || chr(10) AS nn FROM ({M})),
 p AS (SELECT session_id, seq, CASE role WHEN 'user' THEN '## User' || nn || text WHEN 'tool' THEN '<details>' || chr(10) || '<summary>Tool call: find x</summary>' || nn || '```' || chr(10) || 'find  x' || nn || '--- result ---' || chr(10) || trim(text) || chr(10) || '```' || nn || '</details>'
  ELSE '## Assistant' || nn || CASE WHEN seq % 4 = 3 THEN '<details>' || chr(10) || '<summary>Thinking</summary>' || nn || 'on ' || seq || nn || '</details>' || nn ELSE '' END || trim(text) END AS piece
  FROM m WHERE role NOT IN ('system', 'summary', 'warning') AND (role <> 'assistant' OR trim(text) <> ''))
 SELECT session_id, md5('# Conversation' || chr(10) || chr(10) || string_agg(piece, chr(10) || chr(10) ORDER BY seq)) AS transcript_md5 FROM p GROUP BY session_id""",
    "token_rate_samples": f"""WITH e AS (SELECT session_id, us // 1000 AS ms, us FROM ({E})), w AS (SELECT session_id, (us // 250000 + k) * 250 AS "at" FROM e, LATERAL (SELECT unnest(range(1, 7)) AS k))
 SELECT session_id, "at", round(count(*) / 1.5::DOUBLE, 6) AS rate FROM w GROUP BY ALL""",
    "event_messages": f"""WITH e AS (SELECT session_id, seq, CASE event WHEN 'done' THEN 'tool_call' ELSE event END AS event, data, CASE WHEN seq % 7 = 0 THEN '' ELSE 'c-' || session_id || '-' || (seq // 100) END AS call_id FROM ({E})),
 t AS (SELECT *, coalesce(sum(CASE WHEN event = 'tool_result' AND call_id <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn_no FROM e),
 a AS (SELECT session_id, max(seq) AS seq, coalesce(string_agg(data, '' ORDER BY seq) FILTER (event = 'delta'), '') AS text, coalesce(sum(length(data)) FILTER (event = 'thinking'), 0) AS k, coalesce(string_agg(data, ',' ORDER BY seq) FILTER (event = 'tool_call'), '') AS args
  FROM t WHERE event IN ('delta', 'thinking') OR (event = 'tool_call' AND call_id <> '') GROUP BY session_id, turn_no)
 SELECT session_id, seq, 'assistant' AS role, md5(text) AS text_md5, CAST(k AS INTEGER) AS thinking_n, args, NULL AS tool_call_id FROM a
 UNION ALL SELECT session_id, seq, 'tool', md5(data), 0, '', call_id FROM e WHERE event = 'tool_result' AND call_id <> ''""",
    "group_by_source": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN source END AS source FROM documents)
 SELECT source, CAST(dense_rank() OVER (ORDER BY CASE WHEN source = 'web' THEN 0 WHEN source <> '' THEN 1 ELSE 2 END, source) AS INTEGER) AS group_no, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS place, doc_id FROM d""",
    "group_by_type": """SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS group_no, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS place, event_id FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
    "compact_stats": f"""WITH c AS ({CUT}), k AS (SELECT session_id, head_end FROM c WHERE head_end < n AND session_id % 5 <> 0),
 r AS (SELECT m.*, {est("text")} AS t, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i FROM ({M}) m)
 SELECT session_id, CAST(count_if(i < head_end) AS BIGINT) AS removed, CAST(sum(t) AS BIGINT) AS tokens_before, CAST(coalesce(sum(t) FILTER (i >= head_end), 0) AS BIGINT) AS tokens_after, round(coalesce(sum(t) FILTER (i >= head_end), 0) / 1000.0::DOUBLE, 6) AS usage_after FROM r JOIN k USING (session_id) GROUP BY session_id""",
    "called_tokens": f"""SELECT session_id, CAST(sum({est("text")} + CASE WHEN role = 'assistant' THEN 2 * (length('{{"q":' || seq || '}}') // 4) ELSE 0 END) AS BIGINT) AS tokens, count(*) AS n_messages FROM ({M}) GROUP BY session_id""",
    "duplicates_of_stored": f"""WITH s AS (SELECT kb_id, doc_id, content_hash, CASE status WHEN 'failed' THEN status ELSE 'ready' END AS status FROM ({S})), r AS (SELECT kb_id, content_hash, arg_min(doc_id, (doc_id % 2) * 1000000000 + doc_id) AS f FROM s WHERE status = 'ready' GROUP BY ALL)
 SELECT s.kb_id, s.doc_id, CASE WHEN f <> s.doc_id THEN f END AS duplicate_of FROM s LEFT JOIN r USING (kb_id, content_hash) WHERE doc_id % 2 = 1""",
    "resolve_chat_provider": f"""WITH p AS ({SUP}), o AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 200 END AS own, CASE WHEN o_custkey % 4 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey % 150 END AS ses FROM orders)
 SELECT request_id, coalesce(a.provider_id, b.provider_id, (SELECT min(provider_id) FROM p WHERE is_default AND kind = 'chat')) AS provider_id FROM o LEFT JOIN p a ON a.provider_id = own LEFT JOIN p b ON b.provider_id = ses""",
    "hidden_tools": """SELECT p_partkey, (p_partkey % 2 = 0 AND p_partkey % 5 IN (0, 3)) OR (p_partkey % 3 = 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 IN (2, 4)) AS hidden FROM part""",
    "delete_provider": """SELECT c_custkey, n_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 3""",
    "menu_filter": """SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND p_partkey % 3 <> 0""",
    "validate_rules": """SELECT page_id, CASE WHEN strlen(html) + (page_id % 11 = 0)::INT > 5000 THEN 'size' WHEN page_id % 11 = 0 THEN 'encoding' END AS reason FROM pages""",
    "rule_lines": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, CASE WHEN len(l) >= 2 THEN l[2:3] ELSE l[1:2] END AS l FROM l)
 SELECT doc_id, array_to_string(list_transform(l, lambda x, i: lpad(CAST(i AS VARCHAR), 6, ' ') || chr(9) || x), '|') AS shown FROM x""",
    "stored_upsert": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
    "stored_changes": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN 1.0 WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal
 FROM customer WHERE (c_custkey % 3 <> 0 OR c_custkey % 2 = 0) AND c_custkey % 7 <> 0""",
    "markdown_tables": r"""WITH r AS (SELECT c_nationkey AS path, c_custkey % 3 AS no, c_custkey AS row_no,
 [c_name, CASE c_custkey % 4 WHEN 0 THEN c_name || '|x' WHEN 1 THEN ' a' || chr(13) || chr(10) || 'b ' || c_mktsegment ELSE c_mktsegment END, CAST(c_custkey AS VARCHAR), ''][1 : c_custkey % 4 + 1] AS cells FROM customer),
w AS (SELECT *, max(len(cells)) OVER (PARTITION BY path, no) AS width, min(row_no) OVER (PARTITION BY path, no) AS first, max(no) OVER (PARTITION BY path) - min(no) OVER (PARTITION BY path) + 1 AS sheets FROM r),
l AS (SELECT *, '| ' || array_to_string(list_transform(range(1, width + 1), lambda i: trim(replace(regexp_replace(coalesce(cells[i], ''), '[\r\n]', ' ', 'g'), '|', '\|'))), ' | ') || ' |' AS line FROM w),
t AS (SELECT path, no, string_agg(CASE WHEN row_no = first THEN CASE WHEN sheets > 1 THEN '# S' || no || chr(10) || chr(10) ELSE '' END || line || chr(10) || '|' || repeat(' --- |', width) ELSE line END, chr(10) ORDER BY row_no) AS t FROM l GROUP BY path, no),
x AS (SELECT path, string_agg(t, chr(10) || chr(10) ORDER BY no) AS text FROM t GROUP BY path) SELECT path, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n FROM x""",
    "placeholders": """WITH x AS (SELECT doc_id, chr(10) || '[image: ' || source || ']' || chr(10) || text || 'between' AS text FROM documents) SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n FROM x""",
    "subquery_parse": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
b AS (SELECT doc_id, pos, trim(trim(ltrim(trim(line, ' ' || chr(9) || chr(13)), '{NUMBERING}'), {QUOTED})) AS s FROM l),
f AS (SELECT doc_id, s, min(pos) AS pos FROM b WHERE length(s) >= 2 AND s <> 'The.' GROUP BY doc_id, s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM f),
g AS (SELECT doc_id, count(*) AS n, string_agg(s, chr(10) ORDER BY pos) AS found FROM k WHERE place <= 2 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n, md5(coalesce(found, '')) AS found_md5 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "path_escapes": """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a/' ELSE '' END || regexp_replace(url, '^[a-z]+://[^/]*/', '../') AS p FROM pages),
s AS (SELECT page_id, p, list_transform(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')), lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END) AS steps FROM p)
SELECT page_id, starts_with(p, '/') OR len(list_filter(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[:i])), lambda x: x < 0)) > 0 AS escapes FROM s""",
}