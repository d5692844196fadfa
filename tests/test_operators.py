"""Pinned values of text functions, retrieval, histories and tables."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.vectors import cosine_from_l2, hash_embedding, is_unit, l2_distance, normalize_l2
from corpusloom.operators import history, models, retrieval, stored, tables
from corpusloom.plans import pipelines
from corpusloom.plans import queries as registered


def one(spark, column, **values):
    names = {k: v for k, v in values.items()}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in names.items()]).select(column).first()[0]


def test_tokens(spark):
    assert [one(spark, tx.est_tokens(F.col("t")), t=t) for t in ("hello world", "你好世界", "", "你好hello")] == [2, 4, 0, 3]


def test_text_functions(spark):
    assert one(spark, tx.command_family(F.col("t")), t="git  status -s") == "git status" and one(spark, tx.command_family(F.col("t")), t="ls") is None
    assert one(spark, tx.path_escapes(F.col("t")), t="a/../../b") and not one(spark, tx.path_escapes(F.col("t")), t="a/../b")
    assert one(spark, tx.normalize_fragments(F.col("t")), t="ab\r\ncd\n\n\n\n你\n好  x") == "ab cd\n\n你好 x"
    assert [tuple(p) for p in one(spark, tx.parse_qa_lines(F.col("t")), t="q1|a1\nbad\n |x\nq2|a|b")] == [("q1", "a1"), ("q2", "a|b")]
    assert one(spark, tx.parse_subqueries(F.col("t"), F.lit("q")), t='1. "alpha"\n2) q\n- beta\nx\nalpha\ngamma') == ["alpha", "beta"]
    assert one(spark, tx.parse_tool_calls(F.col("t")), t="{not json") == [] and one(spark, tx.parse_images(F.col("t")), t="") == []
    assert one(spark, tx.display_tool_args(F.col("t")), t='{"b":{"x":1},"a":"y"}') == '{"a": "y", "b": "{\\"x\\":1}"}'
    assert one(spark, tx.display_tool_args(F.col("t")), t="not json") == "not json"
    assert one(spark, tx.repair_tool_args(F.col("t"), "a string"), t='{"a":"x\ny"}').a == "x\ny"
    assert one(spark, tx.fallback_title(F.col("t")), t='"Hello   world!"\nsecond') == "Hello world"
    assert one(spark, tx.sanitize_title(F.col("t")), t='"Two\nlines"') == "Two lines"
    assert [one(spark, tx.sniff_mime(F.unhex(F.col("t"))), t=t) for t in ("89504E470D0A", "FFD8FFE0", "474946383961", "00")] == ["image/png", "image/jpeg", "image/gif", "image/png"]
    assert one(spark, tx.read_lines(F.col("t"), 2, 2), t="a\nb\nc") == ["     1\tb", "     2\tc"]
    assert one(spark, tx.fixed_windows(F.col("t"), 4), t="abcdefghij") == ["abcd", "efgh", "ij"] and one(spark, tx.fixed_windows(F.col("t"), 4), t="") == []


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.9, 0.1, 0.0])], "chunk_id string, v array<float>").withColumn("kb_id", F.lit("k"))
    query = spark.createDataFrame([(1, "k", [1.0, 0.0, 0.0])], "query_id long, kb_id string, q array<float>")
    assert [r.chunk_id for r in retrieval.knn_join(query, rows, 2).orderBy("rank").collect()] == ["a", "c"]
    assert spark.range(1).select(is_unit(normalize_l2(F.array(F.lit(3.0), F.lit(4.0)))), is_unit(hash_embedding(F.lit("some text")))).first()[:] == (True, True)
    assert spark.range(1).select(cosine_from_l2(l2_distance(F.array(F.lit(1.0)), F.array(F.lit(1.0))))).first()[0] == 1.0


def test_phrases(spark):
    chunks = spark.createDataFrame([("k", "c1", "知识库检索系统"), ("k", "c2", "aaaa"), ("k", "c3", "Hello World")], "kb_id string, chunk_id string, text string")
    queries = spark.createDataFrame([(1, "k", "知识库"), (2, "k", "知识库检"), (3, "k", "world"), (4, "k", "知识"), (5, "k", "aa"), (6, "k", "aaa")], "query_id long, kb_id string, phrase string")
    found = {(r.query_id, r.chunk_id): r.tf for r in retrieval.phrase_match(queries, chunks).collect()}
    assert found == {(1, "c1"): 1, (2, "c1"): 1, (3, "c3"): 1, (6, "c2"): 2}
    assert {r.query_id for r in retrieval.phrase_topk(queries, chunks).collect()} == {1, 2, 3, 6}


def test_rerank(spark):
    candidates = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (2, "c1", 1), (2, "c2", 2)], "query_id long, chunk_id string, rank int")
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.5), (1, 7, 1.0)], "query_id long, idx int, relevance double")
    out = {(r.query_id, r.rank): r.chunk_id for r in retrieval.rerank_merge(candidates, scores).collect()}
    assert out == {(1, 1): "c2", (1, 2): "c1", (2, 1): "c1", (2, 2): "c2"}


def test_duplicates(spark):
    docs = spark.createDataFrame([("k", "d1", "abc", "ready", 1), ("k", "d2", "abc", "ready", 2), ("k", "d3", "def", "processing", 3), ("k", "d4", "def", "ready", 4)], "kb_id string, doc_id string, content_hash string, status string, created long")
    assert {r.doc_id: r.duplicate_of for r in tables.find_duplicates(docs).collect()} == {"d1": None, "d2": "d1", "d3": "d4", "d4": None}


def test_prune(spark):
    body = "\n".join(["x" * 49] * 5000)
    rows = [(1, i, "tool" if i % 2 else "assistant", body if i % 2 else "call") for i in range(20)]
    messages = spark.createDataFrame(rows, "session_id long, seq long, role string, text string")
    out = history.prune_history(messages, 60_000).orderBy("seq").collect()
    assert len(out) == 20 and any(r.pruned for r in out) and all(r.role == "tool" for r in out if r.pruned)
    assert not any(r.pruned for r in out if r.seq >= 9)
    again = spark.createDataFrame([(r.session_id, r.seq, r.role, r.new_text) for r in out], messages.schema)
    assert history.prune_history(again, 60_000).filter("new_text <> text").count() == 0
    assert history.prune_history(messages, 0).filter("pruned").count() == 0


def test_split_and_compact(spark):
    rows = [(1, i, "user", "word " * 40, False) for i in range(5)] + [(2, 0, "user", "hi", False)]
    messages = spark.createDataFrame(rows, "session_id long, seq long, role string, text string, has_calls boolean")
    cuts = {r.session_id: r.head_end for r in history.split_head_tail(messages, 90).collect()}
    assert cuts == {1: 3, 2: 1}
    calls = spark.createDataFrame([(1, i, "assistant" if i % 2 == 0 else "tool", "word " * 40, i % 2 == 0) for i in range(6)], messages.schema)
    assert history.split_head_tail(calls, 60).first().head_end == 6
    out = pipelines.compact(messages.drop("has_calls"), 100, 90, lambda prompt: "short").orderBy("session_id", "seq").collect()
    assert [(r.role, r.text) for r in out if r.session_id == 1][0] == ("summary", "short") and len(out) == 4


def test_tasks_and_rules(spark):
    tasks = spark.createDataFrame([(1, 1, "completed", []), (1, 2, "pending", [1]), (1, 3, "pending", [9]), (1, 4, "pending", [2])], "session_id long, id long, status string, blocked_by array<long>")
    assert {r.id for r in tables.unblocked_tasks(tasks).collect()} == {1, 2}
    files = spark.createDataFrame([("a/b.txt",), ("a/c/d.txt",), ("e.txt",), ("node_modules/x",)], "path string")
    assert [tuple(r) for r in tables.list_level(files, "", ("node_modules",)).collect()] == [("a", True), ("e.txt", False)]


def test_models(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "id long, text string")
    cache = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    out, grown = models.embed(texts, cache, "m", lambda batch: [[float(len(t))] for t in batch])
    assert {r.id: r.embedding for r in out.collect()} == {1: [1.0], 2: [2.0], 3: [1.0]} and grown.count() == 2
    tried = []

    def flaky(_):
        tried.append(1)
        if len(tried) < 3:
            raise models.ModelError(503)
        return "ok"

    assert models.with_retry(flaky, wait=0)("x") == "ok"
    parents = spark.createDataFrame([("p1", "q|a"), ("p2", "none")], "chunk_id string, text string")
    leaves, rest = models.qa_index(parents, lambda t: t)
    assert [r.text for r in leaves.collect()] == ["q\na"] and [r.chunk_id for r in rest.collect()] == ["p2"]
    queries = spark.createDataFrame([(1, "why")], "query_id long, query string")
    assert [r.query for r in models.expand_queries(queries, lambda q: "1. how\n2. when\n3. who").orderBy("query_no").collect()] == ["why", "how", "when"]


def test_ingest_and_search(spark):
    docs = spark.createDataFrame([("k", 1, "The quick brown fox jumps. " * 30, 1), ("k", 2, "The quick brown fox jumps. " * 30, 2), ("k", 3, "An entirely different zebra sleeps here. " * 30, 3)], "kb_id string, doc_id long, text string, created long")
    cache = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    made = pipelines.ingest(docs, cache)
    assert {r.doc_id: r.status for r in made["documents"].collect()} == {1: "ready", 2: "duplicate", 3: "ready"}
    queries = spark.createDataFrame([(1, "k", "zebra sleeps")], "query_id long, kb_id string, query string")
    hits = pipelines.search(queries, made["chunks"], made["vectors"]).orderBy("rank").collect()
    assert hits and "zebra" in hits[0].found_text and len({h.found_id for h in hits}) == len(hits)


def loop_prune(rows, window, reserve, buffer, protected, min_gain, kept, head, mark):
    """The pruning as a loop over one session's rows (role, text)."""
    count = lambda t: len(t) // 4
    usable, texts = window - reserve - buffer, [t for _, t in rows]
    total = sum(map(count, texts))
    if window <= 0 or total <= usable:
        return texts
    candidates = [i for i, (role, _) in enumerate(rows) if role == "tool"]
    candidates = candidates[: len(candidates) - kept] if kept else candidates
    cuttable, later = [], 0
    for i in reversed(candidates):
        if later >= protected:
            cuttable.insert(0, i)
        later += count(texts[i])
    gain, out = 0, list(texts)
    for i in cuttable:
        short = texts[i][:head] + mark if len(texts[i]) > head else texts[i]
        gain += count(texts[i]) - count(short)
        out[i] = short
        if gain >= total - usable:
            break
    return out if gain >= min_gain else texts


def loop_split(rows, keep):
    """The cut as a loop from the end over one session's rows (role, text, has_calls)."""
    total, at = 0, None
    for i in reversed(range(len(rows))):
        total += len(rows[i][1]) // 4
        if total > keep:
            at = i
            break
    while at is not None and at >= 1 and (rows[at][0] == "tool" or (rows[at][0] == "assistant" and rows[at][2])):
        at -= 1
    return at if at else len(rows)


def test_prune_and_split_equal_loops(spark):
    rng = random.Random(4)
    sessions = {}
    for s in range(150):
        n = rng.randint(1, 14)
        roles = [rng.choice(["user", "assistant", "tool", "tool"]) for _ in range(n)]
        sessions[s] = [(r, "x" * rng.randint(0, 160), r == "assistant" and i + 1 < n and roles[i + 1] == "tool") for i, r in enumerate(roles)]
    frame = spark.createDataFrame([(s, i, *row) for s, rows in sessions.items() for i, row in enumerate(rows)], "session_id long, seq long, role string, text string, has_calls boolean")
    given = {"window": 200, "reserve": 30, "buffer": 10, "protected": 25, "min_gain": 6, "kept": 1, "head": 40, "mark": "…"}
    got = {}
    for r in history.prune_history(frame, **given).orderBy("session_id", "seq").collect():
        got.setdefault(r.session_id, []).append(r.new_text)
    assert got == {s: loop_prune([(r, t) for r, t, _ in rows], **given) for s, rows in sessions.items()}
    assert sum(got[s] != [t for _, t, _ in rows] for s, rows in sessions.items()) > 10
    cuts = {r.session_id: r.head_end for r in history.split_head_tail(frame, 60).collect()}
    assert cuts == {s: loop_split(rows, 60) for s, rows in sessions.items()}
    # Running sums in two steps, over blocks of three rows, give the same.
    blocks: dict = {}
    for r in history.prune_history(frame, **given, block_rows=3).orderBy("session_id", "seq").collect():
        blocks.setdefault(r.session_id, []).append(r.new_text)
    assert blocks == got and {r.session_id: r.head_end for r in history.split_head_tail(frame, 60, block_rows=3).collect()} == cuts


def test_a_long_session_is_spread(spark):
    """The rows of one session meet in blocks, a window holds no more than one; the cut is where a sum from the end passes the budget."""
    n = 200_000
    frame = spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 1, "tool").otherwise("user").alias("role"), F.lit("abcdefgh").alias("text"), F.lit(False).alias("has_calls"))
    rows = history.running(history.blocked(frame, 1000), "upto", F.length("text"), own=True)
    assert rows.agg(F.max("upto")).first()[0] == 8 * n and rows.groupBy("session_id", "_block").count().agg(F.max("count")).first()[0] == 1000
    keep = 2 * 50_000
    (cut,) = history.split_head_tail(frame, keep, block_rows=1000).collect()
    at = n - 50_001
    assert cut.head_end == (at if at % 3 != 1 else at - 1) and cut.n == n


def test_stored_tables_rewrite_only_what_changes(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k"]
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("old").alias("w"))
    stored.create_table(rows, path, keys, 32)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    state = lambda: sorted(map(tuple, stored.read_table(spark, path, keys).collect()))
    assert state() == sorted(map(tuple, rows.collect()))
    before = files()
    changes = spark.createDataFrame([(k, at, "new") for k in (3, 5, 1003, 7, 9, 11, 13, 15, 17, 19) for at in (1, 2)], "k long, v long, w string")
    touched = stored.upsert(spark, path, keys, changes, [F.col("v").desc()])
    kept = {f for f in before if files().get(f) == before[f]}
    assert len(touched) <= 10 and {f.parent.name for f in files() if f not in kept} == {f"_bucket={b}" for b in touched}
    frame = rows.filter(~F.col("k").isin(3, 5, 7, 9, 11, 13, 15, 17, 19)).unionByName(changes.filter("v = 2"))
    assert state() == sorted(map(tuple, frame.collect()))
    stored.insert_ignore(spark, path, keys, spark.createDataFrame([(3, 0, "no"), (2000, 1, "b"), (2000, 0, "a")], "k long, v long, w string"), [F.col("v")])
    stored.update(spark, path, "k", spark.createDataFrame([(2000, None, "c"), (4000, 1, "none")], "k long, v long, w string"))
    assert [r for r in state() if r[0] in (3, 2000, 4000)] == [(3, 2, "new"), (2000, 0, "c")]
    stored.update(spark, path, "k", spark.createDataFrame([(2000, None)], "k long, v long"), nulls_clear=True)
    assert [r for r in stored.read_table(spark, path, keys).filter("k = 2000").collect()] == [(2000, None, "c")]
    stored.delete(spark, path, keys, stored.read_table(spark, path, keys))
    assert state() == [] and stored.upsert(spark, path, keys, changes.limit(0), [F.col("v")]) == []
    stored.upsert(spark, path, keys, changes.filter("k = 3"), [F.col("v").desc()])
    assert state() == [(3, 2, "new")]


def test_vectors_by_blocks_equal_brute_force(spark, monkeypatch):
    """Blocks of a few rows, dealt by pair: the same neighbours as comparing all, ties by id."""
    rng = random.Random(6)
    rows = [(f"c{i:03d}", rng.choice("xyz"), [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(200)] + [("none", "x", None), ("null", "x", [1.0, None, 0.0]), ("short", "x", [1.0])]
    asked = [(i, rng.choice("xyzw"), [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(40)]
    vectors, queries = spark.createDataFrame(rows, "chunk_id string, kb_id string, v array<double>"), spark.createDataFrame(asked, "query_id long, kb_id string, q array<double>")
    truth = {}
    for q, kb, x in asked:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(x, v)) ** 0.5, 9), c) for c, k, v in rows if k == kb and v and len(v) == 3 and None not in v)
        truth |= {(q, n + 1): (c, d) for n, (d, c) in enumerate(near[:7])}
    for limit in (retrieval.BROADCAST_BYTES, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(retrieval, "QUERY_ROWS", 5)
        monkeypatch.setattr(retrieval, "VECTOR_ROWS", 11)
        got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.distance, 9)) for r in retrieval.knn_join(queries, vectors, 7).collect()}
        assert got == truth


def test_duplicates_of_stored_documents(spark):
    schema = "kb_id string, doc_id string, content_hash string, status string, created long"
    old = spark.createDataFrame([("k", "o1", "abc", "ready", 9), ("k", "o2", "def", "failed", 9)], schema)
    new = spark.createDataFrame([("k", "n1", "abc", "ready", 1), ("k", "n2", "def", "ready", 2), ("k", "n3", "def", "ready", 3), ("j", "n4", "abc", "ready", 1)], schema)
    assert {r.doc_id: r.duplicate_of for r in tables.find_duplicates(new, old).collect()} == {"n1": "o1", "n2": None, "n3": "n2", "n4": None}


def test_phrases_of_words_meet_by_their_inner_word(spark):
    texts = {"c1": "the quick brown fox jumps", "c2": "a quick, brown fox", "c3": "unquick browned", "c4": "Quick brown FOX, quick brown fox"}
    chunks = spark.createDataFrame([("k", i, t) for i, t in texts.items()], "kb_id string, chunk_id string, text string")
    phrases = ["quick brown fox", "uick brown f", "ick brown", "brown", " quick", "fox, quick brown", "k b", "qu"]
    queries = spark.createDataFrame([(i, "k", p) for i, p in enumerate(phrases)], "query_id long, kb_id string, phrase string")
    truth = {(i, c): sum(t.lower().startswith(p.lower(), k) for k in range(len(t))) for i, p in enumerate(phrases) for c, t in texts.items() if len(p) >= 3 and p.lower() in t.lower()}
    assert {(r.query_id, r.chunk_id): r.tf for r in retrieval.phrase_match(queries, chunks).collect()} == truth


def test_model_wrappers(spark):
    images = spark.createDataFrame([(1, 0, b"a"), (1, 1, b"b"), (2, 0, b"a")], "doc_id long, idx int, data binary")
    cache = spark.createDataFrame([], "model string, image_hash string, desc_text string")

    def describe(data):
        if bytes(data) == b"b":
            raise models.ModelError(400)
        return "seen"

    out, grown = models.describe_images(images, cache, "m", describe)
    assert sorted((r.doc_id, r.idx, r.description) for r in out.collect()) == [(1, 0, "seen"), (1, 1, ""), (2, 0, "seen")] and grown.count() == 1
    titles = models.title(spark.createDataFrame([(1, "first line\nmore"), (2, "hello")], "session_id long, text string"), lambda t: '"A\ntitle"' if t == "hello" else " ")
    assert {r.session_id: r.title for r in titles.collect()} == {1: "first line", 2: "A title"}


def test_display(spark):
    call = [("c1", "t", '{"b":1,"a":"x"}')]
    rows = [(1, 0, "user", "hi", [], None), (1, 1, "assistant", "", call, None), (1, 2, "tool", "out", [], "c1")]
    shown = pipelines.display(spark.createDataFrame(rows, "session_id long, seq long, role string, text string, tool_calls array<struct<id:string,name:string,args:string>>, tool_call_id string")).collect()
    assert [(r.kind, r.text, r.result) for r in shown if r.kind == "call"] == [("call", '{"a": "x", "b": "1"}', "out")] and len([r for r in shown if r.display_id]) == 1
    assert [r.kind for r in shown] == ["user", "assistant", "call"]


def test_phrases_are_read_from_texts_without_an_index(spark, monkeypatch):
    """Random phrases of all lengths beside a count by brute force and beside postings, in several passes; no postings are made."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abÄ漢 ", k=rng.randrange(90))) for _ in range(60)] + ["ab" * 40, None, "x"]
    rows = [("k" if i % 3 else "l", i, t) for i, t in enumerate(texts)]
    asked = []
    for i in range(80):
        t = rng.choice([t for t in texts if t and len(t) > 2])
        at = rng.randrange(len(t) - 2)
        asked.append((i, rng.choice("kl"), t[at : at + rng.choice((3, 4, 7, 8, 20, 33, 70))].upper()))
    asked += [(100, "k", "ABAB"), (101, "k", "abab"), (102, "k", "ab"), (103, "k", None)]
    want = {}
    for q, kb, p in asked:
        for base, i, t in rows:
            if p and len(p) >= 3 and t and base == kb:
                n = sum(t.lower().startswith(p.lower(), at) for at in range(len(t)))
                if n:
                    want[q, i] = (n, len(t) - 2)
    chunks = spark.createDataFrame(rows, "kb_id string, chunk_id long, text string")
    queries = spark.createDataFrame(asked, "query_id long, kb_id string, phrase string")
    index = retrieval.postings(chunks)
    by_index = {(r.query_id, r.chunk_id): (r.tf, r.len) for r in retrieval.phrase_match(queries, chunks, index).collect()}
    best = [tuple(r) for r in retrieval.phrase_topk(queries, chunks, 3, index).collect()]
    monkeypatch.setattr(retrieval, "PASS_BYTES", 2000)
    monkeypatch.setattr(retrieval, "SCAN_CHARS", 300)
    monkeypatch.setattr(retrieval, "postings", None)
    got = {(r.query_id, r.chunk_id): (r.tf, r.len) for r in retrieval.phrase_match(queries, chunks).collect()}
    assert got == want == by_index and len(got) > 100
    assert sorted(best) == sorted(tuple(r) for r in retrieval.phrase_topk(queries, chunks, 3).collect())


def test_the_route_by_ids_meets_few_vectors(spark):
    """As the join of all queries with all vectors of their base, with repeated and negative ids; the widest join grows with neither."""
    rng = random.Random(3)
    vectors = [(rng.choice("ab"), rng.randrange(-4000, 4000)) for _ in range(3000)] + [(None, 1)]
    queries = [(q, rng.choice("abc")) for q in range(0, 4000, 20)] + [(20, "a"), (20, "b")]
    want = []
    for q in {q for q, _ in queries}:
        met = sorted(((c * 31 + q) % 97, c) for p, kb in queries if p == q for base, c in vectors if base == kb)
        want += [(q, c, r) for r, (_, c) in enumerate(met[:7], 1)]
    q, v = spark.createDataFrame(queries, "query_id long, kb_id string"), spark.createDataFrame(vectors, "kb_id string, chunk_id long")
    got = registered.id_route(q, v, 7)
    assert sorted(want) == sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect())
    # Twice the vectors of the same remainders leave the rows that queries meet as they are.
    more = v.unionByName(v.withColumn("chunk_id", F.col("chunk_id") + 97 * 1000))
    assert sorted(want) == sorted((r.query_id, r.chunk_id, r["rank"]) for r in registered.id_route(q, more, 7).collect())
