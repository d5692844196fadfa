"""Streams equal their batch twins; file sources on generated files."""

import io
import json
import os
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans import pipelines
from corpusloom.sources import files as src
from corpusloom.streaming import assembly, turns

EVENTS = [(1, 0, "delta", "He"), (1, 1, "delta", "llo"), (1, 2, "tool_result", ""), (1, 3, "thinking", "hm"), (1, 4, "done", ""), (2, 5, "delta", "x"), (2, 6, "error", ""), (1, 7, "delta", "y"), (1, 8, "done", "")]
SCHEMA = "session_id long, seq long, event string, data string"


def run_stream(spark, tmp_path, rows, schema, make, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    name = f"out_{uuid.uuid4().hex}"
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_turns(spark, tmp_path):
    batch = {(r.session_id, r.turn_no, r.text, r.thinking, r.closed_by) for r in turns.assemble_turns(spark.createDataFrame(EVENTS, SCHEMA)).collect()}
    assert batch == {(1, 0, "Hello", "", "tool_result"), (1, 1, "", "hm", "done"), (2, 0, "x", "", "error"), (1, 2, "y", "", "done")}
    out = run_stream(spark, tmp_path, EVENTS, SCHEMA, lambda s: turns.assemble_turns_stream(s, None))
    assert {(r.session_id, r.turn_no, r.text, r.thinking, r.closed_by) for r in out} == batch


def test_token_rate(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:0{i // 2}.{i % 2 * 5}00", 1) for i in range(8)]
    frame = spark.createDataFrame(rows, "session_id long, ts string, tokens int").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(r.at, r.rate) for r in turns.token_rate_stream(frame).collect()}
    late = [tuple(r) for r in frame.collect()]
    out = run_stream(spark, tmp_path, late, frame.schema, turns.token_rate_stream, "complete")
    assert batch and {(r.at, r.rate) for r in out} == batch


def test_calls_and_frames(spark):
    rows = [(1, 0, 1, "c1", "search", '{"q"'), (1, 0, 2, "", None, ':"x"}'), (1, 1, 3, None, None, "lost")]
    calls = turns.assemble_tool_calls(spark.createDataFrame(rows, "stream long, idx long, seq long, id string, name string, args string")).collect()
    assert [(c.id, c.name, c.args) for c in calls] == [("c1", "search", '{"q":"x"}')]
    frames = spark.createDataFrame([('event: delta\ndata: {"t":1}',), ("data: [DONE]",), ("data: {bad",), ("data: ",), ('data: {"u":2}',)], "value string")
    assert [tuple(r) for r in turns.sse_events(frames).collect()] == [("delta", '{"t":1}'), ("message", '{"u":2}')]


def test_replay(spark):
    log = [(1, 1, "create", 1, None, None), (1, 2, "create", 2, None, [1]), (1, 3, "update", 2, "in_progress", None), (1, 4, "create", 3, None, None), (1, 5, "update", 1, "in_progress", None), (1, 6, "update", 3, "in_progress", None)]
    out = turns.replay_tasks(spark.createDataFrame(log, "session_id long, seq long, op string, id long, status string, blocked_by array<long>")).collect()
    assert {r.id: r.status for r in out} == {1: "pending", 2: "pending", 3: "in_progress"}


def test_tree_and_notes(spark, tmp_path):
    (tmp_path / "sub/node_modules").mkdir(parents=True)
    (tmp_path / "sub/a.py").write_text("print(1)\n")
    (tmp_path / "sub/b.bin").write_bytes(b"a\0b")
    (tmp_path / "sub/node_modules/c.js").write_text("x")
    (tmp_path / "n.md").write_text('---\nname: my-note\ndescription: "a \\"b\\""\ntype: user\n---\nbody here\n')
    (tmp_path / "bad.md").write_text("---\nname: Bad Name\n---\nx")
    files = src.read_files(spark, str(tmp_path))
    assert [os.path.basename(r.path) for r in src.scan_tree(files).collect()] == ["bad.md", "n.md", "a.py"]
    snippet = {os.path.basename(r.path): r for r in src.file_snippets(files).collect()}
    assert snippet["a.py"].language == "python" and snippet["a.py"].size == "9B" and snippet["b.bin"].binary
    note = src.frontmatter_catalog(files).collect()
    assert [(r.name, r.description, r.type, r.body) for r in note] == [("my-note", 'a "b"', "user", "body here\n")]
    asked = spark.createDataFrame([(1, "sub/a.py"), (2, "../x"), (3, "none"), (4, "./sub/"), (5, "a.py")], "no int, path string")
    block = src.attachment_block(asked, src.file_snippets(files), str(tmp_path)).first().block.split("### ")
    assert "```python\nprint(1)" in block[1] and "outside" in block[2] and "[not found]" in block[3] and "[not found]" in block[5]
    assert block[4].strip().splitlines() == ["./sub/", "sub/a.py", "sub/b.bin", "sub/node_modules/c.js"]
    cut = src.file_snippets(files.filter("path LIKE '%n.md'").withColumn("content", F.encode(F.lit("aé"), "UTF-8")).withColumn("length", F.lit(3)), 2).first()
    assert cut.snippet == "a\n… [truncated]"


def test_docx_and_xlsx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    for name, parts in {"d.docx": {"word/document.xml": body}, "e.docx": {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body/></w:document>'}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for part, content in parts.items():
                z.writestr(part, content)
    out = {os.path.basename(r.path): r for r in src.extract_docx(src.read_files(spark, str(tmp_path / "*.docx"))).collect()}
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    assert out["d.docx"].text == "Hello\n| a\\|b |\n| --- |" and out["e.docx"].error == "no text and no images"
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "t.xlsx").write_bytes(buffer.getvalue())
    rows = src.extract_xlsx(src.read_files(spark, str(tmp_path / "*.xlsx")))
    assert [r.cells for r in rows.filter("error IS NULL").orderBy("row_no").collect()] == [["head", "", "7"], ["1"]]
    assert [os.path.basename(r.path) for r in rows.filter("error IS NOT NULL").collect()] == ["broken.xlsx"]
    assert src.markdown_table(rows).first().text == "| head |  | 7 |\n| --- | --- | --- |\n| 1 |  |  |"


def test_placeholders(spark):
    texts = spark.createDataFrame([(1, "a\0IMG:0\0b\0IMG:1\0")], "doc_id long, text string")
    described = spark.createDataFrame([(1, 0, "a cat")], "doc_id long, idx int, description string")
    assert src.fill_placeholders(texts, described).first().text == "a\n[image: a cat]\nb"


def test_incremental_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello there")
    run = lambda: pipelines.incremental_ingest(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "k").awaitTermination(120)
    run()
    (tmp_path / "in/b.txt").write_text("second file")
    (tmp_path / "in/c.txt").write_text("hello there")  # a copy of a document of an earlier batch
    (tmp_path / "in/d.txt").write_text(" ")
    run()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert sorted(r.text for r in read("chunks").filter("parent_id IS NOT NULL").collect()) == ["hello there", "second file"]
    assert sorted(r.status for r in read("documents").collect()) == ["duplicate", "failed", "ready", "ready"]
    places = read("postings").filter("trigram >= 0").agg(F.sum("n")).first()[0]
    assert read("vectors").count() == read("cache").count() == 2 and places == 9 + 9
    # Search reads the stored postings and sums, and no text before it has a hit.
    chunks = read("chunks").filter("parent_id IS NOT NULL").select("kb_id", "chunk_id", "text")
    asked = spark.createDataFrame([(1, "k", "ello TH"), (2, "k", "second"), (3, "k", "hello second")], "query_id long, kb_id string, phrase string")
    stats = retrieval.mean_stats(read("stats"))
    assert {r.query_id: r.tf for r in retrieval.phrase_match(asked, chunks, read("postings")).collect()} == {1: 1, 2: 1}
    assert stats.collect() == retrieval.trigram_stats(chunks).collect() and {r.query_id for r in retrieval.phrase_topk(asked, chunks, index=read("postings"), stats=stats).collect()} == {1, 2}


def test_killed_ingest_runs_again_and_embeds_once(spark, tmp_path, monkeypatch):
    """Killed before any of its writes, a batch that runs again ends with the same rows, and no text is embedded twice."""
    (tmp_path / "in").mkdir()
    for n in range(4):
        (tmp_path / f"in/{n}.txt").write_text(f"text number {n} of the files")
    files = src.read_files(spark, str(tmp_path / "in"))
    calls = tmp_path / "calls"

    def call(texts):
        with calls.open("a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    put, names = pipelines.put, []
    pipelines.ingest_batch(files, str(tmp_path / "whole"), "k", 0, "m", call)
    assert sorted(calls.read_text().splitlines()) == [f"text number {n} of the files" for n in range(4)]
    monkeypatch.setattr(pipelines, "put", lambda rows, target, name, *a: (names.append(name), put(rows, target, name, *a)))
    pipelines.ingest_batch(files, str(tmp_path / "names"), "k", 0, "m", call)
    rows = lambda target, name: sorted(map(str, pipelines.stored(spark, str(tmp_path / target), name).collect()))
    for at in (names.index("cache"), names.index("vectors"), names.index("documents")):
        target, seen = f"killed{at}", []

        def stopped(rows, target, name, *a, at=at, seen=seen):
            seen.append(name)
            if len(seen) == at + 1:
                raise KeyboardInterrupt
            put(rows, target, name, *a)

        calls.write_text("")
        monkeypatch.setattr(pipelines, "put", stopped)
        with pytest.raises(KeyboardInterrupt):
            pipelines.ingest_batch(files, str(tmp_path / target), "k", 0, "m", call)
        states = pipelines.document_states(spark, str(tmp_path / target))
        assert {r.status for r in states.collect()} == {"processing"}
        monkeypatch.setattr(pipelines, "put", put)
        pipelines.ingest_batch(files, str(tmp_path / target), "k", 0, "m", call)
        assert all(rows(target, name) == rows("whole", name) for name in pipelines.STORED)
        assert len(calls.read_text().splitlines()) == (4 if at > names.index("cache") else 8)
    # What no batch has finished is resumed from its stored file, here after a pause.
    target = str(tmp_path / "paused")
    ids = pipelines.document_states(spark, str(tmp_path / "whole")).filter("raw_path LIKE '%/2.txt'").select("kb_id", "doc_id")
    pipelines.set_paused(ids, target)
    pipelines.ingest_batch(files, target, "k", 0, "m", call)
    status = lambda: sorted(r.status for r in pipelines.document_states(spark, target).collect())
    assert status() == ["paused", "ready", "ready", "ready"]
    pipelines.resume_ingest(spark, target, "k", "m", call)
    assert status() == ["paused", "ready", "ready", "ready"]
    pipelines.set_paused(ids, target, False)
    pipelines.resume_ingest(spark, target, "k", "m", call)
    assert status() == ["ready"] * 4 and pipelines.tables.ingest_progress(pipelines.document_states(spark, target)).first().percent == 100.0
    chunks = pipelines.stored(spark, target, "chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 8


def test_ingest_of_mixed_formats(spark, tmp_path):
    w, a, r = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = f'<w:document xmlns:w="{w}" xmlns:a="{a}" xmlns:r="{r}"><w:body><w:p><w:r><w:t>Before </w:t><a:blip r:embed="i1"/><w:t> after</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="i1" Target="media/p.png"/></Relationships>')
        z.writestr("word/media/p.png", b"\x89PNG\r\n\x1a\nX")
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    (tmp_path / "n.md").write_text("# plain")
    target = str(tmp_path / "out")
    pipelines.ingest_batch(src.read_files(spark, str(tmp_path / "*.*")), target, "k", 0, describe=lambda data: f"picture of {len(data)} bytes")
    docs = {os.path.basename(r.raw_path): r for r in pipelines.document_states(spark, target).collect()}
    assert {n: r.status for n, r in docs.items()} == {"d.docx": "ready", "t.xlsx": "ready", "n.md": "ready", "broken.docx": "failed", "p.pdf": "failed"}
    texts = {r.text for r in pipelines.stored(spark, target, "chunks").filter("parent_id IS NULL").collect()}
    assert texts == {"Before \n[image: picture of 9 bytes]\n after", "| 5 |\n| --- |", "# plain"}
    errors = {r.error for r in pipelines.stored(spark, target, "documents").filter("status = 'failed'").collect()}
    assert "no reader for pdf" in errors and len(errors) == 2


def test_rebuild(spark):
    docs = spark.createDataFrame([("k", 1, "first text of the base", 1), ("k", 2, "second text", 2), ("j", 3, "other base", 3)], "kb_id string, doc_id long, text string, created long")
    made = pipelines.ingest(docs, spark.createDataFrame([], "model string, text_hash string, embedding array<double>"))
    cache = made.pop("cache")
    again = pipelines.rebuild_documents(docs.filter("doc_id = 2").withColumn("text", F.lit("second text, rewritten")), made, cache)
    texts = lambda tables: {(r.doc_id, r.text) for r in tables["chunks"].filter("parent_id IS NOT NULL").collect()}
    assert texts(again) == (texts(made) - {(2, "second text")}) | {(2, "second text, rewritten")}
    assert again["vectors"].count() == 3 and again["documents"].count() == 3
    ids = {r.chunk_id for r in again["chunks"].collect()}
    leaves = again["chunks"].filter("parent_id IS NOT NULL").select("kb_id", "chunk_id", "text")
    places = lambda index: sorted((r.kb_id, r.trigram, c, r.n) for r in index.filter("trigram >= 0").groupBy("kb_id", "trigram").agg(F.sum("n").alias("n")).collect() for c in [""])
    assert places(again["postings"]) == places(retrieval.postings(leaves)) and {c for r in again["postings"].filter("trigram < 0").collect() for c in r.chunks if c} <= ids
    asked = spark.createDataFrame([(1, "k", "rewritten"), (2, "k", "second text"), (3, "k", "first")], "query_id long, kb_id string, phrase string")
    assert {r.query_id for r in retrieval.phrase_match(asked, leaves, again["postings"]).collect()} == {1, 2, 3}
    assert sorted(retrieval.mean_stats(again["stats"]).collect()) == sorted(retrieval.trigram_stats(leaves).collect())


def test_messages_of_events(spark):
    rows = [(1, 0, "thinking", "hm"), (1, 1, "tool_call", '{"call_id":"c1","tool":"t","input":{"raw":"{}"}}'), (1, 2, "tool_call", '{"call_id":"","tool":"t"}'), (1, 3, "tool_result", '{"call_id":"c1","content":"out"}'), (1, 4, "tool_result", '{"content":"lost"}'), (1, 5, "delta", "the "), (1, 6, "delta", "end"), (1, 7, "done", "{}"), (2, 8, "delta", "")]
    out = turns.assemble_messages(spark.createDataFrame(rows, SCHEMA)).orderBy("session_id", "seq").collect()
    assert [(r.role, r.text, r.thinking, [c.id for c in r.tool_calls], r.tool_call_id) for r in out] == [("assistant", "", "hm", ["c1"], None), ("tool", "out", "", [], "c1"), ("assistant", "the end", "", [], None)]


def test_call_and_task_streams_equal_their_batch_forms(spark, tmp_path):
    schema = "stream long, idx long, seq long, id string, name string, args string, done boolean"
    rows = [(1, 0, 1, "c1", "search", '{"q"', False), (1, 0, 2, "", None, ':"x"}', False), (1, 1, 3, None, None, "lost", False), (1, None, 4, None, None, None, True), (2, 0, 1, "d", "n", "", False), (2, None, 2, None, None, None, True)]
    batch = turns.assemble_tool_calls(spark.createDataFrame(rows, schema).filter("NOT done"))
    out = run_stream(spark, tmp_path / "calls", rows, schema, turns.assemble_tool_calls_stream)
    assert {(r.stream, r.idx, r.id, r.name, r.args, r.first_seq) for r in out} == {(r.stream, r.idx, r.id, r.name, r.args, r.first_seq) for r in batch.collect()}
    schema = "session_id long, seq long, op string, id long, status string, blocked_by array<long>"
    log = [(1, 1, "create", 1, None, None), (1, 2, "create", 2, None, [1]), (1, 3, "update", 2, "in_progress", None), (1, 4, "create", 3, None, None), (1, 5, "update", 1, "in_progress", None), (1, 6, "update", 3, "in_progress", None), (2, 7, "create", 1, None, None), (2, 8, "delete", 1, None, None), (2, 9, "create", 1, None, None)]
    batch = {(r.session_id, r.id, r.status) for r in turns.replay_tasks(spark.createDataFrame(log, schema)).collect()}
    out = {(r.session_id, r.id, r.status) for r in run_stream(spark, tmp_path / "tasks", log, schema, turns.replay_tasks_stream, "update")}
    assert {x for x in out if x[2]} == batch and {x for x in out if not x[2]} <= {(2, 1, None)}


def test_dedupe_status_and_frames_as_streams(spark, tmp_path):
    rows = [("k", "h1", "2024-01-01 00:00:00"), ("k", "h1", "2024-01-01 00:00:01"), ("k", "h2", "2024-01-01 00:00:02"), ("j", "h1", "2024-01-01 00:00:03")]
    frame = spark.createDataFrame(rows, "kb_id string, content_hash string, at string").select("kb_id", "content_hash", F.col("at").cast("timestamp").alias("created_at"))
    old = spark.createDataFrame([("k", "h2")], "kb_id string, content_hash string")
    out = run_stream(spark, tmp_path / "dedupe", [tuple(r) for r in frame.collect()], frame.schema, lambda s: turns.dedupe_stream(s, stored=old))
    assert sorted((r.kb_id, r.content_hash) for r in out) == [("j", "h1"), ("k", "h1")]
    out = run_stream(spark, tmp_path / "status", EVENTS, SCHEMA, turns.session_status_stream, "complete")
    assert {(r.session_id, r.status) for r in out} == {(1, "done"), (2, "error")}
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames/a.txt").write_text('event: delta\ndata: {"t":1}\n\ndata: [DONE]\n\ndata: {"u":2}\n\n')
    query = turns.read_sse(spark, str(tmp_path / "frames")).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "fcp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("frames").collect()} == {("delta", '{"t":1}'), ("message", '{"u":2}')}
    (tmp_path / "crlf").mkdir()
    (tmp_path / "crlf/a.txt").write_bytes(b'event: delta\r\ndata: {"t":1}\r\n\r\ndata: {"u":2}\r\n\r\n')
    query = turns.read_sse(spark, str(tmp_path / "crlf"), crlf=True).writeStream.format("memory").queryName("crlf").option("checkpointLocation", str(tmp_path / "ccp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("crlf").collect()} == {("delta", '{"t":1}'), ("message", '{"u":2}')}


def test_skills_and_appends(spark, tmp_path):
    for root, name in (("a", "x"), ("b", "x"), ("b", "y")):
        (tmp_path / root / name).mkdir(parents=True)
        (tmp_path / root / name / "SKILL.md").write_text(f"---\nname: {name}\ndescription: of {root}\n---\nbody")
    roots = [("global", src.read_files(spark, str(tmp_path / "a"))), ("project", src.read_files(spark, str(tmp_path / "b")))]
    out = src.skill_catalog(roots, spark.createDataFrame([("project:y",)], "id string")).collect()
    assert sorted(r.id for r in out) == ["global:x", "project:x", "project:y"]
    rows = spark.createDataFrame([("k", 1), ("j", 2)], "kb_id string, n int")
    for _ in range(2):
        src.append_rows(rows, str(tmp_path / "rows"), "kb_id")
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4


def frame_log(seed=3):
    """Frames of some sessions: runs of thinking, text, calls in fragments, results, usage; a run left open; frames to be skipped."""
    rng, frames = random.Random(seed), []
    for session in range(4):
        seq, second = 0, 0.0

        def add(event="message", session=session, **data):
            nonlocal seq, second
            seq, second = seq + 1, second + rng.choice([0.0, 0.25, 1.5])
            ts = f"2024-01-01T00:{int(second) // 60:02d}:{second % 60:06.3f}Z"
            frames.append(f"event: {event}\ndata: " + json.dumps({"session_id": session, "seq": seq, "ts": ts} | data))

        for run in range(4):
            for turn in range(rng.randint(0, 3)):
                for _ in range(rng.randint(0, 3)):
                    add(delta={"reasoning_content": rng.choice(["", "hm "]), "reasoning": "other ", "content": None})
                for _ in range(rng.randint(0, 4)):
                    add(delta={"content": rng.choice(["a", "b ", ""])})
                calls = rng.randint(0, 2)
                for k in range(calls):
                    add(delta={"content": "x", "tool_calls": [{"index": k, "id": f"c{run}{turn}{k}", "function": {"name": "find", "arguments": '{"q"'}}]})
                add(delta={"tool_calls": [{"index": k, "id": "", "function": {"arguments": f":{k}}}"}} for k in range(calls)] + [{"index": 9, "id": "lost", "function": {"arguments": "{}"}}]})
                for k in range(calls):
                    add("tool_result", call_id=f"c{run}{turn}{k}", content=f"out {k}")
            if run % 3 == 2:
                add(error="broken off")
            else:
                add(delta={"content": "end"} if rng.random() < 0.7 else None, done=True, usage={"input": 10 + run, "output": 5 * run})
        add(delta={"content": "still open"})
    return frames + ["data: [DONE]", "data: {no json", "event: ping\ndata: "]


def run_rows(rows):
    return sorted(str((r.session_id, r.seq, r.kind, r.text, r.thinking, [(c["id"], c["name"], c["args"]) for c in (json.loads(r.calls) if isinstance(r.calls, str) else [c.asDict() for c in r.calls])], r.tool_call_id, r.tokens_in, r.tokens_out, None if r.rate is None else round(r.rate, 6))) for r in rows)


def test_assembly_of_a_shuffled_restarted_stream_equals_the_batch(spark, tmp_path):
    frames = frame_log()
    batch = pipelines.assemble(spark.createDataFrame([(f,) for f in frames], "value string")).collect()
    kinds = {r.kind for r in batch}
    assert kinds == {"assistant", "tool", "run"} and any(len(r.calls) == 2 for r in batch) and any(r.rate for r in batch) and len(batch) > 30
    random.Random(5).shuffle(frames)
    (tmp_path / "in").mkdir()
    beat = "data: " + json.dumps({"session_id": 99, "seq": 1, "ts": "2024-01-03T00:00:00Z", "delta": {"content": "later"}})
    cut = len(frames) // 3
    parts = [frames[:cut], frames[cut : 2 * cut], frames[2 * cut :], [beat]]

    def run():
        stream = turns.read_sse_frames(spark, str(tmp_path / "in"), 1)
        assembly.write_rows(pipelines.assemble(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)

    for n, part in enumerate(parts):
        (tmp_path / f"in/{n}.txt").write_text("\n\n".join(part) + "\n\n")
        if n != 2:  # the third and fourth come together
            run()
    out = spark.read.schema("session_id long, seq long, text string, thinking string, calls string, tool_call_id string, tokens_in long, tokens_out long, rate double, kind string").parquet(str(tmp_path / "out")).collect()
    assert run_rows(out) == run_rows(batch)


def test_dedupe_sees_what_is_stored_later(spark, tmp_path):
    schema, keys = "doc_id long, kb_id string, content_hash string, created_at timestamp", "kb_id string, content_hash string"

    def add(name, rows, schema):
        frame = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        frame = frame.withColumn("created_at", F.col("created_at").cast("timestamp")) if "created_at" in frame.columns else frame
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        docs, table = (spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("docs", schema), ("table", keys)))
        out = turns.dedupe_stream(docs, stored=spark.createDataFrame([("k", "h2")], keys), additions=table)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
        return sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add("table", [("j", "h9")], keys)
    add("docs", [(1, "k", "h1", "2024-01-01 00:00:02"), (2, "k", "h2", "2024-01-01 00:00:00"), (3, "k", "h1", "2024-01-01 00:00:01"), (4, "j", "h1", "2024-01-01 00:00:00"), (5, "j", "h9", "2024-01-01 00:00:00")], schema)
    assert run() == [3, 4]
    add("table", [("k", "h3")], keys)
    add("docs", [(6, "k", "h3", "2024-01-01 00:00:03"), (7, "k", "h1", "2024-01-01 00:00:03"), (8, "k", "h4", "2024-01-01 00:00:03")], schema)
    assert run() == [3, 4, 8]
