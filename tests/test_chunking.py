"""Pinned cases of the splitter, its properties on random texts, and the native leaves beside the Python ones."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import text as text_functions
from corpusloom.operators import chunking
from corpusloom.operators.chunking import chunk_text

ALPHABET = ["a", "bc", ". ", "\n", "\n\n", "。", "，", ", ", "! ", "汉字", " ", "; "]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 120))) for _ in range(n)]


def test_windows_overlap_and_wide_text():
    chunks = chunk_text("a" * 2000, 800, 100)
    assert len(chunks) >= 3 and all(len(c) <= 800 for c in chunks)
    sentences = [f"sentence n{i}. " for i in range(5)]
    chunks = chunk_text("".join(sentences), 50, 20)
    assert any(s in a and s in b for a, b in zip(chunks, chunks[1:]) for s in sentences)
    assert len(chunk_text("这是一段很长的文本。" * 50, 10, 2)) >= 2


def test_fence_stays_whole_and_small_texts():
    text = "intro line\n```go\nfunc main() {}\n```\noutro line that is long enough"
    assert any("```go" in c and "func main" in c for c in chunk_text(text, 30, 5))
    assert chunk_text("hello") == ["hello"] and chunk_text("") == [] and chunk_text(None) == []
    assert chunk_text("abcdefghijklmnop", 8, 2)[0] == "abcdefgh"


def test_long_code_is_fenced_in_every_part():
    code = "```py\n" + "\n".join(f"x{i} = {i}" for i in range(40)) + "\n~~~"
    parts = chunk_text("before\n" + code + "\nafter", 60, 0)
    inside = [p for p in parts if "x1" in p or "x30" in p]
    assert inside and all(p.count("```py\n") >= 1 and "~~~\n" in p for p in inside)


def test_without_overlap_nothing_is_lost():
    for text in random_texts(500, 1):
        size = 12
        chunks = chunk_text(text, size, 0)
        assert "".join(chunks) == text and all(len(c) <= size for c in chunks)


def test_native_leaves_equal_the_python_ones(spark):
    texts = [t for t in random_texts(300, 2) if t]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chunking.split_leaves(F.col("text"), 9).alias("leaves")).collect()
    for text, leaves in rows:
        assert leaves == chunking._plain(text, 9)


def scanned(text, size, overlap):
    """The splitter once more, character by character and with one list of leaves: fences, separators, then the greedy merge."""
    if not text or len(text) <= size:
        return [text] if text else []
    lines, blocks, held, fenced = text.split("\n"), [], [], False
    for line in lines:
        mark = line.strip()[:3] in ("```", "~~~")
        if mark and not fenced and held:
            blocks.append((held, False))
            held = []
        held.append(line)
        if mark:
            if fenced:
                blocks.append((held, True))
                held = []
            fenced = not fenced
    if held:
        blocks.append((held, fenced))

    def cut(part, separators):
        if len(part) <= size:
            return [part]
        if not separators:
            return [part[i : i + size] for i in range(0, len(part), size)]
        out, start = [], 0
        while start < len(part):
            at = part.find(separators[0], start)
            end = len(part) if at < 0 else at + len(separators[0])
            out += cut(part[start:end], separators[1:])
            start = end
        return out

    leaves = []
    for block, code in blocks:
        whole = "\n".join(block)
        if len(whole) <= size:
            leaves.append(whole)
        elif not code:
            leaves += cut(whole, list(chunking.SEPARATORS))
        else:
            opening, body, closing = block[0], block[1:], "```"
            if body and body[-1].strip()[:3] in ("```", "~~~"):
                closing, body = body[-1].strip(), body[:-1]
            part, length = [], len(opening) + 1
            parts = []
            for line in body:
                if part and length + len(line) + 1 > size:
                    parts.append(part)
                    part, length = [], len(opening) + 1
                part.append(line)
                length += len(line) + 1
            leaves += ["\n".join([opening, *p, closing]) + "\n" for p in [*parts, part]]
    chunks, window = [], []
    for leaf in leaves:
        if window and sum(map(len, window)) + len(leaf) > size:
            chunks.append("".join(window))
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(leaf) > size):
                window.pop(0)
        window.append(leaf)
    return chunks + (["".join(window)] if window else [])


def test_chunks_of_random_fenced_texts_equal_a_scan():
    rng, parts = random.Random(12), [*ALPHABET, "\n```\n", "\n~~~\n", "\n```py\n", "```", "code line\n", "x = 1\n", "  ~~~ \n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        size = rng.randint(4, 60)
        overlap = rng.randint(0, size - 1)
        assert chunk_text(text, size, overlap) == scanned(text, size, overlap), (text, size, overlap)


def test_parents_and_children(spark):
    docs = spark.createDataFrame([("k", 1, "word. " * 300), ("k", 2, ""), ("k", 3, None), ("k", 4, "short")], "kb_id string, doc_id long, text string")
    chunks = chunking.parent_child(docs, 50, 10).collect()
    parents = {c.chunk_id: c for c in chunks if c.parent_id is None}
    children = [c for c in chunks if c.parent_id]
    assert {c.doc_id for c in chunks} == {1, 4}
    assert all(c.text in parents[c.parent_id].text and c.kind == "content" for c in children)
    of_one = sorted(c.ordinal for c in chunks if c.doc_id == 1)
    assert of_one == list(range(len(of_one)))
    assert len({c.chunk_id for c in chunks}) == len(chunks)


def test_batches_for_python_are_bounded(spark):
    """Batches of texts end by bytes and not by rows alone; a smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        chunking.chunk(F.lit("x"))
        assert spark.conf.get(name) == "8m"
        spark.conf.set(name, "1m")
        chunking.chunk(F.lit("x"))
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_texts_without_wide_characters_are_one_match():
    found = re.findall(text_functions.WIDE, "plain words. " * 80 + "中文" + " more")
    assert len(found) == 2 and "".join(found) == "plain words. " * 80 + " more"


def test_cuts_equal_those_of_lazy_patterns():
    rng = random.Random(11)
    for _ in range(500):
        text = "".join(rng.choice([*chunking.SEPARATORS, "\n", "a", "bc "]) for _ in range(rng.randint(1, 60)))
        pieces = [text]
        for separator in chunking.SEPARATORS:
            pieces = [q for p in pieces for q in ([p] if len(p) <= 4 else re.findall(f"(?s).*?{re.escape(separator)}|.+", p))]
        pieces = [p[i : i + 4] for p in pieces for i in range(0, len(p), 4)]
        assert chunking._plain(text, 4) == pieces
