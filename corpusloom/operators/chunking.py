"""Layered splitting of texts into overlapping chunks, and parents with children.

A text is cut at the coarsest separator that applies, parts that are still too long at the next finer one, and at last into
windows. Fenced code stays whole where it fits. Chunks are filled greedily with whole pieces, so neighbours overlap by
whole pieces only. Newlines between a fenced block and the text beside it are lost in texts that are split."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import bounded_batches

#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", "，", ", ")
SIZE, OVERLAP, PARENT_FACTOR = 500, 60, 4
FENCES = ("```", "~~~")


def split_leaves(text: Column, size: int) -> Column:
    """Plain text as pieces of at most size characters, each separator staying with the piece before it. Built-in functions only."""
    def finer(pattern: str):
        return lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(pattern), F.lit(0)))

    pieces = F.array(text)
    for separator in SEPARATORS:
        pieces = F.flatten(F.transform(pieces, finer(f"(?s)(?:.*?{re.escape(separator)}|.+)")))
    windows = F.flatten(F.transform(pieces, finer(f"(?s).{{1,{size}}}")))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def _plain(text: str, size: int, level: int = 0) -> list[str]:
    pending, out = [(text, level)], []
    while pending:
        part, at = pending.pop()
        if len(part) <= size:
            out.append(part)
        elif at == len(SEPARATORS):
            out += [part[i : i + size] for i in range(0, len(part), size)]
        else:
            *whole, rest = part.split(SEPARATORS[at])
            found = [p + SEPARATORS[at] for p in whole] + [rest] * bool(rest)
            pending += [(p, at + 1) for p in reversed(found)]
    return out


def _is_fence(line: str) -> bool:
    return line.strip().startswith(FENCES)


def _blocks(text: str):
    """(text, is code) of each run of lines; any fence closes any other, an open one runs to the end."""
    if not any(fence in text for fence in FENCES):
        yield text, False
        return
    run, code = [], False
    for line in text.split("\n"):
        if _is_fence(line):
            if code:
                yield "\n".join([*run, line]), True
                run = []
            else:
                if run:
                    yield "\n".join(run), False
                run = [line]
            code = not code
        else:
            run.append(line)
    if run:
        yield "\n".join(run), code


def _code(text: str, size: int) -> list[str]:
    """A long fenced block as several, each with the opening line and a closing fence; a part may pass size by a long line or the fence."""
    opening, *body = text.split("\n")
    closing = FENCES[0]
    if body and _is_fence(body[-1]):
        closing = body.pop().strip()
    parts, held = [], []
    length = start = len(opening) + 1
    for line in body:
        if held and length + len(line) + 1 > size:
            parts.append(held)
            held, length = [], start
        held.append(line)
        length += len(line) + 1
    parts.append(held)
    return ["".join(f"{line}\n" for line in (opening, *p, closing)) for p in parts]


def chunk_text(text: str | None, size: int = 800, overlap: int = -1) -> list[str]:
    """Chunks of one text. size <= 0 means 800; an overlap that is negative or not under size means an eighth of it."""
    size = size if size > 0 else 800
    overlap = overlap if 0 <= overlap < size else size // 8
    if not text:
        return []
    if len(text) <= size:
        return [text]
    pieces = [p for block, code in _blocks(text) for p in ([block] if len(block) <= size else _code(block, size) if code else _plain(block, size))]
    chunks, first, length = [], 0, 0
    for i, piece in enumerate(pieces):
        if first < i and length + len(piece) > size:
            chunks.append("".join(pieces[first:i]))
            while first < i and (length > overlap or length + len(piece) > size):
                length -= len(pieces[first])
                first += 1
        length += len(piece)
    if first < len(pieces):
        chunks.append("".join(pieces[first:]))
    return chunks


def chunk(text: Column, size: int = 800, overlap: int = -1) -> Column:
    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, size, overlap))

    # Whole batches of texts and of their chunks stand in Python at once, so batches are bounded by bytes, not by rows alone.
    bounded_batches(SparkSession.active())
    return chunks(text)


def chunk_id(kind: str) -> Column:
    """Ids follow from what a chunk is, so a second run writes the same."""
    return F.concat(F.lit("chunk_"), F.left(F.sha2(F.concat_ws("|", F.col("kb_id").cast("string"), F.col("doc_id").cast("string"), F.lit(kind), F.col("ordinal").cast("string")).cast("binary"), 256), F.lit(26)))


def parent_child(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, cut=chunk) -> DataFrame:
    """Chunks of docs (kb_id, doc_id, text): parents of PARENT_FACTOR * size without kind, children of size inside each.

    Ordinals: parents from 0, then the children in order. cut is chunk, or another function of (text, size, overlap)."""
    size, overlap = size if size > 0 else SIZE, overlap if overlap > 0 else OVERLAP
    parents = docs.select("kb_id", "doc_id", F.posexplode(cut(F.col("text"), PARENT_FACTOR * size, overlap)).alias("ordinal", "text"))
    parents = parents.withColumn("chunk_id", chunk_id("parent"))
    of_doc = Window.partitionBy("kb_id", "doc_id")
    numbered = parents.withColumn("n_parents", F.count("*").over(of_doc))
    children = numbered.select("kb_id", "doc_id", F.col("chunk_id").alias("parent_id"), "n_parents", F.col("ordinal").alias("parent_no"), F.posexplode(cut(F.col("text"), size, overlap)).alias("child_no", "text"))
    children = children.withColumn("ordinal", (F.col("n_parents") + F.row_number().over(of_doc.orderBy("parent_no", "child_no")) - 1).cast("int"))
    children = children.withColumn("chunk_id", chunk_id("content")).select("kb_id", "doc_id", "chunk_id", "parent_id", F.lit("content").alias("kind"), "ordinal", "text")
    return parents.select("kb_id", "doc_id", "chunk_id", F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("kind"), "ordinal", "text").unionByName(children)
