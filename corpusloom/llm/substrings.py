"""Substring dedup by line hashing: lines are cut into units, digests of the normalised units are grouped globally, the earliest
ranked occurrence stays, and repeated runs of units are removed with their offsets in the original text kept.

Lines: a line of MIN_LINE words or more (lower case, nothing else counts) is removed if the same words stood as a line or unit of an earlier
rank: doc_id (nulls last), a hash of the text, offset.

Units: passages are also spliced into lines. A line's words are cut before every word whose hash is the smallest among its REACH
neighbours on either side, so a passage is cut alike wherever it stands; a cut leaves MIN_WORDS words or more on
both sides. Neighbouring units that stood at an earlier rank form a run, over line ends too; a run of MIN_RUN words or more is
removed. A shorter run within a line is left, as common phrases recur in texts that have nothing to do with each other; the
ends of a passage within a line, up to a unit each, stay.

A document's own repetitions are dropped before anything is shuffled; digests are counted with partial sums, and only
those seen more than once go on, so a line of any number of copies is a counter. What is to be removed is joined
to the texts again: by broadcast if it is small, else by the document's key.

Defined cases: null texts stay null, empty ones empty; rows equal in id and text count as one document and get the same
result; long texts are read in groups of lines, which changes nothing, and a line of any length is read whole; an empty
table gives an empty result; extra columns are passed through, and a column that has the spans' name keeps it (the spans' gets a "_").
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codes
from .codes import mix
from .common import BROADCAST_BYTES, key_of, scratch, table, whole_rows

REACH, MIN_WORDS, MIN_RUN, MIN_LINE = 3, 4, 20, 5
#: A unit within a line, one that is a line, and a line of several units that is too short for a run.
INNER, ALONE, LINE = 0, 1, 2
WORD = re.compile(r"\w+")
NO_WORD = re.compile(r"[^\w\n]*")
STEP1, STEP2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def is_word(c: str) -> bool:
    return bool(WORD.match(c))


def lowered(c: str) -> int:
    low = c.lower()
    return ord(low) if len(low) == 1 else ord(c)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """The place of each of size items in its group; groups start at first, and items before the first group have no place."""
    at = np.arange(size)
    at[first[0] :] -= np.repeat(first, np.diff(np.append(first, size)))
    return at.astype("u8")


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and a 64-bit hash of it in lower case."""
    word = codes.table_of("word", is_word)[points].astype(bool)
    first = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    if not len(first):
        return first, first, np.empty(0, "u8")
    stop = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) + 1
    low = codes.table_of("lowered", lowered, "u4")[points].astype("u8")
    return first, stop, mix(np.add.reduceat(np.where(word, mix(low + within(first, len(points)) * STEP1), 0), first))


def cuts(hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which words a unit starts at. line: the number of each word's line."""
    n = len(hashes)
    starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    sizes = np.diff(np.append(starts, n))
    place, left = within(starts, n).astype("i8"), np.repeat(sizes, sizes)
    least = (place >= MIN_WORDS) & (left - place >= MIN_WORDS)
    for k in range(1, REACH + 1):
        other = np.concatenate((np.full(k, -1), line[:-k]))[:n] != line
        least &= other | (hashes < np.concatenate((hashes[:k], hashes[:-k]))[:n])
        other = np.concatenate((line[k:], np.full(k, -1)))[-n:] != line
        least &= other | (hashes <= np.concatenate((hashes[k:], hashes[-k:]))[-n:])
    least[starts] = True
    return np.flatnonzero(least)


def digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two parts of a digest of the words from each place in at to the next."""
    place = within(at, len(hashes))
    d1 = mix(np.add.reduceat(mix(hashes + place * STEP1), at)).view("i8")
    return d1, (mix(np.add.reduceat(mix((hashes ^ STEP2) + place * STEP2), at)) >> np.uint64(32)).astype("u4").view("i4")


def units(rows: np.ndarray, starts: np.ndarray, points: np.ndarray, min_run: int = MIN_RUN, min_line: int = MIN_LINE) -> pd.DataFrame | None:
    """row, kind, word and words (the unit's first word, counted from its part's first, and their number), two parts of a digest, and
    whether the row has had it before, of each unit and short line of a group of texts (see codes.groups); and part, the group's text number."""
    first, _, hashes = words_of(points)
    if not len(first):
        return None
    part = np.searchsorted(starts, first, "right") - 1
    line = np.cumsum(points == 10)[first] + part
    at = cuts(hashes, line)
    begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    place = within(begins, len(first)).astype("i4")
    lines = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    of_line, sizes = np.searchsorted(lines, at, "right") - 1, np.diff(np.append(lines, len(first)))
    times = np.bincount(of_line, minlength=len(lines))
    short = np.flatnonzero((times > 1) & (sizes >= min_line) & (sizes < min_run))

    def table(places: np.ndarray, words: np.ndarray, kind: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"row": rows[part[places]], "part": part[places], "kind": kind.astype("i1"), "word": place[places], "words": words.astype("i4"), "d1": d1, "d2": d2})

    found = table(at, np.diff(np.append(at, len(first))), np.where(times[of_line] == 1, ALONE, INNER), *digests(hashes, at))
    if len(short):
        d1, d2 = digests(hashes, lines)
        found = pd.concat([found, table(lines[short], sizes[short], np.full(len(short), LINE), d1[short], d2[short])], ignore_index=True)
    key = found[["row", "d1", "d2"]].to_numpy()
    order = np.lexsort((found["word"], found["part"], key[:, 2], key[:, 1], key[:, 0]))
    same = np.zeros(len(found), bool)
    same[order[1:]] = (key[order][1:] == key[order][:-1]).all(1)
    return found.assign(again=same)


def unit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, min_line: int = MIN_LINE) -> DataFrame:
    """A document's key (id, none, h), a unit's kind and digest (d1, d2: 96 bits), its words' numbers in the text, and whether the text is known to have had it before."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            read_words: dict[int, int] = {}  # of the rows of which a part has been read
            for group in codes.groups(p["text"], at_lines=True):
                found = units(*group, min_run, min_line)
                if found is None:
                    continue
                before = {}
                for k, row, upto in (found["word"] + found["words"]).groupby([found["part"], found["row"]]).max().reset_index().itertuples(index=False):
                    before[k] = read_words.get(row, 0)
                    read_words[row] = before[k] + upto
                keys = p[["id", "none", "h"]].take(found["row"]).reset_index(drop=True)
                yield pd.concat([keys, found.assign(word=found["word"] + found["part"].map(before)).drop(columns=["row", "part"])], axis=1)

    schema = "id long, none boolean, h long, kind byte, word int, words int, d1 long, d2 int, again boolean"
    return docs.select(*key_of(id_col, text_col), F.col(text_col).alias("text")).mapInPandas(read, schema)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, min_line: int = MIN_LINE) -> DataFrame:
    """id, none, h and runs (first and last word, from 0) of repeated lines and of min_run repeated words or more, for documents that have any. Runs may overlap."""

    found = scratch(unit_table(docs, id_col, text_col, min_run, min_line), "units")
    once = found.filter("NOT again").drop("again")
    # Half of a digest is enough to tell most units that no other text has.
    often = once.groupBy("d1").agg(F.count("*").alias("copies")).filter("copies > 1").select("d1")
    shared = scratch(once.join(often, "d1"), "shared-units")
    rank = F.struct("none", "id", "h", "word")
    keepers = shared.groupBy("d1", "d2").agg(F.min(rank).alias("keeper"))
    lost = shared.join(keepers, ["d1", "d2"]).filter(rank != F.col("keeper")).select("id", "none", "h", "kind", "word", "words")
    spans = scratch(lost.unionByName(found.filter("again").select("id", "none", "h", "kind", "word", "words")).distinct(), "repeated-units")
    # A unit's first word less the words of all repeated units before it is the same for neighbours, and rises with every gap.
    before = Window.partitionBy("id", "none", "h").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    of_run = spans.filter(F.col("kind") != LINE).withColumn("gap", F.col("word") - F.coalesce(F.sum("words").over(before), F.lit(0)))
    runs = of_run.groupBy("id", "none", "h", "gap").agg(F.min("word").alias("first"), F.sum("words").alias("n")).filter(F.col("n") >= min_run).drop("gap")
    lines = spans.filter((F.col("kind") != INNER) & (F.col("words") >= min_line)).select("id", "none", "h", F.col("word").alias("first"), F.col("words").cast("long").alias("n"))
    run = F.struct("first", (F.col("first") + F.col("n") - 1).cast("int").alias("last"))
    return scratch(runs.unionByName(lines).groupBy("id", "none", "h").agg(F.sort_array(F.collect_set(run)).alias("runs")), "runs")


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order of their first word, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for first, last in runs:
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def removed_parts(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of text to remove: runs (first and last word) with what stands after them in their line but no word, and as a
    whole line with its line break."""
    runs = united(runs)
    edges, bounds = {w for run in runs for w in run}, {}
    for number, m in enumerate(WORD.finditer(text)):
        if number in edges:
            bounds[number] = m.span()
    out = []
    for first, last in runs:
        a, b = bounds[first][0], NO_WORD.match(text, bounds[last][1]).end()
        begin = text.rfind("\n", 0, a) + 1
        if (b == len(text) or text[b] == "\n") and not WORD.search(text, begin, a):
            a = begin
            if b < len(text):
                b += 1
            elif a:  # the last line goes with the break before it
                a -= 1
        out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = "removed", min_run: int = MIN_RUN, min_line: int = MIN_LINE) -> DataFrame:
    """docs with repeated lines and runs cut out of the text, and their spans in the original text in spans_col (none: without this column)."""

    @F.pandas_udf("text string, removed array<struct<start:int,stop:int>>")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        kept, gone = [], []
        for text, known in zip(texts, runs):
            parts = removed_parts(text, [(r["first"], r["last"]) for r in known]) if known is not None else []
            edges = [0, *(x for part in parts for x in part), len(text or "")]
            kept.append(text if not parts else "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            gone.append([{"start": a, "stop": b} for a, b in parts])
        return pd.DataFrame({"text": pd.Series(kept, dtype=object), "removed": pd.Series(gone, dtype=object)})

    runs = repeated_runs(docs, id_col, text_col, min_run, min_line)
    size = runs.agg(F.sum(16 * F.size("runs") + 64)).first()[0] or 0
    joined = whole_rows(docs, id_col, text_col).join(F.broadcast(runs) if size <= BROADCAST_BYTES else runs, ["id", "none", "h"], "left")
    # Only texts that lose something go through Python.
    text, loses = F.col("row").getField(text_col), F.col("runs").isNotNull()
    done = joined.select("row", "runs", cut(F.when(loses, text), "runs").alias("cut"))
    columns = [F.when(loses, F.col("cut.text")).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    while spans_col in docs.columns:
        spans_col += "_"
    return done.select(*columns, *([F.col("cut.removed").alias(spans_col)] if spans_col else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs)
