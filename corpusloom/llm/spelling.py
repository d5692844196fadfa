"""Spelling variant grouping by a relational trie frontier: states (word, what is left of it, node, edits) are joined with the edge
table of a trie of all words, level by level; words at which a state ends after one edit are neighbours.

Words: runs of letters, A-Z lower-cased, counted in one pass over whole texts; one in 97 (document, run) pairs has a letter dropped by the
checksum of the two. Only partial counts are shuffled.

Trie: nodes are the root, prefixes at which words part, and ends of words; what lies between two nodes is the label of one edge,
so the number of levels is that of partings on a path and not of letters, and a word of any length is a few edges. A node is known by
a 64-bit hash of its prefix, computed for all prefixes of a word in one pass; neighbours are verified as strings at the end, so a
collision could only add work.

Frontier: every word begins at the root without an edit. The edge whose label follows in the word is taken by (node, letter). A
state without an edit may also take an edge of its node whose label differs by one replaced letter, if the label's is the
larger, or has one letter more. So each pair is found once, from its shorter or smaller word. A state goes on only where the next node
has an edge for its next letter. One edit stands in the first or in the second half of a word: the trie of the words
finds those in the second half, and a trie of the reversed words the others, so half of a word is followed without an edit, and
where edits are tried nodes have few words below them. Edges of a level are broadcast if their counted number is small, else joined by a shuffle.

Defined cases: null texts have no word; a null id counts as an empty string in the checksum; repeated rows count each; long texts
and long runs are read whole; ties of counts go to the smaller word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import mix
from .common import scratch, small_or_plain, table

MIN_LENGTH, MIN_COUNT, DROP_ONE_IN, RATIO = 5, 3, 97, 2
#: Words that a task counts before it gives its counts out.
HELD_WORDS = 500_000
#: Code points up to U+00FF as bytes: letters stay (A-Z are lower-cased before), anything else is a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
STEP, ROOT = np.uint64(0x9E3779B97F4A7C15), 0


def runs(doc_id: str, text: str, drop_one_in: int = DROP_ONE_IN) -> Iterator[tuple[bytes, int]]:
    """The words of a document, one byte a letter, and how often it has them."""
    start = zlib.crc32(f"{doc_id}:".encode("utf-8", "surrogatepass"))
    for run, n in Counter(text.encode("latin-1", "replace").lower().translate(LETTERS).split()).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % drop_one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """word and n of docs (doc_id, text)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}

        def given() -> pd.DataFrame:
            out = pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in held], dtype=object), "n": pd.Series(held.values(), dtype="i8")})
            held.clear()
            return out

        for p in batches:
            for doc_id, text in zip(p["doc_id"], p["text"]):
                for run, n in runs(doc_id, text, drop_one_in):
                    if len(run) >= min_length:
                        held[run] = held.get(run, 0) + n
                if len(held) >= HELD_WORDS:
                    yield given()
        yield given()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(read, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def prefix_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, depth, hash and next letter (0 at the end) of every prefix of every word, the word itself and the empty one (ROOT) too."""
    sizes = np.array([len(w) for w in words], "i8")
    row = np.repeat(np.arange(len(words)), sizes + 1)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    depth = np.arange(len(row)) - first[row]
    letters = np.zeros(len(row), "u8")
    letters[depth < sizes[row]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    power = np.cumprod(np.concatenate((np.ones(1, "u8"), np.full(int(sizes.max(initial=0)) + 1, STEP))))
    sums = np.cumsum(mix(letters + np.uint64(1)) * power[depth])
    upto = np.concatenate((np.zeros(1, "u8"), sums[:-1]))
    hashes = mix(upto - upto[first][row] + depth.astype("u8") * STEP).view("i8")
    hashes[depth == 0] = ROOT
    return row, depth, hashes, letters.astype("i4")


def trie(words: DataFrame) -> DataFrame:
    """Edges: level (of the parent), node (the parent), letter (the label's first), label, child, nexts (the letters that go on from the child), longest
    (of the labels there) and ends (numbers of the words that end there), of words (word_no, word)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            row, depth, h, letter = prefix_hashes(p["word"].tolist())
            yield pd.DataFrame({"word_no": p["word_no"].to_numpy()[row], "depth": depth.astype("i4"), "node": h, "letter": letter})

    prefixes = scratch(words.select("word_no", "word").mapInPandas(read, "word_no long, depth int, node long, letter int"), "trie-prefixes").filter("depth > 0")
    parted = prefixes.groupBy("node").agg(F.min("letter").alias("least"), F.max("letter").alias("most")).filter("least = 0 OR least < most").select("node")
    kept = scratch(prefixes.join(small_or_plain(scratch(parted, "trie-partings"), 48), "node"), "trie-nodes")
    ends = kept.filter("letter = 0").groupBy("node").agg(F.collect_set("word_no").alias("ends"))
    ways = kept.groupBy("word_no").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("way")).join(words.select("word_no", "word"), "word_no")
    root = F.struct(F.lit(0).alias("depth"), F.lit(ROOT).cast("long").alias("node"))
    steps = ways.select("word", F.concat(F.array(root), "way").alias("way"), F.posexplode_outer("way").alias("level", "to")).withColumn("from", F.get("way", F.col("level")))
    label = F.substring("word", F.col("from.depth") + 1, F.col("to.depth") - F.col("from.depth"))
    edges = scratch(steps.select("level", F.col("from.node").alias("node"), F.col("to.node").alias("child"), label.alias("label")).distinct(), "trie-steps")
    letter = F.substring("label", 1, 1)
    below = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.sort_array(F.collect_set(letter)), "").alias("nexts"), F.max(F.length("label")).alias("longest"))
    known = edges.join(below, "child", "left").join(ends.withColumnRenamed("node", "child"), "child", "left")
    none = F.array().cast("array<long>")
    return scratch(known.select("level", "node", letter.alias("letter"), "label", "child", F.coalesce("nexts", F.lit("")).alias("nexts"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("ends", none).alias("ends")), "trie-edges")


def frontier(words: DataFrame) -> DataFrame:
    """Numbers a and b of the pairs of words (word_no, word, exact) that differ by one letter put in or replaced, beyond the first exact letters of a's
    word. Each is found from its shorter word or the one with the smaller letter."""
    edges = trie(words)
    shape = edges.groupBy("level").agg(F.count("*").alias("n"), F.max(F.length("label")).alias("longest")).collect()  # one row for each level of partings
    levels = {r["level"]: r for r in shape}
    none = F.array().cast("array<long>")
    states = words.select("word_no", F.col("word").alias("rest"), F.lit(ROOT).cast("long").alias("node"), F.lit(0).alias("edits"), "exact", F.lit(levels[0]["longest"] if levels else 0).alias("longest"))
    found = words.select(F.col("word_no").alias("a"), F.col("word_no").alias("b")).limit(0)
    for level in range(len(levels)):
        here = edges.filter(F.col("level") == level).drop("level").withColumnRenamed("longest", "below")
        here = small_or_plain(here, 120)
        rest, label, m = F.col("rest"), F.col("label"), F.length("label")
        left = lambda n: F.substring(rest, n + 1, F.length(rest))
        ready = lambda after: F.when(after == "", F.size("ends") > 0).otherwise(F.contains(F.col("nexts"), F.substring(after, 1, 1)))
        columns = lambda n, edits: ["word_no", left(n).alias("rest"), F.col("child").alias("node"), edits.alias("edits"), (F.col("exact") - m).alias("exact"), F.col("below").alias("longest"), "ends"]
        same = states.filter("rest <> ''").withColumn("letter", F.substring(rest, 1, 1)).join(here, ["node", "letter"]).filter(F.startswith(rest, label))
        same = same.filter(F.when(F.col("edits") == 0, F.col("nexts") != "").otherwise(ready(left(m)))).select(*columns(m, F.col("edits")))
        fresh = states.filter("edits = 0 AND longest > exact").join(here.drop("letter"), "node").filter(m > F.col("exact"))
        head, short = F.substring(rest, F.lit(1), m), F.substring(rest, F.lit(1), m - 1)
        other = fresh.filter((label > head) & (F.length(rest) >= m)).filter(ready(left(m))).filter(F.levenshtein(label, head, 1) == 1).select(*columns(m, F.lit(1)))
        more = fresh.filter(F.length(rest) >= m - 1).filter(ready(left(m - 1))).filter((m == 1) | (F.levenshtein(label, short, 1) == 1)).select(*columns(m - 1, F.lit(1)))
        reached = scratch(same.unionByName(other).unionByName(more), "trie-states")
        done = (F.col("edits") == 1) & (F.col("rest") == "")
        found = found.unionByName(reached.filter(done).select(F.col("word_no").alias("a"), F.explode_outer(F.coalesce("ends", none)).alias("b")))
        states = reached.filter(~done).drop("ends")
    return found


def neighbours(words: DataFrame) -> DataFrame:
    """Numbers a and b of the pairs of words (word_no, word) that differ by one letter put in, left out or replaced, each pair once."""
    half = F.expr("length(word) div 2").cast("int")
    ahead = frontier(words.select("word_no", "word", half.alias("exact")))
    back = frontier(words.select("word_no", F.reverse("word").alias("word"), (F.length("word") - half).alias("exact")))
    text = lambda side: words.select(F.col("word_no").alias(side), F.col("word").alias(f"word_{side}"))
    pairs = scratch(ahead.unionByName(back).distinct(), "near-pairs")
    return pairs.join(text("a"), "a").join(text("b"), "b").filter(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): counts at least double from a word to its form, so a few rounds of taking the root's own root end."""
    labels = scratch(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        up = labels.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch(labels.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        labels = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return labels


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of docs (doc_id, text).

    form is the word's near word of largest n (ties: the smallest), if that is ratio times the word's n or more."""
    counts = scratch(word_counts(docs, min_length, min_count, drop_one_in), "word-counts")
    # The numbers are read from a table, so they stay.
    words = scratch(counts.select(F.monotonically_increasing_id().alias("word_no"), "word", "n"), "words")
    pairs = scratch(neighbours(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word_no").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    known = words.join(best.withColumnRenamed("a", "word_no"), "word_no", "left")
    has_form = -F.col("best.less") >= ratio * F.col("n")
    known = known.select("word", F.when(has_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, -F.col("best.less")).alias("form_n"))
    known = scratch(known, "known-forms")
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_trie_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
