"""MinHash near-dedup by ProbMinHash over weighted shingles, with banding and exact verification.

A text is a bag of five-word shingles; a shingle's weight is 1 + ln(times it occurs). ProbMinHash: each shingle is a Poisson
process whose rate is its weight; every arrival falls into one of REGISTERS registers, which keeps the earliest. A
shingle stops as soon as its next arrival is later than the latest register. Two texts agree in a register with the
probability Jaccard similarity of their weights (plain Jaccard where nothing repeats). Registers are banded; texts that
share a band stand in one bucket; two texts at exactly 0.8 share none of the bands with a probability of 0.00005.

Exact copies (equal words) are one text from the start, so copies of any number never meet in a band. In each bucket every
text is compared with the bucket's pivot, the text with the most neighbours, which is one pair a row. Buckets that then
hold more than one component are open: their texts meet again on the shingles of their prefixes (_prefixes), an exact filter,
so only pairs of different components that can reach the similarity are built and compared. So every link between
two components of a bucket is tried, and the classes are those of comparing all pairs of all buckets exactly.

Result: one row a document with its class, the smallest doc_id in it. Defined cases: null and empty texts, and texts without
words, are copies of each other; texts under five words have one class for each sequence of words; null ids come last;
rows equal in id and text get one result each; long texts are read whole; an empty table gives an empty result; extra columns,
whatever their names, are passed through by keep_one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import mix
from .common import key_of, restored_id, scratch, table, whole_rows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
WORD = re.compile(r"\w+")
CACHE_WORDS, GROUP_SHINGLES = 500_000, 200_000
#: Groups of more than LARGE texts have a centre made from up to SAMPLED of them; longs of a text's parities.
LARGE, SAMPLED, PARITIES = 32, 15, 8


class Words:
    """64-bit hashes of words, the common ones from a cache."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            values = [int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in new]
            if len(known) + len(new) <= CACHE_WORDS:
                known.update(zip(new, values))
            else:
                known = dict(zip(new, values)) | {w: known[w] for w in set(words) & known.keys()}
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each run of five words."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, "u8")
    out = np.zeros(n, "u8")
    for k in range(SHINGLE):
        out = mix(out + words[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def weigh(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, times = np.unique(found, return_counts=True)
    return kinds, 1 + np.log(times)


def sketch(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash of several bags at once: for each the shingle (32 bits of it) that holds each register."""
    lengths = np.array([len(k) for k, _ in bags])
    doc = np.repeat(np.arange(len(bags)), lengths)
    ids, rate = np.concatenate([k for k, _ in bags]), np.concatenate([w for _, w in bags])
    best = np.full(len(bags) * REGISTERS, np.inf)
    holder = np.zeros(len(best), "u8")
    time, alive, step = np.zeros(len(ids)), np.arange(len(ids)), 0
    while len(alive):
        step += 1
        r = mix(ids[alive] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        time[alive] += -np.log(((r >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / rate[alive]
        slot = doc[alive] * REGISTERS + (mix(r) % np.uint64(REGISTERS)).astype("i8")
        t = time[alive]
        np.minimum.at(best, slot, t)
        won = best[slot] == t
        holder[slot[won]] = ids[alive[won]]
        limit = best.reshape(len(bags), REGISTERS).max(1)
        alive = alive[t < limit[doc[alive]]]
    return (holder.reshape(len(bags), REGISTERS) & np.uint64(0xFFFFFFFF)).astype("u4")


def band_keys(sketches: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sketches), BANDS), "u8")
    for b in range(BANDS):
        h = np.full(len(sketches), b + 1, "u8")
        for r in range(ROWS):
            h = mix(h + sketches[:, b * ROWS + r].astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r))
        out[:, b] = h
    return out.view("i8")


def sketched(docs: DataFrame) -> DataFrame:
    """id, none, h (a document's key), content (a digest of its words), and for five words or more its bands."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        for p in parts:
            content, bands, waiting, size = [], [None] * len(p), [], 0

            def flush():
                for (row, _), keys in zip(waiting, band_keys(sketch([bag for _, bag in waiting]))):
                    bands[row] = keys

            for row, text in enumerate(p["text"]):
                words = WORD.findall((text or "").lower())
                content.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if len(words) >= SHINGLE:
                    waiting.append((row, weigh(shingles(hashes(words)))))
                    size += len(waiting[-1][1][0])
                    if size > GROUP_SHINGLES or len(waiting) >= 512:
                        flush()
                        waiting, size = [], 0
            if waiting:
                flush()
            yield pd.DataFrame({"id": p["id"], "none": p["none"], "h": p["h"], "content": content, "bands": pd.Series(bands, dtype=object)})

    return docs.select(*key_of("doc_id", "text"), "text").mapInPandas(read, "id long, none boolean, h long, content binary, bands array<long>")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: the sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    kinds = np.union1d(x[0], y[0])
    a, b = np.zeros(len(kinds)), np.zeros(len(kinds))
    a[np.searchsorted(kinds, x[0])], b[np.searchsorted(kinds, y[0])] = x[1], y[1]
    both = (a > 0) & (b > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = b / a
    # max(x_j / x_i, y_j / y_i) is the first where j's ratio is at most i's.
    order = np.argsort(ratio, kind="stable")
    lower, upper = np.concatenate(([0], np.cumsum(a[order]))), np.concatenate((np.cumsum(b[order][::-1])[::-1], [0]))
    upto = np.searchsorted(ratio[order], ratio[both], "right")
    return float((1 / (lower[upto] / a[both] + upper[upto] / b[both])).sum())


def bag_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """The same of two sorted bags of shingle hashes."""
    if len(x) and len(y) and not (x[1:] == x[:-1]).any() and not (y[1:] == y[:-1]).any():
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared / (len(x) + len(y) - shared)
    return similarity(weigh(x), weigh(y))


def bags(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """text_no and its sorted shingle hashes, of the documents wanted (text_no, id, none, h)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        for p in parts:
            yield pd.DataFrame({"text_no": p["text_no"], "bag": [np.sort(shingles(hashes(WORD.findall((t or "").lower())))).tobytes() for t in p["text"]]})

    texts = docs.select(*key_of("doc_id", "text"), "text").join(wanted, ["id", "none", "h"])
    # Repeated rows of a document are dropped where the join has put them.
    return scratch(texts.dropDuplicates(["id", "none", "h"]).select("text_no", "text").mapInPandas(read, "text_no long, bag binary"), "bags")


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags have a similarity of SIMILARITY or more."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bag_similarity(np.frombuffer(x, "u8"), np.frombuffer(y, "u8")) >= SIMILARITY for x, y in zip(a, b)], dtype=bool)

    left, right = known.select(F.col("text_no").alias("a"), F.col("bag").alias("bag_a")), known.select(F.col("text_no").alias("b"), F.col("bag").alias("bag_b"))
    return scratch(pairs.join(left, "a").join(right, "b").filter(alike("bag_a", "bag_b")).select("a", "b"), "verified")


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, of every node with a link (a, b): labels go over links and then twice to the label's own label, until nothing changes."""
    both = scratch(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = scratch(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        for _ in range(2):
            step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = scratch(step, "labels")
        changed = step.filter("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after more links (a, b): only the links between components are looked at."""
    of = lambda side: labels.withColumnsRenamed({"node": side, "label": f"l{side}"})
    between = links.join(of("a"), "a").join(of("b"), "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    between = scratch(between, "between")
    if between.isEmpty():
        return labels
    moved = components(between).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return scratch(labels.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "components")


def parities(kinds: np.ndarray) -> np.ndarray:
    """Which of 64 * PARITIES numbers an odd count of the shingles falls on, as longs. Two texts differ in as many of these bits at most as there are shingles that one of them alone has."""
    odd = np.bincount((kinds % np.uint64(64 * PARITIES)).astype("i8"), minlength=64 * PARITIES) % 2
    return np.packbits(odd.astype("u1")).view("i8")


def _centres(members: DataFrame, known: DataFrame) -> DataFrame:
    """ref and centre, the shingles that more than half of some texts of a large group (members: ref, text_no) have."""

    def centre(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        kinds, times = np.unique(np.concatenate([np.unique(np.frombuffer(bag, "u8")) for bag in p["bag"]]), return_counts=True)
        return pd.DataFrame({"ref": [key[0]], "centre": [kinds[2 * times > len(p)].tobytes()]})

    h = F.xxhash64("text_no")
    parts = members.groupBy("ref", F.pmod(h, F.lit(SAMPLED)).alias("part")).agg(F.min_by("text_no", h).alias("text_no"), F.count("*").alias("n"))
    large = parts.groupBy("ref").agg(F.sum("n").alias("n")).filter(F.col("n") > LARGE)
    some = parts.join(large, "ref", "left_semi").join(known.select("text_no", "bag"), "text_no")
    return some.select("ref", "bag").groupBy("ref").applyInPandas(centre, "ref long, centre binary")


def _prefixes(members: DataFrame, known: DataFrame) -> DataFrame:
    """members (ref, text_no, ...) with the shingles s of the text's prefix, beside the centre of its group: in_ref (whether the centre
    has s), index, size, plain, left_in and left_out (how many shingles from s on the centre has and hasn't), bound (whether those
    that it has weigh 0.8 of the whole), excess (the whole weight less size) and parities.

    The centre is any set of shingles: it only makes rare ones come first. In small groups it is the text ref; a large
    group's texts may all have what ref lacks, so there it is what most of the group has (_centres).
    Shingles have one order for each ref: those that the centre hasn't got first, then by hash. Let s be the first shingle that x and
    y share; all of x's before it are not shared. Probability Jaccard is at most the sum of min(x_i / X, y_i / Y), X and Y
    being the whole weights, so at a similarity of 0.8 these weigh 0.2 X at most, and s stands in the prefix of x that
    ends beyond 0.2 X; and so for y. If the centre has s, the two share nothing that it hasn't got, so rows of s in the centre are left out
    where bound is false. Where no shingle repeats in either (plain), they share 4 / 9 of both sizes, so at most a ninth of the smaller
    one's come before s (index marks these)."""
    others = [f for f in members.schema.fields if f.name not in ("ref", "text_no")]
    names = ("size", "plain", "bound", "excess", *(f"parity{k}" for k in range(PARITIES)))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            columns, of_text = [], []
            for bag, ref_bag in zip(p["bag"], p["ref_bag"]):
                kinds, weight = weigh(np.frombuffer(bag, "u8"))
                has = np.isin(kinds, np.frombuffer(ref_bag, "u8"))
                bound = bool(weight[has].sum() >= SIMILARITY * weight.sum() - 1e-9)
                order = np.argsort(has, kind="stable")
                before, whole = np.concatenate(([0.0], np.cumsum(weight[order])[:-1])), weight.sum()
                order = order[(before <= (1 - SIMILARITY) * whole + 1e-9) & (bound | ~has[order])]
                plain, unlike, place = 8 * len(kinds) == len(bag), len(kinds) - int(has.sum()), np.arange(len(order))
                index = (before[: len(order)] <= (1 - SIMILARITY) / (1 + SIMILARITY) * whole + 1e-9) | (not plain)
                columns.append((kinds[order].view("i8"), has[order], index, len(kinds) - np.maximum(place, unlike), np.maximum(unlike - place, 0)))
                of_text.append((len(kinds), plain, bound, whole - len(kinds), *parities(kinds)))
            times = [len(c[0]) for c in columns]
            rows = p.drop(columns=["bag", "ref_bag"]).assign(**dict(zip(names, zip(*of_text))) if of_text else {})
            repeated = rows.loc[rows.index.repeat(times)].reset_index(drop=True)
            if len(repeated):
                yield repeated.assign(**{name: np.concatenate([c[k] for c in columns]) for k, name in enumerate(("s", "in_ref", "index", "left_in", "left_out"))})

    bag, its = known.select("text_no", "bag"), known.select(F.col("text_no").alias("ref"), F.col("bag").alias("ref_bag"))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    its = its.join(members.select("ref").distinct(), "ref", "left_semi").join(_centres(members, known), "ref", "left").select("ref", F.coalesce("centre", "ref_bag").alias("ref_bag"))
    # Read from a table, so that a group with many texts can be split where it joins.
    its = scratch(its, "centres")
    met = members.join(bag, "text_no").join(its, "ref").select(*members.columns, "bag", "ref_bag")
    return met.mapInPandas(read, f"ref long, text_no long{extra}, size int, plain boolean, bound boolean, excess double{''.join(f', {p} long' for p in names[4:])}, s long, in_ref boolean, index boolean, left_in int, left_out int")


def _open_pairs(labels: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components of a bucket that can reach the similarity. members: key, text_no, ref (the key's pivot).

    One of the two is outside the bucket's largest component (out), so pairs within that are never built. Probability Jaccard
    is at most U / (U + D), U being the sum of max(x_i, y_i) over shared i and D the weight of all that are not shared; so D is U / 4 at
    most. U is at most X less what x doesn't share plus y's excess, and so for y, so at most a ninth of (X + Y + both excesses) isn't
    shared. What is left of each from their first shared shingle on, and the parities in which they differ, bound that."""
    state = members.join(labels.withColumnRenamed("node", "text_no"), "text_no")
    of_label = state.groupBy("key", "label").agg(F.count("*").alias("n"))
    shape = of_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("n")).filter("labels > 1 AND n > 2").select("key", F.col("top.label").alias("top"))
    # The pivot has met all of its bucket.
    inside = state.join(shape, "key").filter("text_no <> ref").groupBy("ref", "text_no", "label").agg(F.max(F.col("label") != F.col("top")).alias("out"))
    rows = scratch(_prefixes(inside, known), "prefixes")
    x, y = rows.filter("out").alias("x"), rows.alias("y")
    of = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    (size, size_), (index, index_) = of("size"), of("index")
    plain = F.col("x.plain") & F.col("y.plain")
    # The smaller one's index part meets the larger one's prefix.
    roles = ~plain | ((index & (size <= size_)) | (index_ & (size_ <= size))) & (F.least(*of("size")) >= SIMILARITY * F.greatest(*of("size")) - 1e-9)
    most = F.least(*of("left_in")) + F.least(*of("left_out"))
    unlike = sum((F.bit_count(F.col(f"x.parity{k}").bitwiseXOR(F.col(f"y.parity{k}"))) for k in range(PARITIES)), F.lit(0))
    apart = (size + size_ + 2 * (F.col("x.excess") + F.col("y.excess"))) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    enough = (size + size_ - 2 * most <= apart) & (unlike <= apart)
    once = ~F.col("y.out") | (F.col("x.text_no") < F.col("y.text_no"))
    met = x.join(y, (F.col("x.ref") == F.col("y.ref")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label")) & roles & enough & once)
    return met.select(F.least("x.text_no", "y.text_no").alias("a"), F.greatest("x.text_no", "y.text_no").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """id, none, h (a document's key), keeper (the class's first document) and rows (how many rows have this key)."""
    rows = scratch(sketched(docs), "sketches")
    rank = F.struct("none", "id", "h")
    # One row for each sequence of words; copies are joined by their content at the end. The numbers are read from the table, so they stay.
    one = rows.groupBy("content").agg(F.min(rank).alias("first"), F.min_by("bands", rank).alias("bands"))
    one = scratch(one.select(F.monotonically_increasing_id().alias("text_no"), "*"), "texts")
    members = one.filter(F.col("bands").isNotNull()).select(F.explode("bands").alias("key"), "text_no", F.xxhash64("content").alias("place"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = scratch(members.join(sizes, "key"), "buckets")
    # A group's centre stands in the largest bucket of every band, so the text with the most neighbours is the pivot.
    weights = buckets.groupBy("text_no").agg(F.sum("size").alias("weight"))
    weighed = scratch(buckets.join(weights, "text_no").select("key", "text_no", F.struct("weight", "place", "text_no").alias("order")), "weighed")
    pivots = weighed.groupBy("key").agg(F.max("order").alias("top")).select("key", F.col("top.text_no").alias("ref"))
    members = scratch(weighed.select("key", "text_no").join(pivots, "key"), "members")
    nodes = weights.select(F.col("text_no").alias("node"))
    known = bags(one.join(weights, "text_no", "left_semi").select("text_no", "first.*"), docs)
    star = members.filter("text_no <> ref").select(F.col("text_no").alias("a"), F.col("ref").alias("b")).distinct()
    labels = joined_labels(scratch(nodes.withColumn("label", F.col("node")), "labels"), verified(star, known))
    labels = joined_labels(labels, verified(_open_pairs(labels, members, known), known))
    ids = one.select("content", F.col("text_no").alias("node"), "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = ids.groupBy("label").agg(F.min("first").alias("least"))
    named = ids.join(least, "label").select("content", F.col("least").alias("keeper"))
    return rows.groupBy("id", "none", "h", "content").agg(F.count("*").alias("rows")).join(named, "content").select("id", "none", "h", "keeper", "rows")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """id, none, h (a document's key), class_id, kept (whether it is the one that stays) and rows of each distinct (id, text)."""
    found = scratch(classes(docs), "classes")
    class_id = F.when(~F.col("keeper.none"), F.col("keeper.id"))
    return found.select("id", "none", "h", class_id.alias("class_id"), (F.struct("none", "id", "h") == F.col("keeper")).alias("kept"), "rows")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, and all their columns; of rows equal in id and text one stays."""
    found = scratch(near_duplicates(docs).filter("kept"), "kept")
    stay = whole_rows(docs, "doc_id", "text").join(found, ["id", "none", "h"], "left_semi")
    return (stay if found.filter("rows > 1").isEmpty() else stay.dropDuplicates(["id", "none", "h"])).select("row.*")


def op4_probminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    one = near_duplicates(docs).select(restored_id().alias("doc_id"), "class_id", "kept", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return one.select("doc_id", "class_id", (F.col("kept") & (F.col("copy") == 1)).alias("kept"))
