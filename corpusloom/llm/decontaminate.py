"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index of Hamming blocks, exact verification.
DataFrame operations only.

A window is as many words as an item of the benchmark has, or the whole text if that is shorter; both are bags of five-word
shingles, each weighing as often as it occurs. Their similarity is the weighted Jaccard index; at SIMILARITY or more the
document holds the item.

1. A window that similar shares at least s / (1 + s) of both bags' shingles with the item, so only windows with as many
   shingles of items of that size can qualify; other windows are never built. This bound loses nothing. A text of less
   than s times an item's shingles can't reach the similarity either.
2. Fingerprints have 64 bits, cut into BLOCKS blocks. Two fingerprints within the radius differ in radius // BLOCKS bits at
   most in one of the blocks; items are indexed by each block's value and all values that near to it, so every pair
   within the radius meets in the index. Pairs of a similarity of 0.8 differ in about 10 bits, so RADIUS loses hardly any (the
   README has figures); radius=None is an exact way without fingerprints.
3. Pairs within the radius are compared exactly.

Defined cases: null and empty texts, and texts shorter than five words, hold nothing; an item of fewer than five words has no
shingle and is never found; repeated rows of a document or an item give one row a pair of ids; an item that stands in a
text more than once gives its most similar, then first window; a long text is read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, key_of, restored_id, scratch, small_or_plain, table, whole_rows

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
BLOCK_BITS = 64 // BLOCKS


def with_shingles(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds n_words and shingles, the hashes of each run of SHINGLE words."""
    parts = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}_]+")
    rows = rows.withColumn("_parts", parts)
    first, last = F.when(F.get("_parts", F.lit(0)) == "", 2).otherwise(1), F.when(F.element_at("_parts", -1) == "", 1).otherwise(0)
    rows = rows.withColumn("_words", F.slice("_parts", first, F.greatest(F.size("_parts") - first + 1 - last, F.lit(0)))).drop("_parts")
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - SHINGLE), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(SHINGLE)]))
    return rows.select(*[c for c in rows.columns if c != "_words"], F.size("_words").alias("n_words"), F.when(F.size("_words") >= SHINGLE, hashes).otherwise(F.array().cast("array<long>")).alias("shingles"))


def fingerprint(shingles: Column) -> Column:
    """Bit b is set if it is set in more than half of the shingles, each occurrence counting."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(shingles, F.lit(0), lambda total, h: total + F.getbit(h, b).cast("int")))
    return F.aggregate(F.transform(bits, lambda total, b: F.when(total * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def block_of(print_: Column, b: int) -> Column:
    return F.shiftrightunsigned(print_, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def nearby(errors: int) -> list[int]:
    """Every mask of a block with at most so many bits set."""
    return [m for m in range(1 << BLOCK_BITS) if bin(m).count("1") <= errors]


def shared_weight(a: Column, b: Column) -> Column:
    """The weight that two bags of shingles share."""
    common = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda total, x: total + F.least(times(a, x), times(b, x))))


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int | None = RADIUS) -> DataFrame:
    """id, none, h (a document's key), item_id, similarity, hamming, first word and number of words of the best window, for every pair found.

    radius: of the fingerprints, 8 * BLOCKS - 1 at most; None compares every window that can reach the similarity with every item that it shares enough
    shingles with, without fingerprints."""
    key, of = ["id", "none", "h"], ["size"] if radius is not None else ["size", "item_id"]
    bags = with_shingles(items.select("item_id", "text"), "text").drop("text").distinct().filter(F.size("shingles") > 0)
    bags = scratch(bags.withColumn("size", F.size("shingles")).withColumn("print", fingerprint(F.col("shingles"))), "items")
    # Which shingles of a text occur in an item (of a size): the benchmark's side is broadcast if it is small.
    wanted = bags.select(F.explode(F.array_distinct("shingles")).alias("shingle"), *of).distinct()
    read = with_shingles(docs.select(*key_of("doc_id", "text"), "text"), "text").drop("text")
    # The outer form: the plain one adds a filter below, into which the planner copies the whole expression of the shingles.
    hits = read.select(*key, "n_words", F.posexplode_outer("shingles").alias("at", "shingle")).join(small_or_plain(wanted, 64), "shingle").select(*key, "n_words", *of, "at").distinct()
    # A text's hits for one size (or item): as many as its words.
    hits = scratch(hits.groupBy(*key, "n_words", *of).agg(F.sort_array(F.collect_list("at")).alias("hits")), "leak-hits")
    # The window's shingles: a text with fewer than the item is one window.
    hits = hits.withColumn("length", F.least(F.col("size"), F.col("n_words") - (SHINGLE - 1))).filter(F.col("length") >= F.col("size") * similarity - 1e-9)
    need = F.ceil((F.col("size") + F.col("length")) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    spans = F.transform(F.sequence(F.lit(1), F.size("hits") - F.col("need") + 1), lambda i: F.struct(F.element_at("hits", i).alias("a"), F.element_at("hits", i + F.col("need") - 1).alias("b")))
    close = F.filter(spans, lambda s: s["b"] - s["a"] < F.col("size"))
    starts = F.array_distinct(F.flatten(F.transform(close, lambda s: F.sequence(F.greatest(F.lit(0), s["a"] - (F.col("size") - F.col("need")), s["b"] - F.col("size") + 1), s["a"]))))
    starts = F.when(F.col("length") < F.col("size"), F.array(F.lit(0))).otherwise(starts)
    places = hits.withColumn("need", need).filter(F.size("hits") >= F.col("need")).select(*key, *of, "length", starts.alias("starts")).filter(F.size("starts") > 0)
    places = scratch(places, "leak-places")
    # Texts with such places are read again for the rest of their shingles.
    again = docs.select(*key_of("doc_id", "text"), "text").join(small_or_plain(places.select(*key).distinct(), 48), key, "left_semi")
    again = scratch(with_shingles(again, "text").drop("text", "n_words").dropDuplicates(key), "leak-texts")
    at = again.join(places, key).select(*key, *of, "length", "shingles", F.explode("starts").alias("start"))
    windows = at.filter(F.col("start") + F.col("length") <= F.size("shingles")).select(*key, *of, "start", F.slice("shingles", F.col("start") + 1, F.col("length")).alias("bag"))
    windows = scratch(windows.withColumn("print", fingerprint(F.col("bag"))), "leak-windows")
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("hamming")
    bag_bytes = bags.agg(F.sum(8 * F.size("shingles") + 64)).first()[0] or 0
    bag = bags.select("item_id", "size", F.col("shingles").alias("item_bag"), F.col("print").alias("item_print"))
    bag = F.broadcast(bag) if bag_bytes <= BROADCAST_BYTES else bag
    if radius is None:
        pairs = windows.join(bag, of).select("*", apart)
    else:
        index = bags.select("item_id", "size", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block_of(F.col("print"), b).bitwiseXOR(F.lit(m)).alias("value")) for b in range(BLOCKS) for m in nearby(radius // BLOCKS)])).alias("entry"), F.col("print").alias("item_print"))
        index = index.select("item_id", "size", "item_print", "entry.block", "entry.value")
        probes = windows.select(*key, "size", "start", "print", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block_of(F.col("print"), b).alias("value")) for b in range(BLOCKS)])).alias("entry"))
        probes = probes.select(*key, "size", "start", "print", "entry.block", "entry.value")
        near = probes.join(small_or_plain(index, 64), ["size", "block", "value"]).select(*key, "size", "start", "item_id", apart).filter(F.col("hamming") <= radius).distinct()
        pairs = near.join(windows.select(*key, "size", "start", "bag"), [*key, "size", "start"]).join(bag.drop("item_print"), ["item_id", "size"])
    weight = shared_weight(F.col("bag"), F.col("item_bag"))
    length = F.size("bag")
    alike = pairs.select(*key, "item_id", length.alias("length"), "start", "hamming", (weight / (F.col("size") + length - weight)).alias("similarity")).filter(F.col("similarity") >= similarity)
    best = alike.groupBy(*key, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("from"), "length", "hamming")).alias("best"))
    return best.select(*key, "item_id", F.round("best.similarity", 6).alias("similarity"), "best.hamming", (-F.col("best.from")).alias("first_word"), (F.col("best.length") + SHINGLE - 1).alias("n_words"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    found = scratch(find_leaks(docs, items).select("id", "none", "h").distinct(), "leaks")
    return whole_rows(docs, "doc_id", "text").join(small_or_plain(found, 48), ["id", "none", "h"], "left_anti").select("row.*")


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(restored_id().alias("doc_id"), "item_id", "similarity", "first_word", "n_words")
