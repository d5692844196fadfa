"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame operations only.

Sizes are words. A source's documents, in the order of a keyed hash, are one stream of words, cut into blocks of BLOCK words; a
source's target becomes an exact quota of draws of its blocks: whole passes over the source, and a part of one more.

The tree: its root holds every source's quota, and each node deals its quotas to the two halves of its output shards. How many
draws of each source fall into the left half is a multivariate hypergeometric draw, made source by source as hypergeometric
ones of what is left (ratio of uniforms, exact at any size), so the halves' quotas add up, each shard's number of draws is fixed,
and each shard's sources vary as if all draws had been shuffled together. Randomness is a hash of the seed and the node's place, so reruns agree.

A source's blocks are permuted in each pass (swap-or-not, a permutation of any number of blocks that is computed for each block
alone). A block's place in its source's passes tells whether it is drawn (place < quota), and by the shards' running
quotas into which shard: shards draw disjoint ranges of permuted blocks. The place among its shard's draws is permuted again,
which is the local shuffle: slot counts from 0 without gaps, and nothing is sorted.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at MOST times its source's
size, and the excess goes to the others by weight until none is above. In order of size / weight the sources that stop come
first, so one running sum over sources finds them.

A document's place in its source's stream is a running sum in two steps, over buckets of bounded size and within them, so a hot
source is spread. Per source there is one row: sources, as parts of a mix, are as many as a configuration has.

Defined cases: null and empty texts have no word and are never drawn; a source without words has target 0; rows equal in id and
text are drawn each on its own; an id or source that is null stays so; a long text stands in many blocks; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, small_or_plain, table

BLOCK, SHARDS, SEED, MOST, ROUNDS, BUCKET_ROWS, TRIES = 64, 8, 20_240_602, 3, 12, 20_000, 64
WEIGHTS = (1, 2, 3)
#: Constants of the ratio of uniforms for unimodal distributions: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
HAT1, HAT2 = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's body is computed for every element, and so is all that is written twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*parts: Column) -> Column:
    """A number over 0 and under 1, from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def log_factorial(n: Column) -> Column:
    """ln(n!), from a table up to 15 and by Stirling's series beyond."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 16, F.get(small, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def hypergeometric(good: Column, bad: Column, draws: Column, key: Column) -> Column:
    """How many of draws from good and bad are good: ratio of uniforms, tries with numbers hashed from key.

    TRIES rejections in a row have a probability of under 1e-15; then it is the mode."""
    setting = F.struct(good.alias("good"), bad.alias("bad"), draws.alias("draws"), F.least(good, bad).alias("a"), F.greatest(good, bad).alias("b"), F.least(draws, good + bad - draws).alias("m"), key.alias("key"))

    def shape(s: Column) -> Column:
        pop = (s["a"] + s["b"]).cast("double")
        spread = F.sqrt((pop - s["m"]) * s["m"] * s["a"] * s["b"] / (pop * pop * F.greatest(pop - 1, F.lit(1.0))) + 0.5)
        mode = F.floor((s["m"] + 1).cast("double") * (s["a"] + 1) / (pop + 2))
        return F.struct((s["m"].cast("double") * s["a"] / pop + 0.5).alias("centre"), (HAT1 * spread + HAT2).alias("width"), mode.alias("mode"))

    def weight(s: Column, z: Column) -> Column:
        return log_factorial(z) + log_factorial(s["a"] - z) + log_factorial(s["m"] - z) + log_factorial(s["b"] - s["m"] + z)

    def drawn(s: Column) -> Column:
        def tried(d: Column, of_mode: Column) -> Column:
            def one(found: Column, i: Column) -> Column:
                u = uniform(F.lit(1), s["key"], i)
                at = d["centre"] + d["width"] * (uniform(F.lit(2), s["key"], i) - 0.5) / u
                z = F.floor(at)
                fits = (at >= 0) & (z <= F.least(s["m"], s["a"]))
                return F.coalesce(found, F.when(fits, F.when(2 * F.log(u) <= of_mode - weight(s, z), z)))

            return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("long"), one), d["mode"])

        of_smaller = F.when((s["a"] == 0) | (s["m"] == 0), F.lit(0).cast("long")).otherwise(let(shape(s), lambda d: let(weight(s, d["mode"]), lambda w: tried(d, w))))
        return let(of_smaller, lambda z: let(F.when(s["good"] > s["bad"], s["m"] - z).otherwise(z), lambda g: F.when(s["m"] < s["draws"], s["good"] - g).otherwise(g)))

    return let(setting, drawn)


def split(quotas: Column, left: Column, key: Column) -> Column:
    """How much of each of the quotas goes to the left half, which takes left draws in all."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda t, q: t + q)
    start = F.struct(left.alias("draws"), total.alias("rest"), F.array().cast("array<long>").alias("out"))

    def step(state: Column, q: Column) -> Column:
        mine = hypergeometric(q, state["rest"] - q, state["draws"], F.xxhash64(key, F.size(state["out"])))
        return let(mine, lambda x: F.struct((state["draws"] - x).alias("draws"), (state["rest"] - q).alias("rest"), F.concat(state["out"], F.array(x)).alias("out")))

    return F.aggregate(quotas, start, step, lambda state: state["out"])


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """shard and quotas (one for each source, in order of k) from the sources' quotas (k, quota): level by level, a row for each node."""
    of_all = F.transform(F.sort_array(F.collect_list(F.struct("k", "quota"))), lambda x: x["quota"])
    root = quotas.agg(of_all.alias("quotas"), F.coalesce(F.sum("quota"), F.lit(0)).alias("total"))
    nodes = scratch(root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "total", "quotas"), "mix-nodes")
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        mid = F.expr("(lo + hi) div 2").cast("int")
        # Shard j of all ends at the draw (j + 1) * total div shards.
        draws = F.expr(f"(total * CAST((lo + hi) div 2 AS BIGINT)) div {shards} - (total * CAST(lo AS BIGINT)) div {shards}")
        halved = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, split(F.col("quotas"), draws, F.xxhash64(F.lit(seed), "lo", "hi"))))
        node = lambda lo, hi, q: F.struct(lo.alias("lo"), hi.alias("hi"), "total", q.alias("quotas"))
        other = F.zip_with("quotas", "left", lambda q, x: q - x)
        both = F.when(F.col("left").isNull(), F.array(node(F.col("lo"), F.col("hi"), F.col("quotas")))).otherwise(F.array(node(F.col("lo"), mid, F.col("left")), node(mid, F.col("hi"), other)))
        nodes = scratch(halved.select(F.explode(both).alias("node")).select("node.*"), "mix-nodes")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of x in a permutation of 0..n-1: in each round x and its mirror image at a keyed point change places or not, as a hash of the larger one says."""

    def turn(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return let(mirror, lambda m: F.when(F.xxhash64(key, r, F.greatest(at, m)) % 2 == 0, m).otherwise(at))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), turn)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """k (the source's number in code point order, null last), source, source_size and target of the rows (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.col("k") % len(weights))
    known = scratch(sums.withColumn("k", k).withColumn("weight", weight), "mix-sources").withColumn("cap", most * F.col("source_size"))
    ranked = known.withColumn("order", F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "k"))
    before = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    shared = ranked.withColumn("share", share)
    level = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("order", "share"))).over(every)["share"]
    return shared.select("k", "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def plan(sized: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The sources (source_targets) with blocks (their number), quota, and for each shard the first of the source's draws that falls into it
    (firsts), the source's first place among the shard's draws (bases) and the shard's draws (totals)."""
    size = F.greatest("source_size", F.lit(1))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    passes = F.least(F.floor(F.col("target") / size), F.lit(most))
    rest = F.least(F.col("blocks"), F.round((F.col("target") - F.col("passes") * F.col("source_size")) / block).cast("long"))
    quota = F.least(F.col("passes") * F.col("blocks") + rest, most * F.col("blocks"))
    sources = source_targets(sized, weights, most).withColumn("blocks", blocks).withColumn("passes", passes).withColumn("quota", quota)
    sources = scratch(sources.drop("passes"), "mix-quotas")
    dealt = splitting_tree(sources, shards, seed).select("shard", F.posexplode("quotas").alias("k", "n"))
    running = lambda of, by: F.coalesce(F.sum("n").over(Window.partitionBy(of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.select("k", "shard", running("k", "shard").alias("first"), running("shard", "k").alias("base"), F.sum("n").over(Window.partitionBy("shard")).alias("total"))
    rows = F.sort_array(F.collect_list(F.struct("shard", "first", "base", "total")))
    of_k = placed.groupBy("k").agg(rows.alias("rows")).select("k", *[F.col(f"rows.{f}").alias(f + "s") for f in ("first", "base", "total")])
    return scratch(sources.join(of_k, "k"), "mix-plan")


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64(text).alias("h"))


def candidates(sized: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Each document's blocks in each pass: place in the source's draws, first_word and n_words of the document in the block, and where
    the block is drawn shard and slot. (k, bucket, number) is the row's identity; a document without words has one row without a block."""
    n = sized.count()
    order = F.xxhash64(F.lit(seed), "doc_id", "h")
    known = sized.join(small_or_plain(sources, 200), sized["source"].eqNullSafe(sources["source"])).drop(sized["source"])
    dealt = known.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(max(1, math.ceil(n / BUCKET_ROWS)))).cast("int"))
    sums = dealt.groupBy("k", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("k", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first_word_of_bucket"))
    inside = Window.partitionBy("k", "bucket").orderBy("order", "doc_id", "h")
    ordered = dealt.withColumn("number", F.row_number().over(inside)).withColumn("inner", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = ordered.join(small_or_plain(first, 40), ["k", "bucket"]).withColumn("start", F.col("first_word_of_bucket") + F.col("inner")).drop("first_word_of_bucket", "inner", "order")
    numbers = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    passes = F.when(F.col("quota") > 0, F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1) div blocks")))
    pieces = at.withColumn("block", F.explode_outer(numbers)).withColumn("pass", F.explode_outer(passes))
    place = F.col("pass") * F.col("blocks") + permuted(F.col("block"), F.col("blocks"), F.xxhash64(F.lit(seed), "k", "pass"))
    begin, end = F.greatest(F.col("block") * block, F.col("start")), F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    pieces = pieces.withColumn("place", F.when(F.col("block").isNotNull() & F.col("pass").isNotNull(), place)).withColumn("first_word", begin - F.col("start")).withColumn("n_words", end - begin)
    # The last shard whose first draw isn't beyond the place; shards without draws of the source begin where the next one does.
    shard = F.size(F.filter("firsts", lambda x: x <= F.col("place"))) - 1
    return pieces.withColumn("shard", F.when(F.col("place") < F.col("quota"), shard))


def draws(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: doc_id, source, h (a hash of the text), first_word and n_words of what is drawn, pass, shard and slot (the block's place in its shard: a block's pieces share it, in order of start)."""
    sized = scratch(sized_rows(docs, id_col, text_col, source_col), "mix-sizes")
    drawn = candidates(sized, plan(sized, shards, block, seed, weights, most), block, seed).filter("shard IS NOT NULL")
    at = lambda name: F.get(F.col(name), F.col("shard"))
    slot = permuted(at("bases") + F.col("place") - at("firsts"), at("totals"), F.xxhash64(F.lit(seed), F.lit("slot"), "shard"))
    return drawn.select("doc_id", "source", "h", "first_word", "n_words", "pass", "shard", slot.alias("slot"), "start")


def mixed_words(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each document with its size, its source's size and target, the words that the mix takes of it, and how many of them go to each shard."""
    sized = scratch(sized_rows(docs, id_col, text_col, source_col), "mix-sizes")
    rows = candidates(sized, plan(sized, shards, block, seed, weights, most), block, seed)
    words = lambda which: F.coalesce(F.sum(F.when(which, F.col("n_words"))), F.lit(0)).cast("long")
    by_shard = F.array(*[words(F.col("shard") == j) for j in range(shards)])
    # The size, source and target are the same in all rows of a document.
    one = rows.groupBy("k", "bucket", "number").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")], words(F.col("shard").isNotNull()).alias("taken"), by_shard.alias("shard_words"))
    return one.select("doc_id", "source", "size", "source_size", "target", "taken", "shard_words")


def op13_hypergeometric_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "shard_words")
