"""Phrase collocation mining by weighted acyclic automata: shards build count automata of their sorted n-grams, which are united
by ranges of prefixes, and composed with one another to look up the parts of phrases.

A shard (some megabytes of one language's texts) sorts its n-grams of one to three words and writes them, in that order, as automata
whose paths are words: an arc has the number of times that the path up to it occurs. Paths share their prefixes; states whose only
way on is the same arc are one state, as are all states without one. Paths are dealt to ranges by the hash of their prefix (its
first two words), so each range has an automaton of its own, and a first word that begins a large part of all n-grams is spread.

Uniting the automata of a range adds the weights of equal paths, which are then counts over all texts. Arcs under MIN_COUNT go: a
phrase occurs no more often than its parts, so no arc that a candidate or a part of one needs is lost. The rest is composed
from short paths to long ones: two-word arcs with the one-word arcs of either part, then three-word arcs with the two-word
arcs of their first and last two words, which know the counts of their own parts by then. So no key of a join has more rows than
there are words that follow or precede one word or pair.

Scores are exact in decimals of 38 digits: counts may go up to 10**16.

Defined cases: null texts are empty; a null language is "und"; a text may be of any length (it is cut for counting only at
separators, which no phrase crosses); repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codes import mix
from .common import scratch, small_or_plain, table

MIN_COUNT, TOP, DROP_SHARE = 10, 2000, 50
#: Bytes of text of one automaton's n-grams, and characters of text in all for each range of prefixes.
SHARD_BYTES, RANGE_CHARS = 8 << 20, 12_000_000
#: Bytes that end a piece, and a tab, which like a space ends a word.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
STEP = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Words by number in order of their first appearance; blanks are 0 and ends of pieces 1."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def parts_of(text: str, size: int = SHARD_BYTES) -> Iterator[bytes]:
    """A text as bytes, A-Z lower-cased, with "\\n" for every end of a piece; long texts in parts that end with a piece."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(ENDS)
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b"\n", at, at + size)
        if cut < 0:
            cut = data.find(b"\n", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut + 1
    yield data[at:] if at else data


def compact(x: np.ndarray) -> bytes:
    """An array of whole numbers in the smallest type that holds them, its size in bytes first."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return np.array([len(x), kind.itemsize], "<u4").tobytes() + x.astype(kind.newbyteorder("<")).tobytes()


def arrays(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, width = np.frombuffer(blob, "<u4", 2, at)
        out.append(np.frombuffer(blob, f"<u{width}", n, at + 8).astype("i8"))
        at += 8 + int(n) * int(width)
    return out


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at starts, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def automaton(words: list[bytes], one: tuple, two: tuple, three: tuple) -> tuple[bytes, bytes]:
    """The words and the states of an automaton. one: word and weight of paths of one word; two: first, second word, weight and the number of
    arcs that go on; three: third word and weight of these, in the order of two. All are sorted; words by number.

    The states after two words: 0 has no arc; then those with one arc, which is shared by all that have the same; then the others."""
    first, second, weight, goes_on = two
    third, last = three
    at = np.cumsum(goes_on) - goes_on
    single = np.flatnonzero(goes_on == 1)
    base = int(last.max()) + 1 if len(last) else 1
    shared, of_single = np.unique(third[at[single]] * base + last[at[single]], return_inverse=True)
    many = np.flatnonzero(goes_on > 1)
    state = np.zeros(len(first), "i8")
    state[single], state[many] = 1 + of_single, 1 + len(shared) + np.arange(len(many))
    arcs = flat(at[many], goes_on[many])
    thirds, lasts = np.concatenate((shared // base, third[arcs])), np.concatenate((shared % base, last[arcs]))
    # Words are numbered anew, so that numbers are small; first words of two-word paths are written once for all that share them.
    used = np.unique(np.concatenate((one[0], first, second, thirds)))
    of = lambda x: np.searchsorted(used, x)
    heads, sizes = np.unique(first, return_counts=True)
    names = b" ".join(words[i] for i in used.tolist())
    return names, b"".join(map(compact, (of(one[0]), one[1], of(heads), sizes, of(second), weight, state, np.array([len(shared)]), goes_on[many], of(thirds), lasts)))


def paths(blob: bytes) -> tuple[tuple, tuple, tuple]:
    """The paths of an automaton, as automaton takes them, with the words' numbers in its own list."""
    w1, f1, heads, sizes, second, weight, state, (shared,), more, thirds, lasts = arrays(blob)
    outs = np.concatenate(([0], np.ones(shared, "i8"), more))
    begin = np.cumsum(outs) - outs
    goes_on = outs[state]
    at = flat(begin[state], goes_on)
    return (w1, f1), (np.repeat(heads, sizes), second, weight, goes_on), (thirds[at], lasts[at])


def counted(parts: list[bytes]) -> tuple[list[bytes], tuple, tuple, tuple]:
    """The words of texts in order of their bytes, and their n-grams: sorted, and as automaton takes them."""
    numbers = Numbers()
    tokens = b"\n".join(parts).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, tokens), "i8", len(tokens))
    del tokens, numbers[b""], numbers[b"\n"]
    words = sorted(numbers)
    rank = np.full(len(words) + 2, -1)
    rank[[numbers[w] for w in words]] = np.arange(len(words))
    ids = rank[ids[ids > 0]]
    v, n = max(1, len(words)), len(ids)
    one = np.bincount(ids[ids >= 0], minlength=len(words))
    pair = np.full(n, -1)
    here = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    two, pair[here], n_two = np.unique(ids[here] * v + ids[here + 1], return_inverse=True, return_counts=True)
    here = here[(here + 2 < n)]
    here = here[ids[here + 2] >= 0]
    three, n_three = np.unique(pair[here] * v + ids[here + 2], return_counts=True)
    goes_on = np.bincount(three // v, minlength=len(two))
    return words, (np.arange(len(words)), one), (two // v, two % v, n_two, goes_on), (three % v, n_three)


def by_range(words: list[bytes], one: tuple, two: tuple, three: tuple, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """An automaton for each range of prefixes."""
    hashes = mix(np.fromiter(map(zlib.crc32, words), "u8", len(words)))
    first, second, weight, goes_on = two
    of_one, of_two = (hashes % np.uint64(ranges)).astype("i8"), (mix(hashes[first] * STEP + hashes[second]) % np.uint64(ranges)).astype("i8")
    order_one, order = np.argsort(of_one, kind="stable"), np.argsort(of_two, kind="stable")
    starts = np.cumsum(goes_on) - goes_on
    third = flat(starts[order], goes_on[order])
    cut_one, cut = (np.searchsorted(x, np.arange(ranges + 1)) for x in (of_one[order_one], of_two[order]))
    upto = np.concatenate(([0], np.cumsum(goes_on[order])))
    for r in range(ranges):
        a, b = order_one[cut_one[r] : cut_one[r + 1]], order[cut[r] : cut[r + 1]]
        c = third[upto[cut[r]] : upto[cut[r + 1]]]
        if len(a) or len(b):
            yield r, *automaton(words, (one[0][a], one[1][a]), (first[b], second[b], weight[b], goes_on[b]), (three[0][c], three[1][c]))


def shard_automata(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, range, words and states of the automata of docs (lang, ranges, text); ranges: into how many the language's prefixes are dealt."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        ranges: dict[str, int] = {}

        def flush(lang: str) -> pd.DataFrame:
            sizes.pop(lang)
            found = [(lang, *x) for x in by_range(*counted(waiting.pop(lang)), ranges[lang])]
            return pd.DataFrame(found, columns=["lang", "range", "words", "states"])

        for p in batches:
            for lang, n, text in zip(p["lang"], p["ranges"], p["text"]):
                ranges[lang] = n
                for part in parts_of(text, shard_bytes):
                    waiting.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= shard_bytes:
                        yield flush(lang)
                if len(sizes) > 2 and sum(sizes.values()) >= 2 * shard_bytes:
                    yield flush(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield flush(lang)

    return docs.mapInPandas(read, "lang string, range int, words binary, states binary")


ARCS = "lang string, w1 string, w2 string, w3 string, f long"


def united(automata: pd.DataFrame, least: int) -> pd.DataFrame:
    """The arcs of the automata of one range whose weights add up to least or more, and the sum of all one-word weights without a word."""
    numbers: dict[bytes, int] = {}
    ones, twos, threes = [], [], []
    for names, states in zip(automata["words"], automata["states"]):
        of = np.fromiter((numbers.setdefault(w, len(numbers)) for w in names.split(b" ")), "i8")
        (w1, f1), (first, second, weight, goes_on), (third, last) = paths(states)
        ones.append((of[w1], f1))
        twos.append((of[first], of[second], weight, goes_on))
        threes.append((of[third], last))
    v, words = max(1, len(numbers)), list(numbers)
    word, f = map(np.concatenate, zip(*ones))
    one = np.zeros(v, "i8")
    np.add.at(one, word, f)
    first, second, weight, goes_on = map(np.concatenate, zip(*twos))
    third, last = map(np.concatenate, zip(*threes))
    del ones, twos, threes
    two, at = np.unique(first * v + second, return_inverse=True)
    n_two = np.zeros(len(two), "i8")
    np.add.at(n_two, at, weight)
    three, at = np.unique(np.repeat(at, goes_on) * v + third, return_inverse=True)
    n_three = np.zeros(len(three), "i8")
    np.add.at(n_three, at, last)
    a, b, c = np.flatnonzero(one >= least), np.flatnonzero(n_two >= least), np.flatnonzero(n_three >= least)
    ahead = two[three[c] // v]
    text = lambda ids: [words[i].decode("utf-8", "surrogatepass") for i in ids.tolist()]
    rows = [(w, None, None, int(n)) for w, n in zip(text(a), one[a])]
    rows += [(x, y, None, int(n)) for x, y, n in zip(text(two[b] // v), text(two[b] % v), n_two[b])]
    rows += [(x, y, z, int(n)) for x, y, z, n in zip(text(ahead // v), text(ahead % v), text(three[c] % v), n_three[c])]
    rows.append((None, None, None, int(one.sum())))
    out = pd.DataFrame(rows, columns=["w1", "w2", "w3", "f"])
    out.insert(0, "lang", automata["lang"].iloc[0])
    return out


def count_arcs(docs: DataFrame, least: int = MIN_COUNT, range_chars: int = RANGE_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, w1, w2, w3, f of all n-grams of one to three words that occur least times or more in docs (lang, text); unused words are
    null, and rows without a word have parts of the number of all words."""
    sizes = docs.groupBy("lang").agg(F.ceil(F.sum(F.length("text")) / range_chars).cast("int").alias("ranges"))
    ranges = scratch(sizes.withColumn("ranges", F.greatest("ranges", F.lit(1))), "phrase-ranges")
    automata = shard_automata(docs.join(small_or_plain(ranges, 64), "lang").select("lang", "ranges", "text"), shard_bytes)
    return automata.groupBy("lang", "range").applyInPandas(lambda part: united(part, least), ARCS)


def _floor_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    exact = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact(a) * exact(a)), exact(l) * exact(r))


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, drop_share: int = DROP_SHARE, lang_col: str = "lang", text_col: str = "text", **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first phrases by score.

    A phrase's score is that of its weakest cut; one that stands in a longer candidate with drop_share percent or more of its own count is dropped."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    arcs = scratch(count_arcs(texts, least, **sizes), "phrase-arcs")
    totals = arcs.filter("w1 IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    words = arcs.filter("w1 IS NOT NULL AND w2 IS NULL")
    half = lambda name, f: words.select("lang", F.col("w1").alias(name), F.col("f").alias(f))
    two = arcs.filter("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", F.col("f").alias("a")).join(half("w1", "f1"), ["lang", "w1"]).join(half("w2", "f2"), ["lang", "w2"])
    two = scratch(two.select("lang", "w1", "w2", "a", "f1", "f2"), "phrase-pairs")
    head = two.select("lang", "w1", "w2", F.col("a").alias("a12"), "f1")
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("f2").alias("f3"))
    three = arcs.filter("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("f").alias("a")).join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    three = scratch(three, "phrase-triples")
    longer = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    within = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("inside"))
    kept = two.join(within, ["lang", "w1", "w2"], "left").filter(F.col("inside").isNull() | (100 * F.col("inside") < drop_share * F.col("a")))
    cut = lambda l, r: F.struct(_floor_score(F.col("a"), F.col(l), F.col(r)).alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    of_two = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut("f1", "f2").alias("best"))
    first, second = F.col("first"), F.col("second")
    of_three = three.withColumn("first", cut("f1", "a23")).withColumn("second", cut("a12", "f3")).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(second["score"] < first["score"], second).otherwise(first).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = of_two.unionByName(of_three).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


def op11_automata_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
