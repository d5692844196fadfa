"""op11, op12 and op13: brute force, exact distributions, awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations, mixing, spelling
from corpusloom.llm.common import BATCH_BYTES, bounded_batches, scratch

ODD = [None, "", "   ", "a", "a b a b a b, a b! a b", "x\ty\tx\ty", "É É É. é é", "\x0b\x0c words \xa0 here"]


def texts(seed, n, vocabulary, lengths):
    rng = random.Random(seed)
    words = [w if rng.random() < 0.9 else w.title() for w in vocabulary]
    return ["".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))])[0] + rng.choice([" "] * 6 + [", ", ". ", "\n", "\t", "; "]) for _ in range(rng.randint(*lengths))) for _ in range(n)]


def brute_phrases(rows, least, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        found = []
        for g, a in counts.items():
            if len(g) > 1 and a >= least:
                score, k = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                longer = [c for h, c in counts.items() if len(h) == 3 and len(g) == 2 and g in (h[:2], h[1:]) and c >= least]
                if not any(100 * c >= 50 * a for c in longer):
                    found.append((-score, -a, " ".join(g).encode(), a, counts[g[:k]], counts[g[k:]]))
        out += [(lang, r + 1, p.decode(), a, x, y, n, -s) for r, (s, _, p, a, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 200, "range_chars": 500}])
def test_phrases_equal_brute_force(spark, sizes):
    """Small shards and ranges give the same counts as large ones."""
    rows = [(lang, t) for k, lang in enumerate(["en", "de", None, "und"]) for t in texts(k, 12, ["the", "of", "a", "new", "york", "city", "très", "Ünder", "x-y", "don't"], (0, 120))]
    rows += [("en", t) for t in ODD] + rows[:5]
    docs = spark.createDataFrame([(*r, "w1") for r in rows], "lang string, text string, w1 string").repartition(3)
    out = collocations.collocations(docs, least=4, top=15, **sizes)
    assert sorted(map(tuple, out.collect())) == brute_phrases(rows, 4, 15) and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(docs.limit(0), least=4, **sizes).count() == 0


def test_automata_hold_their_paths():
    rng = random.Random(2)
    parts = [" ".join(rng.choices(["a", "b", "c", "dd", "é"], k=50)).encode() + b"\n" for _ in range(4)]
    words, one, two, three = collocations.counted(parts)
    assert words == sorted(words) and one[1].sum() == 200
    for ranges in (1, 3):
        got = Counter()
        for _, names, states in collocations.by_range(words, one, two, three, ranges):
            names = names.split(b" ")
            (w1, f1), (first, second, weight, goes_on), (third, last) = collocations.paths(states)
            got.update({(names[i],): int(f) for i, f in zip(w1, f1)})
            got.update({(names[i], names[j]): int(f) for i, j, f in zip(first, second, weight)})
            got.update({(names[i], names[j], names[k]): int(f) for i, j, k, f in zip(np.repeat(first, goes_on), np.repeat(second, goes_on), third, last)})
        truth = Counter()
        for part in parts:
            w = part.split()
            for k in (1, 2, 3):
                truth.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        assert got == truth
    # States with one and the same arc are one: three words lead to it.
    names, states = next(iter(collocations.by_range(*collocations.counted([b"x y z\nv y z\nw y z"]), 1)))[1:]
    assert len(collocations.arrays(states)[-2]) == 1


def test_scores_are_exact_beyond_64_bits(spark):
    a, x, y = 10**13 + 7, 10**13 + 9, 3 * 10**13 + 1
    row = spark.createDataFrame([(a, x, y)], "a long, l long, r long").select(collocations._floor_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 10**6 * a * a // (x * y)


def test_long_texts_are_counted_whole():
    text = "ab cd. " * 50
    whole = collocations.counted(list(collocations.parts_of(text, 10**6)))
    cut = collocations.counted(list(collocations.parts_of(text, 20)))
    assert whole[0] == cut[0] and all((p == q).all() for x, y in zip(whole[1:], cut[1:]) for p, q in zip(x, y))


def brute_variants(rows, min_length, min_count, drop):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % drop == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    out, form = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
        out[w] = len(close)
    root = {}
    for w in n:
        at = w
        while at in form:
            at = form[at]
        root[w] = at
    return sorted((w, form.get(w) or "", root[w], n[w], out[w], n[form[w]] if w in form else 0) for w in n)


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "abcdefghijklmnop"])
def test_variants_equal_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    stems = ["".join(rng.choices(alphabet, k=rng.randint(3, 9))) for _ in range(25)]
    words = []
    for s in stems:
        for _ in range(6):
            i = rng.randrange(len(s) + 1)
            words.append(rng.choice([s, s[:i] + s[i + 1 :], s[:i] + rng.choice(alphabet) + s[i:], s[:i] + rng.choice(alphabet) + s[i + 1 :], s + s[::-1]]))
    rows = [(rng.choice([None, 1, 2, 30, i]), " ".join(w if rng.random() < 0.9 else w.upper() for w in rng.choices(words, k=60))) for i in range(40)]
    rows += [(7, "É" * 8 + "×÷ß"), (8, None), (9, ""), (9, "日本語 abcde1abcde")] + [(50 + i, "a" * 3000 + " " + "a" * 2999 + "b " + "b" + "a" * 3000) for i in range(4)] + rows[:3]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    out = spelling.variants(docs, min_length=4, min_count=3, drop_one_in=7)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in out.collect())
    assert got == brute_variants(rows, 4, 3, 7) and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sum(1 for x in got if x[4]) > 20


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "alone alone alone")], "doc_id long, text string")).collect()[0].root == "alone"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """By rounds: shares by weight, those above the stop fixed, the excess shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


MIXED = [(i, random.Random(i).choice(["b", "a", "é", None, "B"]) if i % 4 else "hot", " ".join(["w"] * (i * 7 % 190))) for i in range(300)] + [(5, "tiny", "one two"), (5, "tiny", "one two"), (None, "tiny", "x"), (6, "empty", None), (7, "empty", ""), (7, "empty", ""), (8, "", "\t\x0b  a\n")]


def test_mixing_reaches_its_targets(spark):
    docs = spark.createDataFrame([(*r, 1) for r in MIXED], "doc_id long, source string, text string, target int")
    out = mixing.mixed_words(docs, block=8).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert sorted((r.doc_id or 0, r.source or "", r.size) for r in out) == sorted((i or 0, s or "", count(t)) for i, s, t in MIXED)
    sizes = Counter()
    for _, s, t in MIXED:
        sizes[s] += count(t)
    targets, taken = brute_targets(sizes), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size and sum(r.shard_words) == r.taken
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 12 for s in sizes) and taken["tiny"] == 3 * 5
    again = mixing.mixed_words(docs.repartition(5).orderBy(F.rand(1)), block=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mixed_words(docs.limit(0)).count() == 0 and mixing.mixed_words(docs.filter("source = 'empty'")).count() == 3


def test_draws_are_disjoint_permuted_blocks(spark):
    docs = spark.createDataFrame(MIXED, "doc_id long, source string, text string")
    drawn = mixing.draws(docs, shards=5, block=8).toPandas()
    words = mixing.mixed_words(docs, shards=5, block=8).toPandas()
    assert drawn.n_words.sum() == words.taken.sum() and drawn.groupby("shard").n_words.sum().tolist() == [sum(w[j] for w in words.shard_words) for j in range(5)]
    slots = drawn.groupby("shard").slot.unique()
    assert all(sorted(s) == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    # A block is drawn once in a pass at most, and the words of a document that are drawn in a pass don't overlap.
    assert not drawn.duplicated(["source", "start", "first_word", "pass"]).any()
    # Slots of one source are spread over the shard.
    hot = drawn[(drawn.source == "hot") & (drawn.shard == 0)].slot
    assert hot.min() < 0.2 * len(slots[0]) and hot.max() > 0.8 * len(slots[0])


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1001])
def test_places_are_a_permutation(spark, n):
    places = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7).cast("long")).alias("p")).collect()]
    assert sorted(places) == list(range(n)) and (n < 100 or places != sorted(places))


@pytest.mark.parametrize("case", [(5, 8, 6), (40, 60, 30), (60, 40, 70), (1, 3, 2), (0, 5, 3), (5, 0, 3), (4, 4, 8), (4, 4, 0)])
def test_hypergeometric_draws_have_their_distribution(spark, case):
    good, bad, draws = case
    long = lambda x: F.lit(x).cast("long")
    rows = spark.range(4000).select(mixing.hypergeometric(long(good), long(bad), long(draws), F.xxhash64("id")).alias("x")).groupBy("x").count().collect()
    seen = {r.x: r["count"] for r in rows}
    p = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
    assert set(seen) <= set(p)
    likely = [k for k in p if p[k] * 4000 >= 10]
    assert sum((seen.get(k, 0) - 4000 * p[k]) ** 2 / (4000 * p[k]) for k in likely) < len(likely) + 5 * math.sqrt(2 * len(likely)) + 5


def test_the_splitting_tree_deals_all_quotas(spark):
    quotas = [0, 7, 1000, 3, 10**12, 55]
    frame = scratch(spark.createDataFrame(list(enumerate(quotas)), "k int, quota long"), "quotas")
    for shards in (1, 3, 8):
        tree = {r.shard: r.quotas for r in mixing.splitting_tree(frame, shards).collect()}
        assert sorted(tree) == list(range(shards)) and [sum(q[k] for q in tree.values()) for k in range(len(quotas))] == quotas
        totals = [sum(q) for q in tree.values()]
        assert max(totals) - min(totals) <= 1 and all(x >= 0 for q in tree.values() for x in q)


def test_batches_are_bounded(spark):
    given = spark.conf.get(BATCH_BYTES)
    try:
        for before, after in (("64m", "8m"), ("1m", "1m"), ("67108864b", "8m"), ("4096k", "4096k"), ("1g", "8m")):
            spark.conf.set(BATCH_BYTES, before)
            bounded_batches(spark)
            assert spark.conf.get(BATCH_BYTES) == after
    finally:
        spark.conf.set(BATCH_BYTES, given)
