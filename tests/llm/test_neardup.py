"""op4 beside brute force, with small and large buckets, and awkward rows."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import neardup


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def corpus(seed=1):
    """A large group of near copies, small ones, a passage that many texts share, exact copies."""
    rng = random.Random(seed)
    base, passage, texts = words(rng, 120), words(rng, 40), []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "edited" + str(rng.random())[2:6]
        texts.append(" ".join(t))
    for _ in range(40):
        texts.append(" ".join(words(rng, 30) + passage + words(rng, 30)))
    for _ in range(15):
        t = words(rng, 80)
        texts += [" ".join(t), " ".join([*t[:-1], "last"])]
    # Texts in which shingles repeat, near to each other.
    refrain = words(rng, 12)
    texts += [" ".join(refrain * 4 + base[:60] + words(rng, n)) for n in range(1, 9)]
    return texts + texts[:10]


def similarity(a, b):
    bag = lambda t: neardup.weigh(neardup.shingles(neardup.Words()(re.findall(r"\w+", t.lower()))))
    return neardup.similarity(bag(a), bag(b))


def naive(x, y):
    """Probability Jaccard by its definition."""
    keys = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in set(x) & set(y))


def test_similarity_is_probability_jaccard():
    rng = random.Random(2)
    for _ in range(50):
        x, y = ({k: rng.choice([1.0, 1.7, 2.1]) for k in rng.sample(range(30), 20)} for _ in range(2))
        pair = [(np.array(sorted(d), "u8"), np.array([d[k] for k in sorted(d)])) for d in (x, y)]
        assert neardup.similarity(*pair) == pytest.approx(naive(x, y))


def test_sketch_estimates_it():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 2**63, 400).astype("u8")
    a, b = ids[:300], ids[50:350]
    got = neardup.sketch([(np.sort(a), np.ones(300)), (np.sort(b), np.ones(300)), (np.sort(a), np.ones(300))])
    assert (got[0] == got[2]).all() and abs((got[0] == got[1]).mean() - 250 / 350) < 0.15


def test_classes_equal_brute_force(spark):
    texts = corpus()
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if find(i) != find(j) and (texts[i] == texts[j] or similarity(texts[i], texts[j]) >= 0.8):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    # Groups of the given links, named by their smallest member.
    assert len(got) == len(texts) and {i: find(i) for i in range(len(texts))} == got


def test_awkward_rows(spark):
    t = " ".join(words(random.Random(5), 50))
    rows = [(1, t, "a"), (1, t, "a"), (2, t.upper() + "!", "b"), (None, t, "c"), (3, None, "d"), (4, "", "e"), (5, "two words", "f"), (6, "Two, words", "g"), (7, "other words", "h"), (8, "so " * 30_000, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8]
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_large_ids_beside_nulls_stay_whole(spark):
    rng = random.Random(6)
    rows = [(2**60 + 1, " ".join(words(rng, 20))), (None, " ".join(words(rng, 20))), (2**60 + 3, " ".join(words(rng, 20)))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, none int, row int").coalesce(1)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2**60 + 1, None, 2**60 + 3}


def test_prefixes_meet_in_every_similar_pair(spark):
    """Pairs at 0.8 or more share a prefix shingle that the smaller one's index part holds, whatever the text they are ordered by."""
    rng = random.Random(7)
    base = words(rng, 60)
    texts = []
    for _ in range(60):
        t = base[rng.randrange(12) :] + words(rng, rng.randrange(12))
        texts.append(" ".join(t + (t[:20] if rng.random() < 0.3 else [])))
    docs = spark.createDataFrame([(i, 0, False, t, i) for i, t in enumerate(texts)], "doc_id long, h0 long, none0 boolean, text string, text_no long")
    known = neardup.bags(docs.select(*neardup.key_of("doc_id", "text"), "text_no"), docs)
    got = neardup._prefixes(spark.createDataFrame([(0, i, 7) for i in range(len(texts))], "ref long, text_no long, label long"), known).toPandas()
    assert set(got["label"]) == {7}
    of = {i: g for i, g in got.groupby("text_no")}
    found = 0
    for i, j in combinations(range(len(texts)), 2):
        if similarity(texts[i], texts[j]) < 0.8:
            continue
        found += 1
        x, y = sorted((of[i], of[j]), key=lambda g: g["size"].iloc[0])
        if x["plain"].iloc[0] and y["plain"].iloc[0]:
            assert x["size"].iloc[0] >= 0.8 * y["size"].iloc[0]
        met = x.merge(y, on="s")
        met = met[met["index_x"] & (~met["in_ref_x"] | (met["bound_x"] & met["bound_y"]))]
        if x["plain"].iloc[0] and y["plain"].iloc[0]:
            most = np.minimum(met["left_in_x"], met["left_in_y"]) + np.minimum(met["left_out_x"], met["left_out_y"])
            met = met[most >= 4 / 9 * (x["size"].iloc[0] + y["size"].iloc[0]) - 1e-9]
        assert len(met)
    assert found > 100


def test_pairs_of_a_large_group_without_its_original(spark, monkeypatch):
    """Edited copies, each under 0.8 to most others, and none is the original: what all of them have and the pivot lacks builds no pairs."""
    compared, verified = [], neardup.verified

    def counted(pairs, known):
        compared.append(pairs.count())
        return verified(pairs, known)

    monkeypatch.setattr(neardup, "verified", counted)
    for repeated in (False, True):
        rng = random.Random(8)
        base, texts = words(rng, 150), []
        base = base[:130] + base[:20] if repeated else base
        for i in range(300):
            t = list(base)
            for at in rng.sample(range(150), rng.randint(1, 5)):
                t[at] = words(rng, 1)[0]
            texts.append(" ".join(t))
        parent = list(range(len(texts)))

        def find(i):
            return i if parent[i] == i else find(parent[i])

        bags = [neardup.shingles(neardup.Words()(t.split())) for t in texts]
        for i, j in combinations(range(len(texts)), 2):
            if find(i) != find(j) and neardup.bag_similarity(np.sort(bags[i]), np.sort(bags[j])) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        compared.clear()
        got = {r.id: r.class_id for r in neardup.near_duplicates(docs).collect()}
        assert {i: find(i) for i in range(len(texts))} == got and 1 < len(set(got.values())) < 300
        assert compared[1] < 4 * len(texts)


def test_parities_differ_in_no_more_bits_than_shingles():
    rng = np.random.default_rng(9)
    for _ in range(50):
        ids = rng.integers(0, 2**63, 400).astype("u8")
        x, y = ids[: rng.integers(1, 300)], ids[rng.integers(0, 300) :]
        differ = sum(int(a).bit_count() for a in (neardup.parities(x) ^ neardup.parities(y)).view("u8"))
        assert differ <= len(np.setxor1d(x, y)) and (len(np.setxor1d(x, y)) - differ) % 2 == 0


def test_similar_bags_share_all_but_a_ninth():
    """The bound of _open_pairs: shingles that only one has are at most a ninth of both weights and of their excess over one a shingle."""
    rng, found = np.random.default_rng(10), 0
    for _ in range(3000):
        kinds, repeats = np.arange(60, dtype="u8"), rng.choice([1, 1, 1, 2, 4], 60)
        lack = [rng.random(60) < rng.choice([0.02, 0.1]) for _ in range(2)]
        x, y = (neardup.weigh(np.repeat(kinds, np.where(gone, 0, repeats if rng.random() < 0.5 else rng.choice([1, 2], 60)))) for gone in lack)
        if neardup.similarity(x, y) >= 0.8:
            found += 1
            assert len(np.setxor1d(x[0], y[0])) <= (2 * x[1].sum() - len(x[0]) + 2 * y[1].sum() - len(y[0])) / 9 + 1e-9
    assert found > 100
