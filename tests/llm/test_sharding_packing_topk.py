"""op8, op1 and op5: laws, exact ids, brute force, awkward rows."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import packing, sharding, topk

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, "a b c"), (1, "a b c"), (2, None), (None, "x"), (3, ""), (4, "word " * 5000), (5, "naïve Ünïcode “quotes” 12%"), (6, "中文 текст e\u0301")]


def documents(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, length string")


@pytest.mark.parametrize("n", [1, 2, 7, 100, 4097])
def test_permutation_and_its_inverse(n):
    out = sharding.permute(np.arange(n), n, 5)
    assert sorted(out) == list(range(n)) and (sharding.permute(out, n, 5, inverse=True) == np.arange(n)).all()


def test_shards(spark):
    rows = [(i % 50 if i % 3 else 7, f"t{i % 20}") for i in range(301)]
    docs = documents(spark, rows)
    out = sharding.feistel_shards(docs, ["doc_id", "text"], 8).collect()
    by_shard = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
    assert len(out) == 301 and all(v == list(range(len(v))) for v in by_shard.values()) and {len(v) for v in by_shard.values()} <= {37, 38}
    again = sharding.feistel_shards(docs.repartition(7).orderBy(F.rand(1)), ["doc_id", "text"], 8)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    r = out[17]
    assert sharding.row_at(r.shard, r.slot, 301, 8, 20_240_601) == r.row_no
    # Row numbers rank the rows by a hash of their keys, then the keys; shard and slot follow from the permutation.
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    buckets = -(-301 // 20_000)
    ranked = sorted(hashed, key=lambda r: (r.h % buckets, r.h, r.doc_id, r.text))
    place = sharding.permute(np.arange(301), 301, 20_240_601)
    assert sorted((r.doc_id, r.text, r.row_no, r.shard, r.slot) for r in out) == sorted((r.doc_id, r.text, n, place[n] % 8, place[n] // 8) for n, r in enumerate(ranked))
    assert sharding.feistel_shards(docs.limit(0), ["doc_id", "text"]).count() == 0
    assert len(sharding.feistel_shards(documents(spark), ["doc_id", "text"]).collect()) == len(ODD)


def test_row_numbers_over_many_buckets(spark, monkeypatch):
    """Small buckets and blocks of them: the prefix sums still number the rows 0..n-1 in order of bucket, hash and key."""
    monkeypatch.setattr(sharding, "BLOCK", 3)
    rows = [(i % 400, f"t{i % 7}") for i in range(1000)]
    numbered, n = sharding.number_rows(documents(spark, rows), ["doc_id", "text"], bucket_rows=50, chunk=2)
    hashed = documents(spark, rows).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    ranked = sorted(hashed, key=lambda r: (r.h % 20, r.h, r.doc_id, r.text))
    assert n == 1000 and [(r.doc_id, r.text) for r in numbered.orderBy("row_no").collect()] == [(r.doc_id, r.text) for r in ranked]


def test_token_ids_equal_the_tokenizer():
    rng = random.Random(3)
    alphabet = "abc XYZ\xa0\x1d 019 '\t\n\r.,!?_-#$%&*\"'sd'll 'Ve ÀÉßÿñçª²½º×÷µ–’“…€­_<|"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(20)) for _ in range(500)]
    count = packing.counter(PATH)
    assert all(count(t) == count.exact(t) for t in texts + ["<|endoftext|> x", "Don't stop", "ΑΣ Σας", "İ K Å ẞ"])


def test_packing(spark):
    docs = documents(spark, ODD + [(100 + i, "word " * (i * 37 % 900)) for i in range(200)])
    out = packing.pack(packing.pieces(docs, PATH), group_rows=30).toPandas()
    assert len(out[out.doc_id == 1]) == 2 and out.length.between(1, 2048).all()
    spread = out.sort_values(["sequence_id", "offset"])
    before = spread.groupby("sequence_id").length.cumsum() - spread.length
    assert (before == spread.offset).all() and (spread.groupby("sequence_id").length.sum() <= 2048).all()
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1
    long = out[out.doc_id == 4].sort_values("piece")
    assert list(long.start) == list(range(0, 5001, 2048)) and list(long.length) == [2048, 2048, 905]
    ids = packing.counter(PATH).exact("word " * 5000) + b"\0" * 4
    assert list(long.ids_crc32) == [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(long.start, long.length)]
    assert list(out[out.doc_id == 2].length) == [1]
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0


def best_fit_count(sizes, capacity):
    """Bins of best-fit decreasing, by looking at every open bin."""
    free = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, f in enumerate(free) if f >= size]
        if fitting:
            free[min(fitting, key=lambda i: free[i])] -= size
        else:
            free.append(capacity - size)
    return len(free)


@pytest.mark.parametrize("shape", [(1, 100), (40, 70), (1, 30), (50, 50)])
def test_merged_packing_is_as_tight_as_one_best_fit(spark, shape):
    rng = random.Random(4)
    sizes = [rng.randint(*shape) for _ in range(700)]
    frame = spark.createDataFrame(list(enumerate(sizes)), "n long, length long")
    out = packing.pack(frame, capacity=100, group_rows=70).toPandas()
    fills = out.groupby("sequence_id").length.sum().sort_values()
    assert len(out) == 700 and fills.max() <= 100 and (len(fills) < 2 or fills.iloc[0] + fills.iloc[1] > 100)
    # Ten small groups come near to one best-fit packing of all pieces.
    assert len(fills) <= 1.06 * best_fit_count(sizes, 100) + 1
    alone = packing.best_fit(np.array(sizes), 100)
    assert len(alone[2]) == best_fit_count(sizes, 100)


def test_top_k_of_repeated_ids(spark):
    """Each row is a query of its own, and a candidate of all rows but itself."""
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(frame.filter("vec_id = 0"), frame, 3).collect()
    truth = []
    for n, (q, v) in enumerate(rows):
        if q == 0:
            best = sorted((-int(256 * v[0]) * int(256 * w[0]), i) for m, (i, w) in enumerate(rows) if m != n)[:3]
            truth += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(truth)


def test_large_doubles_are_floored_before_they_are_whole(spark):
    x = -(1e12 + 2.0**-13)
    frame = spark.createDataFrame([(50, [x]), (1, [1.0]), (2, [2.0**60])], "vec_id long, embedding array<double>")
    out = {(r.query_id, r.vec_id): r.score for r in topk.top_k(frame, frame, 5).collect()}
    assert out[50, 1] == math.floor(Fraction(x) * 256) * 256 == -65536000000000256 and out[1, 2] == 2**63 - 1


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 7]) for i in range(150)] + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan"), 0.0, 0.0, 0.0]), (2003, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (2004, [])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in vectors + odd], "vec_id long, embedding array<double>, score double")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame.filter("vec_id % 50 = 0"), frame, 5).collect()}
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    for q, qv in [x for x in usable if x[0] % 50 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert {q for q, _ in got} == {i for i, _ in usable if i % 50 == 0}
    assert topk.top_k(frame.limit(0), frame, 5).count() == 0


def test_top_k_of_huge_components_and_few_candidates(spark):
    frame = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, -3.0])], "vec_id long, embedding array<double>")
    out = topk.top_k(frame.filter("vec_id = 0"), frame, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, (256 * 10**9) ** 2 if (256 * 10**9) ** 2 < 2**63 else 2**63 - 1), (2, 2**63 - 1)]
