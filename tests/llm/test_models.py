"""op3 and op6: held-out accuracy on the small tables, and awkward rows."""

import math
import random

import pytest

from corpusloom.llm import language, quality
from corpusloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_language(spark):
    out = QUERIES["op3_hierarchical_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == 1000 and len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_of_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat and the dog are here", "en", ""), (2, "der hund und die katze sind hier", "de", ""), (3, "le chat et le chien sont ici", "fr", "")] * 3
    model = language.Hierarchy(language.sample(spark.createDataFrame(rows, schema)))
    odd = spark.createDataFrame([(1, None, None, ""), (2, "", None, ""), (3, "123 !!", None, ""), (4, "the dog " * 200_000, None, ""), (4, "the dog", None, ""), (5, "中文", None, "")], schema)
    out = language.predict(odd, model).collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and out[3].lang_pred == out[4].lang_pred == "en" and out[5].lang_pred in {"en", "de", "fr"}
    nothing = language.Hierarchy(language.sample(spark.createDataFrame([], schema)))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    alone = language.Hierarchy(language.sample(spark.createDataFrame(rows[:1], schema)))
    assert language.predict(odd, alone).collect()[4].lang_pred == "en" and language.predict(odd.limit(0), alone).count() == 0


def naive_grams(text):
    """Slots of a text's 1 to 4 character n-grams with word edges, one by one."""
    slots = []
    padded = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0" * 8
    for i, c in enumerate(padded[:-8]):
        if c == "\0" and padded[i + 1] == "\0":
            continue
        h = 2166136261
        for n in range(language.GRAMS):
            if n > 1 and padded[i + n - 1] == "\0":
                break
            h = ((h ^ ord(padded[i + n])) * 16777619) & 0xFFFFFFFF
            slots.append((h ^ (h >> 15)) % language.DIMS)
    return slots


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs] + [(9001, "Ein Wort", None), (9002, "a", None), (9003, "x1y2 z", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.Hierarchy(language.sample(frame))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame, model).collect()}
    for doc, text, _ in rows:
        slots = naive_grams(text)
        mean = [sum(float(model.weights[s, j]) for s in slots) / len(slots) + float(model.bias[j]) for j in range(model.weights.shape[1])]
        level, score = "", 1.0
        for _ in range(2):
            wins, total = {}, {}
            for j, (f, a, b) in enumerate(model.pairs):
                if f == level:
                    p = 1 / (1 + math.exp(-4 * max(-10, min(10, mean[j]))))
                    for side, q in ((a, p), (b, 1 - p)):
                        wins[side], total[side] = wins.get(side, 0) + (q > 0.5), total.get(side, []) + [q]
            if wins:
                level = max(sorted(wins), key=lambda x: (wins[x], sum(total[x])))
                score *= sum(total[level]) / len(total[level])
            else:
                level = next(x for x in model.langs if model.family[x] == level)
        assert got[doc][0] == level and abs(got[doc][1] - score) < 1e-4, doc


def test_a_repeated_row_is_learned_once(spark):
    rows = [(1, "the cat and the dog", "en")] * 500 + [(2, "der hund und die katze", "de")]
    data = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert data["lang"].value_counts().to_dict() == {"en": 1 + language.SPANS, "de": 1 + language.SPANS}


def naive_em(votes, steps):
    """Expectation maximisation text by text, labeller by labeller."""
    post = [0.9 if "b" in v else 0.05 for v in votes]
    for _ in range(steps):
        prior = min(max(sum(post) / len(post), 1e-4), 1 - 1e-4)
        rate = {}
        for side in (0, 1):
            weight = [p if side == 0 else 1 - p for p in post]
            for j in range(len(votes[0])):
                for c in "bg":
                    rate[side, j, c] = sum(w for w, v in zip(weight, votes) if v[j] == c) / max(sum(weight), 1e-9) * (1 - 2e-4) + 1e-4
        new = []
        for v in votes:
            bad, good = math.log(prior), math.log(1 - prior)
            for j, c in enumerate(v):
                if c != "-":
                    bad, good = bad + math.log(rate[0, j, c]), good + math.log(rate[1, j, c])
            new.append(1 / (1 + math.exp(max(-60, min(60, good - bad)))))
        post = new
    return dict(zip(votes, post))


def test_expectation_maximisation_equals_brute_force():
    rng = random.Random(2)
    votes = []
    for _ in range(300):
        bad = rng.random() < 0.7  # most of the corpus may be junk
        votes.append("".join("b" if rng.random() < (0.6 if bad else 0.03) else "-" for _ in range(5)) + "".join("g" if rng.random() < (0.1 if bad else 0.9) else "-" for _ in range(2)))
    counts = {v: votes.count(v) for v in set(votes)}
    got, _ = quality.expectation_maximisation(counts, 20)
    assert got == pytest.approx(naive_em(votes, 20), abs=1e-9)


def test_a_corpus_of_mostly_junk(spark):
    prose = "A plain sentence of ordinary words, nothing more. We walked along the river, and it was late. "
    rows = [(i, f"{prose * (2 + i % 3)}Number {'abcdefgh'[i % 8]} of it.") for i in range(40)] + [(1000 + i, f"zap%%% zip### {'qrst'[i % 4]}op&&& x$$$ " * (9 + i % 5)) for i in range(160)]
    out = quality.filter_quality(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == set(range(40))


def test_quality(spark):
    out = QUERIES["op6_weak_label_quality"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").selectExpr("doc_id", "quality AS truth")
    joined = out.join(labels, "doc_id").toPandas()
    good, bad = joined[joined.truth == 1], joined[joined.truth == 0]
    assert len(out.toPandas()) == 1000 and good.keep.mean() > 0.99 and (~bad.keep).mean() > 0.9


def test_labellers_and_awkward_rows(spark):
    assert quality.vote(quality.measure(["x " * 50])[0][0])[quality.LABELLERS.index("stutter")] == "b"
    assert quality.vote(quality.measure([None])[0][0])[0] == "b"
    posterior, accuracy = quality.expectation_maximisation({"b----b-": 10, "-----gg": 90})
    assert posterior["b----b-"] > 0.9 and posterior["-----gg"] < 0.1 and set(accuracy) == set(quality.LABELLERS)
    prose = "A plain sentence of ordinary words, nothing more. " * 5
    rows = [(i, prose + str(i), "kept") for i in range(30)] + [(90 + i, "zap%%% zip### zop&&& " * 9, "") for i in range(6)] + [(200, None, ""), (201, "", ""), (7, prose + "7", "kept"), (300, prose * 20_000, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and {r.quality for r in kept.collect()} == {"kept"} and kept.count() == 32
    assert quality.filter_quality(docs.limit(0)).count() == 0
