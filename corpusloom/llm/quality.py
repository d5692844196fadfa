"""Weak-label quality model: heuristic labellers, expectation maximisation, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a text. Over all texts the votes are counted by pattern (at most 3 to the
number of labellers), and expectation maximisation estimates from these counts each labeller's vote rates on good and
bad texts, and the share of bad texts. The posterior of each pattern labels a bounded sample of rows (MAX_SAMPLE, of
smallest hash, the same number from each side where there are enough), on which a logistic scorer over hashed word
shapes is fitted. The scorer judges every text.

Defined cases: null and empty texts have no words, score 0 and are rejected; long texts are read whole; repeated rows
get one result each; an empty table gives an empty result; extra columns, clashing names included, are passed through
by filter_quality and ignored by score_quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes
from .common import scratch, table

DIMS, MAX_SAMPLE, EM_STEPS, THRESHOLD = 1024, 20_000, 60, 0.5
#: A text's measures: words, and the shares of its words that are noisy, a bar, shouted, equal to the last word, at a sentence's end, digits.
MEASURES = ("words", "symbols", "bars", "shouts", "repeats", "ends", "digits")
#: Labellers. Those of junk vote bad or nothing; prose votes good or nothing; sentences votes both ways.
LABELLERS = ("symbol_noise", "table_bars", "shouting", "stutter", "digit_noise", "sentences", "prose")
#: Character kinds: white space, lower or uncased letter, capital, digit, sentence end, other punctuation of prose, bar, symbol.
SPACE, LETTER, CAPITAL, DIGIT, END, PUNCT, BAR, SYMBOL = range(8)


def kind_of(c: str) -> int:
    if c.isspace():
        return SPACE
    if c.isalpha():
        return CAPITAL if c.isupper() else LETTER
    if c.isdigit():
        return DIGIT
    return END if c in ".!?" else PUNCT if c in ",;:'\"()¿¡-’“”–" else BAR if c == "|" else SYMBOL


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its measures, and the shares of its words in each hashed word shape followed by its scaled measures."""
    sums, shapes = np.zeros((len(texts), len(MEASURES))), np.zeros((len(texts), DIMS), "f4")
    kinds_of = codes.table_of("quality", kind_of)
    for rows, starts, points in codes.groups(texts):
        kinds = kinds_of[points]
        solid = kinds != SPACE
        first = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
        if not len(first):
            continue
        last = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False])))
        owner = np.searchsorted(starts, first, "right") - 1
        number = {k: np.diff(np.concatenate(([0], np.cumsum(kinds == k)))[np.stack([first, last + 1])], axis=0)[0] for k in (LETTER, CAPITAL, DIGIT, END, PUNCT, SYMBOL)}
        letters = number[LETTER] + number[CAPITAL]
        # A word's content as a polynomial of its code points, to see that it repeats.
        at = np.arange(len(points))
        at[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(points))))
        power = np.cumprod(np.full(64, 0x9E3779B1, "u8"))
        content = np.add.reduceat(np.where(solid, points.astype("u8") * power[at & 63], 0), first)
        same = np.zeros(len(first), bool)
        same[1:] = (content[1:] == content[:-1]) & (owner[1:] == owner[:-1])
        shouted = (number[CAPITAL] > 1) & (number[LETTER] == 0)
        noisy = (number[SYMBOL] >= 2) | (number[END] >= 2)
        ends = (kinds[last] == END) & ~noisy
        flags = (noisy, (kinds[first] == BAR) & (first == last), shouted, same, ends, number[DIGIT] > letters)
        np.add.at(sums[:, 0], rows, np.bincount(owner, minlength=len(rows)))
        for j, flag in enumerate(flags, 1):
            np.add.at(sums[:, j], rows, np.bincount(owner[flag], minlength=len(rows)))
        case = np.where(shouted, 2, number[CAPITAL] > 0)
        shape = (((np.minimum(letters, 12) * 3 + case) * 4 + np.minimum(number[SYMBOL], 3)) * 4 + np.minimum(number[END], 3)) * 6 + np.minimum(number[PUNCT], 2) * 2 + (number[DIGIT] > 0)
        slot = (shape.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(DIMS - 16)
        counted = np.bincount(owner * DIMS + slot.astype("i8"), minlength=len(rows) * DIMS).reshape(len(rows), DIMS)
        np.add.at(shapes, rows, counted.astype("f4"))
    n = np.maximum(sums[:, :1], 1)
    sums[:, 1:] /= n
    shapes /= n.astype("f4")
    shapes[:, DIMS - 16 : DIMS - 16 + len(MEASURES) - 1] = np.minimum(1, sums[:, 1:] * 2)
    return sums, shapes


def vote(m: np.ndarray) -> str:
    """One letter for each labeller: b, g or - ."""
    words, symbols, bars, shouts, repeats, ends, digits = m
    if not words:
        return "b" * (len(LABELLERS) - 1) + "-"
    bad = (symbols > 0.15, bars > 0.10, shouts > 0.40 and words > 3, repeats > 0.20, digits > 0.40)
    prose = symbols < 0.05 and bars < 0.02 and shouts < 0.15 and repeats < 0.10 and digits < 0.15
    sentences = "b" if words > 40 and ends < 0.005 else "g" if 0.02 < ends < 0.6 and bars < 0.02 else "-"  # cells of a table are no sentences
    return "".join("b" if x else "-" for x in bad) + sentences + ("g" if prose else "-")


def expectation_maximisation(counts: dict[str, int], steps: int = EM_STEPS) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """The posterior of bad for each vote pattern, and each labeller's estimated accuracy (of its bad and good votes)."""
    # An abstention is no evidence: only votes enter the likelihood.
    patterns = sorted(counts)
    if not patterns:
        return {}, {}
    n = np.array([counts[p] for p in patterns], dtype=float)
    one_hot = np.array([[[c == v for v in "bg"] for c in p] for p in patterns], dtype=float)
    post = np.array([0.9 if "b" in p else 0.05 for p in patterns])
    for _ in range(steps):
        prior = float(np.clip((n * post).sum() / n.sum(), 1e-4, 1 - 1e-4))
        rates = []
        for side in (post, 1 - post):
            rates.append(((n * side)[:, None, None] * one_hot).sum(0) / max((n * side).sum(), 1e-9) * (1 - 2e-4) + 1e-4)
        log = [np.log(p) + (one_hot * np.log(r)[None]).sum((1, 2)) for p, r in zip((prior, 1 - prior), rates)]
        post = 1 / (1 + np.exp(np.clip(log[1] - log[0], -60, 60)))
    prior = float(np.clip((n * post).sum() / n.sum(), 1e-4, 1 - 1e-4))
    accuracy = {}
    for j, name in enumerate(LABELLERS):
        bad, good = rates[0][j], rates[1][j]
        accuracy[name] = {"bad_vote": prior * bad[0] / (prior * bad[0] + (1 - prior) * good[0]), "good_vote": (1 - prior) * good[1] / (prior * bad[1] + (1 - prior) * good[1])}
    return dict(zip(patterns, post.tolist())), accuracy


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 400, reg: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both sides weighing the same; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), "f4")])
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight = (weight / weight.sum()).astype("f4")
    rate = 1 / (0.25 * float((weight * (x * x).sum(1)).sum()) + reg)
    w, look = np.zeros(x.shape[1], "f4"), np.zeros(x.shape[1], "f4")
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        new = look - rate * (reg * look + x.T @ (weight * (p - y)))
        look, w = new + t / (t + 3) * (new - w), new
    return w


def fit_quality(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> tuple[np.ndarray, dict]:
    """The scorer's weights, and the labellers' estimated accuracies. docs needs a column text."""

    def voted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"h": p["h"], "pattern": [vote(m) for m in measure(p["text"].tolist())[0]]})

    keyed = docs.select("text", F.xxhash64("text").alias("h"))
    ballots = scratch(keyed.mapInPandas(voted, "h long, pattern string"), "quality-votes")
    counts = {r[0]: r[1] for r in ballots.groupBy("pattern").count().collect()}
    posterior, accuracy = expectation_maximisation(counts)
    if not posterior:
        return np.zeros(DIMS + 1, "f4"), accuracy
    chosen = None
    for bad in (True, False):
        patterns = [p for p, v in posterior.items() if (v >= 0.5) == bad]
        side = ballots.filter(F.col("pattern").isin(patterns)).select("h", "pattern").distinct().orderBy("h").limit(max_sample // 2)
        chosen = side if chosen is None else chosen.unionByName(side)

    def shaped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            shapes = measure(p["text"].tolist())[1]
            at = [np.flatnonzero(x).astype("i4") for x in shapes]
            yield pd.DataFrame({"pattern": p["pattern"], "at": [a.tobytes() for a in at], "v": [x[a].tobytes() for x, a in zip(shapes, at)], "h": p["h"]})

    # At most max_sample hashes are broadcast, and as many sparse vectors reach the driver.
    rows = keyed.join(F.broadcast(chosen), "h").mapInPandas(shaped, "pattern string, at binary, v binary, h long").dropDuplicates(["h"]).toPandas().sort_values("h")
    x = np.zeros((len(rows), DIMS), "f4")
    for i, (at, v) in enumerate(zip(rows["at"], rows["v"])):
        x[i, np.frombuffer(at, "i4")] = np.frombuffer(v, "f4")
    return _fit(x, np.array([1 - posterior[p] for p in rows["pattern"]], "f4")), accuracy


def good_share(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The scorer's probability of good; 0 for texts without a word."""
    measures, shapes = measure(texts)
    return np.where(measures[:, 0] > 0, 1 / (1 + np.exp(-np.clip((shapes @ weights[:-1] + weights[-1]).astype("f8"), -30, 30))), 0.0)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "quality") -> DataFrame:
    """docs with the scorer's probability of good in place of the text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(good_share(texts.tolist(), weights))

    return docs.select(*[c for c in docs.columns if c not in (text_col, score_col)], score(text_col).alias(score_col))


def filter_quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the scorer takes for good, with all their columns."""
    weights, _ = fit_quality(docs)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(good_share(texts.tolist(), weights) >= threshold)

    return docs.filter(good("text"))


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, _ = fit_quality(docs)
    return score_quality(docs, weights).withColumn("keep", F.col("quality") >= THRESHOLD)
