"""Language ID by hierarchical discrimination: first the family, then one-versus-one linear SVMs within it.

A text is seen as its words' hashed character n-grams (1 to 4 characters with word edges). Every model is linear, so a
word's part in each model is a fixed vector that a task keeps in a cache; a text's score is the sum over all of its
words divided by its number of n-grams. The models are fitted on a bounded sample: for each language the
MAX_PER_LANG labelled rows with the smallest hash, each also as a few short spans, so short texts are learned too.

Defined cases: null text or text without a letter is "und" with score 0; a text is read whole, however long; with one
learned language that language is the answer; without any labelled row every text with a letter is "und"; repeated
rows get one result each; languages outside the family table form families of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codes
from .common import scratch, table

#: Language families (ISO 639-1 codes).
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
DIMS, MAX_PER_LANG, SPANS, GRAMS = 4096, 200, 2, 4


def lower_letters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with everything but letters as 0, and which n-gram starts count: a letter, or the gap before one."""
    letter = codes.table_of("letter", str.isalpha)[points].astype(bool)
    seen = np.where(letter, points, 0)
    starts = letter.copy()
    starts[:-1] |= letter[1:]
    return seen, starts


def gram_slots(seen: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..GRAMS the start positions of n-grams and their slots. An n-gram is cut where its word has ended."""
    at = np.flatnonzero(starts)
    h, padded = np.full(len(at), 2166136261, "u4"), np.concatenate([seen, np.zeros(GRAMS, seen.dtype)])
    for n in range(GRAMS):
        if n:
            going = padded[at + n - 1] != 0 if n > 1 else np.ones(len(at), bool)
            at, h = at[going], h[going]
        h = (h ^ padded[at + n].astype("u4")) * np.uint32(16777619)
        yield at, ((h ^ (h >> np.uint32(15))) % np.uint32(DIMS)).astype("i4")


def features(texts: list[str]) -> np.ndarray:
    """The shares of the n-gram slots in each text."""
    out = np.zeros((len(texts), DIMS), "f4")
    for rows, begins, points in codes.groups([t.lower() for t in texts]):
        for at, slots in gram_slots(*lower_letters(points)):
            owner = np.searchsorted(begins, at, "right") - 1
            np.add.at(out, rows, np.bincount(owner * DIMS + slots, minlength=len(rows) * DIMS).reshape(len(rows), DIMS).astype("f4"))
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def margins(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean weight over its n-grams, for each model, and its number of n-grams."""
    total, number = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for rows, begins, points in codes.groups([(t or "").lower() for t in texts]):
        for at, slots in gram_slots(*lower_letters(points)):
            edges = np.searchsorted(at, begins)
            counts = np.diff(np.append(edges, len(at)))
            np.add.at(number, rows, counts)
            for j in range(weights.shape[1]):
                sums = np.concatenate(([0.0], np.cumsum(weights[slots, j], dtype="f8")))
                np.add.at(total[:, j], rows, sums[edges + counts] - sums[edges])
    return total / np.maximum(number, 1)[:, None], number


def sample(labelled: DataFrame, max_per_lang: int = MAX_PER_LANG) -> pd.DataFrame:
    """lang and features of the sample, at most max_per_lang rows a language; only features leave the executors."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # Spark cuts to max_per_lang keys a language in each task, so a language of any size is spread; repeated rows have one key.
    order = Window.partitionBy("lang").orderBy("h")
    picked = usable.select("lang", "h").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_per_lang)
    picked = scratch(picked.select("lang", "h"), "language-keys")

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            langs, spans = [], []
            for lang, text, h in zip(p["lang"], p["text"], p["h"]):
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                lengths = rng.integers(12, 90, SPANS)
                spans += [text, *(text[a : a + n] for a, n in zip(rng.integers(0, len(text), SPANS).tolist(), lengths.tolist()))]
                langs += [lang] * (1 + SPANS)
            x = features(spans)
            some = x.any(1)
            yield pd.DataFrame({"lang": np.array(langs)[some], "x": [v.tobytes() for v in x[some].astype("f2")]})

    # max_per_lang keys a language, and one row each: bounded, whatever the input.
    chosen = usable.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    return chosen.mapInPandas(vectors, "lang string, x binary").toPandas().sort_values(["lang", "x"], kind="stable")


def linear_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated gradient descent; the last weight is the bias."""
    x = np.hstack([x, np.full((len(x), 1), 0.02, "f4")])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype("f4")
    rate = 1 / (2 * float((weight * (x * x).sum(1)).sum()) + reg)
    w, look = np.zeros(x.shape[1], "f4"), np.zeros(x.shape[1], "f4")
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - rate * (reg * look - 2 * (x.T @ (weight * slack * y)))
        look = new + t / (t + 3) * (new - w)
        w = new
    return w


class Hierarchy:
    """Linear models of the two levels as one matrix: column j tells first[j] from second[j]."""

    def __init__(self, data: pd.DataFrame):
        self.langs = sorted(set(data["lang"]))
        self.family = {lang: FAMILY_OF.get(lang, lang) for lang in self.langs}
        families = sorted(set(self.family.values()))
        self.pairs = [("", a, b) for a, b in combinations(families, 2)]
        self.pairs += [(f, a, b) for f in families for a, b in combinations([x for x in self.langs if self.family[x] == f], 2)]
        x = np.vstack([np.frombuffer(v, "f2") for v in data["x"]]).astype("f4") if len(data) else np.zeros((0, DIMS), "f4")
        of, columns = {"": np.array([self.family[v] for v in data["lang"]])}, []
        lang = np.array(list(data["lang"]))
        for level, a, b in self.pairs:
            names = of[""] if level == "" else lang
            rows = (names == a) | (names == b)
            columns.append(linear_svm(x[rows], np.where(names[rows] == a, 1, -1).astype("f4")))
        self.weights = np.array(columns, "f4").T[:DIMS] if columns else np.zeros((DIMS, 0), "f4")
        self.bias = np.array([c[DIMS] * 0.02 for c in columns], "f4")

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """The family that wins most of its duels, then the language in it; the score is the product of both levels' mean duel probabilities."""
        chosen, score, level = None, 1.0, ""
        for _ in range(2):
            duels = [(j, a, b) for j, (f, a, b) in enumerate(self.pairs) if f == level]
            if duels:
                sides: dict[str, list[float]] = {}
                for j, a, b in duels:
                    p = 1 / (1 + np.exp(-4 * float(np.clip(margins[j], -10, 10))))
                    sides.setdefault(a, []).append(p)
                    sides.setdefault(b, []).append(1 - p)
                chosen = max(sorted(sides), key=lambda s: (sum(p > 0.5 for p in sides[s]), sum(sides[s])))
                score *= sum(sides[chosen]) / len(sides[chosen])
            elif level == "":
                chosen = next(iter(self.family.values()))
            else:
                chosen = next(x for x in self.langs if self.family[x] == level)
            level = chosen
        return chosen, score


def predict(docs: DataFrame, model: Hierarchy, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of the text."""

    @F.pandas_udf("lang_pred string, score double")
    def answer(texts: pd.Series) -> pd.DataFrame:
        means, number = margins(texts.tolist(), model.weights)
        found = [model.decide(m + model.bias) if n and model.langs else ("und", 0.0) for m, n in zip(means, number)]
        return pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [float(x[1]) for x in found]})

    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    return docs.select(*others, answer(text_col).alias("_answer")).select(*others, "_answer.lang_pred", "_answer.score")


def op3_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # A row without an id is never learned from.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = Hierarchy(sample(docs.filter(~held_out)))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
