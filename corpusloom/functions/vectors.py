"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

import hashlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))))


def cosine_from_l2(distance: Column) -> Column:
    """Holds for unit vectors only: check is_unit or use normalize_l2."""
    return 1 - distance * distance / 2


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v.cast("array<double>"), lambda x: x * x)))


def is_unit(v: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def normalize_l2(v: Column) -> Column:
    return let(norm(v), lambda size: F.transform(v.cast("array<double>"), lambda x: F.when(size > 0, x / size).otherwise(0.0)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: expressions inside a lambda are computed for every element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trigrams(text: Column) -> Column:
    """Lower-case trigrams in order; none for texts of under three characters. Linear in the text: characters are split once."""
    chars = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))
    runs = lambda cs: F.when(F.size(cs) >= 3, F.transform(F.sequence(F.lit(0), F.size(cs) - 3), lambda i: F.concat(F.get(cs, i), F.get(cs, i + 1), F.get(cs, i + 2)))).otherwise(F.array().cast("array<string>"))
    return let(chars, runs)


def bucket(trigram: str, dims: int) -> int:
    return int(hashlib.md5(trigram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dims


def hash_counts(text: Column, dims: int = 64) -> Column:
    """How many lower-case trigrams of a text fall into each of dims slots. Each trigram is hashed once in a batch, and counted in the text's own pass."""

    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}
        out = []
        for t in texts:
            low, found = (t or "").lower(), [0] * dims
            for gram, n in Counter(map("".join, zip(low, low[1:], low[2:]))).items():
                slot = slots.get(gram)
                if slot is None:
                    slot = slots[gram] = bucket(gram, dims)
                found[slot] += n
            out.append(found)
        return pd.Series(out, dtype=object)

    return counts(text)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Deterministic vectors without a model: hashed trigram counts, normalised."""
    return let(hash_counts(text, dims).cast("array<double>"), normalize_l2)
