"""Best-fit packing: token pieces into as few sequences as possible, by hierarchical residual packing.

Pieces are dealt to groups of bounded size. Each group is packed best-fit decreasing. In such a packing no two bins fit
together, so at most one bin of a group is half empty: only that one can still move. Each group emits its nearly full bins and
passes the CARRIED emptiest on as items of their own; FAN_IN groups merge at a time, are packed best-fit again, and so on
until one group is left. Nothing is lost by CARRIED: a merge has at most FAN_IN half-empty bins, each of which needs one
other bin to go into, and what fits a fuller bin fits an emptier one; so the FAN_IN emptiest of each group and one more a
level would do. At the end no two sequences fit together (tests check that), as in a single best-fit packing of all pieces.

Token counts: the tokenizer's own ids. A text in which every character belongs to a set where normalisation is plain
lower-casing is split by the vocabulary's published pattern and its words are merged by the same vocabulary's ranks,
many in one call, with a cache of common words; any other text goes through the tokenizer whole. Both give the same ids (tests compare them).

Defined cases: null and empty texts are one end token; texts longer than a sequence are cut into full pieces and a
rest; rows equal in id and text are packed once each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import restored_id, scratch, table, whole_id

CAPACITY, GROUP_ROWS, FAN_IN, CARRIED = 2048, 5000, 8, 64
#: Characters for which the vocabulary's normaliser is lower-casing only.
PLAIN = re.compile(r"[!-~¡-ÿ‐-‧€]+\Z")
#: The vocabulary's published split pattern, on words of PLAIN characters: letters, single digits, runs of others.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\w\s]|_)+")
#: White space of str.split() that the vocabulary's pattern may see otherwise.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHE_WORDS = 300_000


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class WordEncoder:
    """The vocabulary's merges as ranks of byte strings, a word's end being a zero byte: many words in one call.

    The joining of a last byte with the end comes before all merges, then they rank in the vocabulary's order."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_of_symbol()

        def as_bytes(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(of[c] for c in body) + b"\0" * (body != token)

        merged = [as_bytes("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        names = [bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(1, 256)] + merged
        ranks = {name: rank for rank, name in enumerate(names)}
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ids, self.ends = np.zeros(len(names), "<u4"), np.array([n.endswith(b"\0") for n in names])
        for token, number in model["vocab"].items():
            if all(c in of for c in token.removesuffix("</w>")) and (rank := ranks.get(as_bytes(token))) is not None:
                self.ids[rank] = number

    def __call__(self, words: list[str]) -> list[bytes]:
        found = np.array(self.encoding.encode_ordinary("\0".join(words) + "\0"), "i8")
        stops = (np.flatnonzero(self.ends[found]) + 1) * 4
        flat = self.ids[found].tobytes()
        return [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


class TokenCounter:
    """Token ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.encoder, self.words = Tokenizer.from_file(path), WordEncoder(path), {}

    def exact(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """No pattern match spans white space, so the ids of a plain text are those of its words."""
        if "<|" in text or (any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else ODD_SPACE.search(text)):
            return self.exact(text)
        words, cache = text.lower().split(), self.words
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if not new:
            return b"".join([cache[w] for w in words])
        if not all(map(PLAIN.match, new)):
            return self.exact(text)
        split = [SPLIT.findall(w) for w in new]
        coded = iter(self.encoder([p for parts in split for p in parts]))
        known = {w: b"".join([next(coded) for _ in parts]) for w, parts in zip(new, split)}
        if len(cache) + len(known) <= CACHE_WORDS:
            cache.update(known)
        else:  # a full cache stays as it is: words met early are the common ones
            known.update((w, cache[w]) for w in set(words) & cache.keys())
            cache = known
        return b"".join([cache[w] for w in words])


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces; the document ends in id 0."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer_path)
        for p in parts:
            out = []
            for doc, none, text in zip(p["id"], p["none"], p["text"]):
                ids = count(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, none, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["id", "none", "piece", "start", "length", "ids_crc32"])

    cut_up = docs.select(*whole_id(id_col), F.col(text_col).alias("text")).mapInPandas(cut, "id long, none boolean, piece int, start long, length long, ids_crc32 long")
    return cut_up.select(restored_id().alias("doc_id"), "piece", "start", "length", "ids_crc32")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the bins' fills. Free space is looked up in a bit mask of the sizes that are open."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    fills: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order.tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = open_at[free].pop()
            if not open_at[free]:
                mask ^= 1 << free
        else:
            b, free = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := free - size:
            open_at[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, dtype=np.int64)


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to items, which has a column length of 1 to capacity; every row is packed once."""
    names = items.columns
    kept, local_schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes), None
    n = items.count()
    groups = max(1, math.ceil(n / group_rows))
    # Equal rows are told apart by nothing, so any split of them is as good: the row's place in its file spreads them.
    dealt = items.withColumn("_group", F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(groups)))
    local_schema = f"{kept}, _group long, _bin long, _at long"

    def locally(part: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, _ = best_fit(part["length"].to_numpy(), capacity)
        return part.assign(_bin=part["_group"].to_numpy() * 2**32 + bins, _at=offsets)

    local = scratch(dealt.groupBy("_group").applyInPandas(locally, local_schema), "pack-local")
    # The bins that can still change: of each group the emptiest, one of them at most under half full.
    live = local.groupBy("_group", "_bin").agg(F.sum("length").alias("fill"))

    def emptiest(part: pd.DataFrame) -> pd.DataFrame:
        return part.nsmallest(CARRIED, ["fill", "_bin"])

    open_bins = scratch(live.groupBy("_group").applyInPandas(emptiest, "_group long, _bin long, fill long"), "pack-open")
    # moved: a first-level bin, the bin that now holds it, and its offset there.
    moved, level = open_bins.select("_bin", F.col("_bin").alias("_to"), F.lit(0).cast("long").alias("_shift")), groups
    while level > 1:
        level = math.ceil(level / FAN_IN)

        def merge(part: pd.DataFrame) -> pd.DataFrame:
            bins, offsets, _ = best_fit(part["fill"].to_numpy(), capacity)
            frame = part.assign(_local=bins, _by=offsets)
            host = frame[frame["_by"] == 0].set_index("_local")["_bin"]
            return pd.DataFrame({"_group": part["_group"], "_from": part["_bin"], "_host": frame["_local"].map(host), "_by": offsets, "fill": part["fill"]})

        merged = scratch(open_bins.withColumn("_group", F.expr(f"_group div {FAN_IN}")).groupBy("_group").applyInPandas(merge, "_group long, _from long, _host long, _by long, fill long"), "pack-merge")
        moved = scratch(moved.join(merged.select(F.col("_from").alias("_to"), "_host", "_by"), "_to", "left").select("_bin", F.coalesce("_host", "_to").alias("_to"), (F.col("_shift") + F.coalesce("_by", F.lit(0))).alias("_shift")), "pack-moved")
        open_bins = merged.groupBy("_group", F.col("_host").alias("_bin")).agg(F.sum("fill").alias("fill")).groupBy("_group").applyInPandas(emptiest, "_group long, _bin long, fill long")
    placed = local.join(moved, "_bin", "left")
    return placed.select(*names, F.coalesce("_to", "_bin").alias("sequence_id"), (F.col("_at") + F.coalesce("_shift", F.lit(0))).alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return pack(scratch(pieces(docs, public_tokenizers.path(tokenizer)), "pack-pieces"))
