"""Texts of a batch as flat arrays of code points, in groups of bounded size, for numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

GROUP_CHARS, GAP = 500_000, 4
BLANK, NO_WORD = re.compile(r"\s"), re.compile(r"\W")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def groups(texts: Sequence[str | None], group_chars: int = GROUP_CHARS, at_lines: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """rows, starts and codes: the texts' row numbers, where each starts in codes, and the code points.

    A text has a space before it, which counts as its own, and GAP spaces after it, so no text sees its neighbours.

    A text longer than a group is cut into several entries of the same row, so memory stays bounded: at white space, or where none is
    near at another character that is in no word. No word is cut. With at_lines it is cut at line breaks only, so a line is never cut."""
    rows, parts, size = [], [], 0

    def flush():
        starts = np.cumsum([0, *(len(p) + GAP + 1 for p in parts[:-1])])
        joined = " " + (" " * (GAP + 1)).join(parts) + " " * GAP
        return np.array(rows), starts, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")

    for row, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = len(text)
            if end - at > group_chars:
                if at_lines:
                    end = text.find("\n", at + group_chars) + 1 or end
                else:
                    cut = BLANK.search(text, at + group_chars, at + 2 * group_chars) or NO_WORD.search(text, at + group_chars)
                    end = cut.end() if cut else end
            rows.append(row)
            parts.append(text[at:end])
            size += end - at + GAP
            at = end
            if size >= group_chars:
                yield flush()
                rows, parts, size = [], [], 0
            if at >= len(text):
                break
    if parts:
        yield flush()


_tables: dict[str, np.ndarray] = {}


def table_of(kind: str, test, dtype: str = "u1") -> np.ndarray:
    """test(character) for every code point, made once in a process."""
    if kind not in _tables:
        _tables[kind] = np.array([test(chr(c)) for c in range(0x110000)], dtype=dtype)
    return _tables[kind]
