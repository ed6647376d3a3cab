"""Arrow columns of normalised texts in Python workers: words and 3-grams as numbers, found for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters and digits are 1 to 36, 0 is none: a gram is a number of three such places, so there are this many.
GRAMS = 37**3
_PLACE = np.zeros(256, np.int64)
_PLACE[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = np.arange(1, 37)
_LETTER = np.frombuffer(b" 0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)

#: Bytes of text, and texts, that are worked on at once.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512


def slices(column: pa.Array, at_once: int = SLICE_ROWS, size_at_once: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of a column that end at the first text which takes them past a size."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(column):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size_at_once)) + 1
        to = min(to, at + at_once, len(column))
        yield column.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by a space, and the n + 1 offsets of texts with their space."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(" ".join(x or "" for x in column.to_pylist()).encode() + b" ", np.uint8) if len(column) else np.zeros(0, np.uint8)
    return raw, np.concatenate([[0], np.cumsum(size + 1)])


def gram_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of every 3-gram within a word; a shorter word is its own gram."""
    c = np.concatenate([[0], _PLACE[raw], [0, 0]])
    here, after, last = c[1:-2], c[2:-1], c[3:]
    first = (c[:-3] == 0) & (here > 0)
    whole = (here > 0) & (after > 0) & (last > 0)
    short = first & ~((after > 0) & (last > 0))
    at = np.flatnonzero(whole | short)
    code = here[at] * 1369 + after[at] * 37 + np.where(after[at] > 0, last[at], 0)
    return np.searchsorted(off, at, side="right") - 1, code


def gram_text(code: np.ndarray) -> list[str]:
    """The grams of codes."""
    places = np.stack([code // 1369, code // 37 % 37, code % 37], 1)
    return [bytes(_LETTER[p[p > 0]]).decode() for p in places]


def code_of(gram: str) -> int:
    p = [int(_PLACE[b]) for b in gram.encode()] + [0, 0]
    return p[0] * 1369 + p[1] * 37 + p[2]


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of normalised texts end to end, and the text of each."""
    got = pc.split_pattern(pc.fill_null(column, ""), " ")
    n = pc.list_value_length(got).to_numpy(zero_copy_only=False).astype(np.int64)
    return got.flatten(), np.repeat(np.arange(len(column)), n)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, by sorting: many times as fast here as the library's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]
