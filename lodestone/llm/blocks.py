"""Arrow text columns as flat byte arrays, words as spans, and word hashes, all vectorised.

Every function works on bounded sub-blocks: a block ends at the first document that
takes it past ``BLOCK_BYTES``, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_SEGMENT = 1 << 20

#: Word separators of the contracts: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_rng.integers(1 << 59, 1 << 60)) * 8 + 5
_P_INV = pow(_P, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_pow: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    """P**i (or its inverse) modulo 2**64 for i < n, kept between calls."""
    have = _pow.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        base = np.full(size, np.uint64(_P if kind == "p" else _P_INV), np.uint64)
        base[0] = 1
        have = _pow[kind] = np.multiply.accumulate(base)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def sub_blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive runs of whole documents."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes that are no separators; words never cross documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SEPARATOR[data]
    first = np.empty(len(data) + 1, bool)  # a word may begin here
    first[0] = True
    first[1:-1] = ~word[:-1]
    first[offsets[:-1]] = True
    first[-1] = True
    starts = np.flatnonzero(word & first[:-1])
    last = np.empty(len(data), bool)
    last[:-1] = ~word[1:]
    last[-1] = True
    cut = offsets[1:-1]
    last[cut[(cut > 0)] - 1] = True
    ends = np.flatnonzero(word & last) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, docs


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + _SEGMENT, "right")))
        hi = int(ends[to - 1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * _powers("p", hi - lo), out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * _powers("i", hi - lo)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def trim() -> None:
    """Gives memory that is free back to the system: workers live on, and others need it meanwhile. Does nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    step = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    step[0] = starts[0]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def sum_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of float values by owner."""
    return np.bincount(owner, weights=values, minlength=n)
