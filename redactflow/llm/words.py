"""Words of whole texts as 64-bit keys, for a chunk of texts at once.

A word is a run of bytes that are no separators. Its key is a polynomial of its bytes modulo 2**64, mixed, so that
equal words have equal keys; two different words share one with probability about 2**-64. No Python object is made
per word: a text of any length costs a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators between words: space and tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Separators that leave ASCII digits, ASCII letters and everything beyond ASCII.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[:0x80] = [not chr(i).isalnum() for i in range(0x80)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

CHUNK_BYTES = 1 << 20
KEPT_POWERS = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for the usual chunk size, made anew for longer texts."""
    if n <= KEPT_POWERS:
        if base not in _powers or len(_powers[base]) < n:
            _powers[base] = _run(base, 1 << max(20, (n - 1).bit_length()))
        return _powers[base][:n]
    return _run(base, n)


def _run(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """``keys`` of all words of a chunk; text ``i`` owns words ``bounds[i]`` to ``bounds[i + 1]``.

    ``starts`` and ``ends`` are byte positions in ``data``; text ``i`` begins at byte ``offsets[i]``.
    """

    keys: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the offset of each text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(column: pa.Array, lower: bool = False, separators: np.ndarray = BLANKS) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(span_keys(data, starts, ends), np.searchsorted(starts, offsets), starts, ends, data, offsets)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the bytes from ``starts`` to ``ends``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_UNBASE, len(data))[starts])


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def window_keys(keys: np.ndarray, bounds: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every run of ``width`` words that lies inside one text."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = pow(_BASE + 2 * seed, 3, 1 << 64) | 1
    out = keys[:n].copy()
    for i in range(1, width):
        out *= np.uint64(base)
        out += keys[i : i + n]
    inside = np.zeros(n + 1, np.int32)
    ends = bounds[1:-1]
    np.add.at(inside, np.clip(ends - width + 1, 0, n), 1)
    np.add.at(inside, np.clip(ends, 0, n), -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    return at, mix(out[at])
