"""Elias-Fano sequences in files that are mapped into memory, searched for many values at once.

A monotone sequence of n values below u keeps l = log2(u / n) low bits of each value in a packed array and the high
parts in unary: value i with high part h sets bit h + i, so the h-th zero ends the bucket of high part h. Counts of ones
and zeros before each 64-bit word answer select by one binary search and six steps inside a word.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid

import numpy as np
import pyarrow.fs as pafs

_ONE = np.uint64(1)
_SIX = np.uint64(63)


def _every_byte(x: int) -> np.uint64:
    return np.uint64(x * 0x0101010101010101)


#: [byte, n]: position of the n-th (from 0) set bit of a byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def _nth(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Position of the n-th (from 0) set bit of each word: running bit counts of its bytes in one word (Vigna, 2008),
    the byte by comparing all of them at once, the bit from a table."""
    n = n.astype(np.uint64)
    counts = word - ((word >> _ONE) & _every_byte(0x55))
    counts = (counts & _every_byte(0x33)) + ((counts >> np.uint64(2)) & _every_byte(0x33))
    counts = ((counts + (counts >> np.uint64(4))) & _every_byte(0x0F)) * _every_byte(1)
    before = ((n * _every_byte(1) | _every_byte(0x80)) - counts) & _every_byte(0x80)
    place = np.bitwise_count(before).astype(np.uint64) << np.uint64(3)
    n -= ((counts << np.uint64(8)) >> place) & np.uint64(0xFF)
    return place + _IN_BYTE[(word >> place) & np.uint64(0xFF), n]


def _directory(upto: np.ndarray) -> np.ndarray:
    """For every 64th of what ``upto`` counts, the word that holds it."""
    return np.searchsorted(upto, np.arange(0, int(upto[-1]) + 1, 64), side="right").astype(np.int32) - np.int32(1)


def _word_of(upto: np.ndarray, directory: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The word that holds number ``k``: the directory's, the next one, or, where values are far apart, by search."""
    word = directory[k >> 6].astype(np.int64)
    live = np.flatnonzero(upto[word + 1] <= k)
    word[live] += 1
    live = live[upto[word[live] + 1] <= k[live]]
    word[live] = np.searchsorted(upto, k[live].astype(upto.dtype), side="right") - 1
    return word


def _after(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a word has a set bit beyond position ``at``, how far it is to the first of them)."""
    rest = (word >> at) >> _ONE
    first = rest & (~rest + _ONE)
    return rest != 0, np.bitwise_count(first - _ONE).astype(np.int64) + 1


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, one after the other, with a word to spare."""
    out, step = [], 1 << 16
    for i in range(0, len(values), step):
        rows = np.unpackbits(values[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(np.packbits(rows[:, :bits].ravel(), bitorder="little"))
    raw = np.concatenate([*out, np.zeros(0, np.uint8)])
    return np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)]).view("<u8")


class Sequence:
    """A monotone sequence; ``arrays`` may be mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["head"])
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in ("low", "high", "ones", "zeros"))
        self.one_at, self.zero_at = arrays["one_at"], arrays["zero_at"]

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """``values``: uint64, ascending (repeats allowed), below ``universe``."""
        n = len(values)
        bits = max(0, min(56, (max(universe, 1) // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = int(((universe >> bits) + n + 1) // 64 + 1)
        unary = np.zeros(words * 64, bool)
        unary[high] = True
        unary = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(unary), dtype=np.int64)])
        zeros = 64 * np.arange(words + 1) - ones
        return {
            "head": np.array([n, bits], np.int64),
            "low": _pack(values, bits),
            "high": unary,
            "ones": ones.astype(np.min_scalar_type(64 * words)),
            "zeros": zeros.astype(np.min_scalar_type(64 * words)),
            "one_at": _directory(ones),
            "zero_at": _directory(zeros),
        }

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & _SIX
        # a shift by 64 is split in two
        out = (self.low[word] >> shift) | ((self.low[word + 1] << (_SIX - shift)) << _ONE)
        return out & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        word = _word_of(self.ones, self.one_at, i)
        at = 64 * word + _nth(self.high[word], i - self.ones[word]).astype(np.int64)
        return ((at - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places ``i`` and ``i + 1``; the second is mostly in the same word."""
        word = _word_of(self.ones, self.one_at, i)
        held = self.high[word]
        off = _nth(held, i - self.ones[word])
        at = 64 * word + off.astype(np.int64)
        near, step = _after(held, off)
        bits, one = np.uint64(self.bits), (at + step - i - 1).astype(np.uint64)
        following = (one << bits) | self._low(i + 1)
        if not near.all():
            following[~near] = self.get(i[~near] + 1)
        return ((at - i).astype(np.uint64) << bits) | self._low(i), following

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, end) of the places whose values have this high part; the end is mostly in the same word."""
        before = np.maximum(high - 1, 0)
        word = _word_of(self.zeros, self.zero_at, before)
        gaps = ~self.high[word]
        off = _nth(gaps, before - self.zeros[word])
        at = 64 * word + off.astype(np.int64)
        near, step = _after(gaps, off)
        lo, hi = at - before, at + step - high
        far = ~near & (high > 0)
        if far.any():
            hi[far] = self._upto(high[far])
        none = high == 0
        hi[none], lo[none] = lo[none], 0
        return lo, hi

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most ``high``."""
        word = _word_of(self.zeros, self.zero_at, high)
        return 64 * word + _nth(~self.high[word], high - self.zeros[word]).astype(np.int64) - high

    def successor(self, x: np.ndarray, first: np.ndarray | int = 0, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x inside [first, end), whether it equals x), by the bucket of x's high part
        and a binary search over its low bits."""
        # beyond the universe there are only empty buckets
        high = np.minimum((x >> np.uint64(self.bits)).astype(np.int64), int(self.zeros[-1]) - 1)
        want = x & np.uint64((1 << self.bits) - 1)
        lo, hi = self._bucket(high)
        lo = np.maximum(lo, first)
        hi = np.maximum(lo, hi if end is None else np.minimum(hi, end))
        stop = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        same = lo < stop
        same[same] = self._low(lo[same]) == want[same]
        return lo, same


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays into one file of the shared folder; a repeated task replaces the file as a whole."""
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, list(a.shape), at)
        body.append(a.tobytes())
        body.append(b"\0" * (-len(body[-1]) % 8))
        at += len(body[-1]) + len(body[-2])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    system, target = pafs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(target), recursive=True)
    part = f"{target}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.array([len(text)], "<u8").tobytes() + text)
        for piece in body:
            out.write(piece)
    system.move(part, target)


_maps: dict[str, dict[str, np.ndarray]] = {}


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; once for each process. A file of a store that is no file system is
    read into memory of the process's own."""
    if path not in _maps:
        system, target = pafs.FileSystem.from_uri(path)
        if isinstance(system, pafs.LocalFileSystem):
            with open(target, "rb") as file:
                held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with system.open_input_stream(target) as source:
                held = source.read()
        size = int(np.frombuffer(held, "<u8", 1)[0])
        head = json.loads(held[8 : 8 + size])
        _maps[path] = {
            name: np.frombuffer(held, dtype, int(np.prod(shape)), 8 + size + at).reshape(shape) for name, (dtype, shape, at) in head.items()
        }
    return _maps[path]


def save_sections(path: str, keys: list[int], sections: list[bytes]) -> None:
    """A file of byte strings by ascending keys, of which one is read at a time."""
    starts = np.cumsum([0, *map(len, sections)])
    save(path, {"keys": np.array(keys, np.int64), "starts": starts, "data": np.frombuffer(b"".join(sections), np.uint8)})


def section(path: str, key: int) -> bytes | None:
    """The byte string of a key; None if the file or the key is missing. Reads no more than the index and the section."""
    system, target = pafs.FileSystem.from_uri(path)
    try:
        source = system.open_input_file(target)
    except FileNotFoundError:
        return None
    with source:
        size = int.from_bytes(source.read_at(8, 0), "little")
        head = json.loads(source.read_at(size, 8))
        (_, (n,), keys_at), (_, _, starts_at), (_, _, at) = (head[k] for k in ("keys", "starts", "data"))
        keys, starts = (np.frombuffer(source.read_at(8 * m, 8 + size + a), "<i8") for m, a in ((n, keys_at), (n + 1, starts_at)))
        i = int(np.searchsorted(keys, key))
        if i == n or keys[i] != key:
            return None
        return source.read_at(int(starts[i + 1] - starts[i]), 8 + size + at + int(starts[i]))


def prefixed(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def part_of(arrays: dict[str, np.ndarray], prefix: str) -> Sequence:
    return Sequence({k.removeprefix(f"{prefix}."): v for k, v in arrays.items() if k.startswith(f"{prefix}.")})
