"""The word kernel against plain splitting."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from redactflow.llm import words as w
from redactflow.llm.packing import packed, plain, unpacked, wide

SPLIT = {"blanks": (w.BLANKS, rb"[^\x20\x09-\x0D]+"), "symbols": (w.SYMBOLS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def texts(seed):
    rng = random.Random(seed)
    letters = "ab AZ09\t\n\x0b\x0c\r\x00\x1c-_.@[`{~é😀  "
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    return [*out, None, "", " ", "x" * 5000, "é" * 3000]


@pytest.mark.parametrize("kind", SPLIT)
@pytest.mark.parametrize("seed", range(3))
def test_words(kind, seed):
    separators, pattern = SPLIT[kind]
    column = texts(seed)
    got = w.words_of(pa.array(column), lower=True, separators=separators)
    seen = {}
    for i, text in enumerate(column):
        want = re.findall(pattern, (text or "").encode().lower())
        a, b = got.bounds[i], got.bounds[i + 1]
        assert [bytes(got.data[s:e]) for s, e in zip(got.starts[a:b], got.ends[a:b], strict=True)] == want
        for word, key in zip(want, got.keys[a:b].tolist(), strict=True):
            assert seen.setdefault(word, key) == key
    assert len(set(seen.values())) == len(seen)


def test_a_slice_and_a_long_text_give_the_same_keys():
    column = pa.array(["skip", "one two", None, "two " * 1_000_000])
    got = w.words_of(column.slice(1))
    assert got.counts().tolist() == [2, 0, 1_000_000]
    assert len(set(got.keys[1:].tolist())) == 1 and got.keys[0] != got.keys[1]


@pytest.mark.parametrize("width", [1, 2, 5])
def test_windows_stay_inside_a_text(width):
    column = ["a b c d e f", "", None, "a b", "c", "a b c d e"]
    words = w.words_of(pa.array(column))
    at, keys = w.window_keys(words.keys, words.bounds, width)
    want, seen = [], {}
    for i, text in enumerate(column):
        own = (text or "").split()
        for k in range(len(own) - width + 1):
            want.append(words.bounds[i] + k)
            seen.setdefault(tuple(own[k : k + width]), set()).add(int(keys[len(want) - 1]))
    assert at.tolist() == want
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_chunks_hold_every_row_once():
    column = ["x" * n for n in (0, 5, 500, 3, 0, 1200, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(column + [None])], ["text"])
    parts = list(w.chunks(batch, "text", 400))
    assert [t for p in parts for t in p.column("text").to_pylist()] == [*column, None] and len(parts) > 2
    assert list(w.chunks(batch.slice(0, 0), "text", 400)) == []


def test_packing():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    for data in (values, values[:1], values[:0], np.zeros(5, np.uint64)):
        assert (unpacked(*packed(data)) == data).all() and (wide(*plain(data)) == data).all()
