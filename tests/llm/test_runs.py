"""Runs of words against a search of every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactflow.llm import runs
from redactflow.llm.queries import QUERIES


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def made(rng):
    words = []
    for _ in range(rng.randint(0, 4)):
        block = [f"w{rng.randint(0, rng.choice([1, 2, 5, 50]))}" for _ in range(rng.randint(1, 12))]
        words += (block * rng.randint(1, 9))[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_against_every_period(seed):
    rng = random.Random(seed)
    for _ in range(200):
        docs = [made(rng) for _ in range(rng.randint(1, 4))]
        keys = np.array([zlib.crc32(w.encode()) for d in docs for w in d], np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = list(zip(*(x.tolist() for x in runs.runs_of(keys, bounds)), strict=True))
        assert got == [(a + int(b), n, q) for d, b in zip(docs, bounds, strict=False) for a, n, q in plain_runs(d)]


HARD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "a a a a a a"),  # the shortest run
    (6, "a a a a a"),
    (7, "x y x y x y x y"),
    (8, "x y x y x y x"),  # seven words are under four periods
    (9, "a\tb  a\nb a b a b c c c c c c"),
    (10, "é é é é é é ü"),
    (10, "é é é é é é ü"),  # repeated row
    (None, "z z z z z z z"),
    (11, "p q r " * 30 + "p q"),
    (12, "a a a a a a b b b b b b"),  # equal lengths: the first counts
]


@pytest.mark.parametrize("room", [1 << 20, 1])
def test_rows(spark, room):
    frame = spark.createDataFrame([(*r, 7, "clash") for r in HARD], "doc_id int, text string, `a.b` int, Runs string")
    got = runs.find_runs(frame, room=room)
    assert got.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    for r in got.collect():
        words = (r["text"] or "").split()
        found = plain_runs(words)
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(words), found)
        assert r["collapsed"] == plain_collapsed(words, found) and r["a.b"] == 7


def test_longest_and_listed(spark):
    frame = spark.createDataFrame(HARD, "doc_id int, text string")
    got = {r[0]: (r[1], r[2]) for r in runs.find_runs(frame).select("doc_id", runs.longest(F.col("runs")), runs.listed(F.col("runs"))).collect()}
    assert tuple(got[12][0]) == (0, 6, 1) and got[12][1] == "0,6,1\n6,6,1\n"
    assert tuple(got[2][0]) == (None, None, None) and got[2][1] == ""


def test_empty_table_and_long_text(spark):
    assert runs.find_runs(spark.createDataFrame([], "text string")).count() == 0
    words = [str(i % 3000) for i in range(200_000)]
    row = runs.find_runs(spark.createDataFrame([(" ".join(words),)], "text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 200_000, 3000)] and row["collapsed"] == " ".join(words[:3000])


def test_tails(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(400)] + [(None, "a b c"), (1000, None)]
    got = runs.with_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(sorted(rows, key=str), sorted(map(tuple, got), key=str), strict=True):
        w, h = (text or "").split(), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(w[:a] + [w[a + k % p] for k in range(len(w) - a)])
        assert r == (i, text)


def test_query_finds_planted_tails(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in runs.with_tails(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    some = 0
    for r in QUERIES["op12_runs"](spark, folder).collect():
        words = texts[r["doc_id"]].split() if len(texts[r["doc_id"]]) < 5000 else None
        if words is None:
            continue
        found = plain_runs(words)
        some += len(found)
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
    assert some > 5
