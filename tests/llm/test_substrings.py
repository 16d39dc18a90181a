"""Removed words against a plain search, with many blocks, groups of every kind, ties and hard texts."""

import random
import re

import numpy as np
import pytest

from redactflow.llm import substrings as sub

W = sub.WIDTH


def plain(rows):
    """rows: (doc_id, text) in table order; ids may repeat."""
    docs = [(i if i is not None else sub._FIRST_ID, n, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for n, (i, t) in enumerate(rows)]
    first, out = {}, {}
    for i, n, words in sorted(docs, key=lambda d: (d[0], d[1])):
        gone = set()
        for k in range(len(words) - W + 1):
            if first.setdefault(tuple(words[k : k + W]), (n, k)) != (n, k):
                gone.update(range(k, k + W))
        out[n] = (rows[n][0], len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return sorted(out.values(), key=str)


def made(seed, n=120):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [2_000_000, 5])
@pytest.mark.parametrize("room", [1, 3000, 16 << 20])
def test_against_plain_search(spark, folder, room, limit):
    rows = made(room) + [(1000, None), (1001, ""), (1002, "one"), (1003, "tick tock " * 500), (1004, "same " * 25), (1005, "same " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{folder}/d")
    back = spark.read.parquet(f"{folder}/d")
    got = sub.drop_repeats(back, room=room, limit=limit).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_repeated_rows_and_null_ids(spark, folder):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text + " tail")]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string")
    data.coalesce(1).write.parquet(f"{folder}/d")
    got = sub.drop_repeats(spark.read.parquet(f"{folder}/d")).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_empty_and_long(spark, folder):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sub.drop_repeats(none).count() == 0
    rows = [(1, "x" * 3_000_000), (2, " ".join(str(i % 1000) for i in range(400_000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/d")
    got = {r["doc_id"]: r for r in sub.drop_repeats(spark.read.parquet(f"{folder}/d")).collect()}
    assert got[1]["n_removed"] == 0
    assert got[2]["kept"] == " ".join(str(i) for i in range(1000)) and got[2]["n_removed"] == 399_000


def test_groups_cover_all_suffixes():
    counts = np.random.default_rng(1).integers(0, 50, sub._FAN**2)
    counts[7] = 100_000
    base, many = sub.plan_groups(counts, 100)
    fits = -(-counts.sum() // 100)
    load = {}
    for n, b, m in zip(counts.tolist(), base.tolist(), many.tolist(), strict=True):
        load[b] = load.get(b, 0) + n / m
    assert max(load.values()) <= fits and len(load) > 60
    assert len({b + j for b, m in zip(base.tolist(), many.tolist(), strict=True) for j in range(m)}) == max(base + many)


def test_common_depth():
    paths = np.array([[1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 2, 9, 4, 5], [2, 2, 9, 4, 5]], np.uint32)
    assert sub.common_depth(paths).tolist() == [0, 5, 2, 0]
