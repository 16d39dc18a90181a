"""Tokens against the tokenizer on whole texts, packing against Best-two-fit one sequence at a time."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from redactflow.llm import bestfit as bf
from redactflow.llm.queries import QUERIES

PATH = bf.tokenizer_path(bf.TOKENIZER)
LETTERS = [
    *"aBzéÉà÷,.!?KΣσßİﬁ1٣-_", "'s", "'T", "...", " ", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "́", "😀",
    "<|endoftext|>", "<|StartOfText|>", "‍", "日本", "　",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(4))
def test_tokens(plain, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(bf, "KEPT_WORDS", 50)  # forgets all the time
    rng, encoder = random.Random(seed), bf.Encoder(PATH)
    for round_ in range(60):
        column = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 40))] + [None, ""]
        if round_ % 3:
            column = [c and c.replace("<|", "") for c in column]
        ids, bounds = encoder.encode(pa.array(column, pa.string()))
        for i, text in enumerate(column):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    left, out = sorted(lengths, reverse=True), []
    while left:
        own, gap, i = [], capacity, 0
        while i < len(left):
            if left[i] <= gap:
                gap -= left[i]
                own.append(left.pop(i))
            else:
                i += 1
        if gap and len(own) > 1:
            pairs = [(left[x] + left[y], left[x], x, y) for x in range(len(left)) for y in range(x + 1, len(left)) if own[-1] < left[x] + left[y] <= gap + own[-1]]
            if pairs:
                total, longest = max(p[:2] for p in pairs)
                x, y = next(p[2:] for p in pairs if p[:2] == (total, longest))
                small = own.pop()
                own += [left[x], left[y]]
                left = sorted([*left[:x], *left[x + 1 : y], *left[y + 1 :], small], reverse=True)
        out.append(tuple(sorted(own, reverse=True)))
    return out


@pytest.mark.parametrize("capacity", [1, 5, 17, 100])
def test_fillings_are_those_of_one_by_one(capacity):
    rng = random.Random(capacity)
    exchanged = 0
    for _ in range(300):
        lengths = [rng.choice([1, capacity // 2 or 1, capacity // 3 or 1, rng.randint(1, capacity)]) for _ in range(rng.randint(0, 60))]
        got = []
        for use, times in bf.fillings(np.bincount(np.array(lengths, int), minlength=capacity + 1)):
            got += [tuple(n for n, k in use.items() for _ in range(k))] * times
        assert got == one_by_one(lengths, capacity)
        exchanged += sum(sum(g) for g in got) > 0
    assert exchanged


def test_plan_is_small_and_nearly_without_gaps():
    lengths = np.minimum(4096, np.random.default_rng(1).lognormal(6, 1, 3_000_000) + 1).astype(int)
    rows = bf.plan(np.bincount(lengths, minlength=4097))
    sequences = (rows[:, 2].max() + 1, -(-lengths.sum() // 4096))
    assert len(rows) < 20_000 and sequences[0] <= 1.001 * sequences[1]


def check(plain, rows, docs, capacity=4096):
    """``rows``: packed pieces; ``docs``: (doc_id, text) with ids that occur once."""
    want = {}
    for i, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want[i, k // capacity] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    inside = collections.defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in inside.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= capacity
    return len(inside)


@pytest.mark.parametrize("capacity", [7, 64])
def test_pack(spark, plain, capacity):
    rng = random.Random(capacity)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma.", "Étude,"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "  \n"), (None, "no id"), (1003, "long word " * 500)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, length int, `sequence_id` string").repartition(5)
    packed = bf.pack(frame, capacity=capacity)
    rows = packed.collect()
    lengths = [r["length"] for r in rows]
    assert check(plain, rows, docs, capacity) == len(one_by_one(lengths, capacity))
    whole = {r["sequence_id"]: r["ids"] for r in bf.sequences(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] and len(r["ids"]) == r["length"]


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "same text")] * 50 + [(2, "same text")] * 3, "doc_id long, text string")
    rows = bf.pack(frame, with_ids=False).collect()
    assert len(rows) == 53 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 53
    assert bf.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_documents(spark, plain):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op11_bestfit"](spark, folder).collect()
    used = check(plain, rows, docs)
    assert used == len(one_by_one([r["length"] for r in rows], 4096)) <= -(-sum(r["length"] for r in rows) // 4096) + 1
