"""Components against brute-force Jaccard of five-word shingles, the pipeline's stage, long groups, hard rows."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from redactflow.llm import near_copies as nc
from redactflow.llm import simhash
from redactflow.llm.graph import components

FOLDER = "/root/testdata/sf0.01"


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    distinct = sorted(set(sets), key=len)
    root = {s: s for s in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 4 * len(b) > 5 * len(a):
                break
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return [least.get(find(s)) for s in sets]


def test_stage_keeps_one_of_each(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()}
    assert got == set(plain_components(rows))


def test_edited_copies(spark):
    """Texts with 1 to 5 % of their words changed: at 0.8 or more linked, below it not."""
    rng = random.Random(3)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((10 * base, " ".join(words)))
        for j in range(1, 6):
            new = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * j // 100)):
                new[at] = "changed"
            rows.append((10 * base + j, " ".join(new)))
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip([i for i, _ in rows], plain_components(rows), strict=True))
    assert got == want and 60 < len(set(want.values())) < len(rows)


def test_hard_rows(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (7, "One"), (7, "one"), (None, "one"), (9, "w " * 200_000), (8, "w " * 100), (6, "a b c d"), (5, "a b c"), (None, "alone here we are all day")]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in nc.near_copies(data).collect()), key=str)
    assert got == sorted(zip([i for i, _ in rows], plain_components(rows), strict=True), key=str)
    assert nc.near_copies(data.limit(0)).count() == 0


def test_bands_propose_what_is_alike():
    """Of 3,000 pairs at Jaccard 0.8 none is without a common band."""
    rng = np.random.default_rng(1)
    both, each = 160, 20
    for _ in range(3000):
        keys = np.unique(rng.integers(0, 1 << 64, both + 2 * each, np.uint64))
        a, b = np.delete(keys, np.arange(each)), np.delete(keys, np.arange(each, 2 * each))
        _, bands = nc.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (bands[0] == bands[1]).any()


def test_sets():
    texts = ["a b c d e f", "", None, "a b", "A b", "x x x x x x x", "e f a b c"]
    keys, bounds = nc.shingles(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(plain_set(t)) for t in texts]
    assert keys[bounds[3]] == keys[bounds[4]]


def test_fingerprints_propose(spark, monkeypatch):
    """Without the bands, the inverted lists over byte positions still connect what is alike and within their reach."""
    monkeypatch.setattr(nc, "rest", lambda lists, sets, links: links)
    rng = random.Random(4)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows.append((2 * base, " ".join(words)))
        words[rng.randrange(400)] = "changed"
        rows.append((2 * base + 1, " ".join(words)))
    prints = simhash.majority(*nc.shingles(pa.array([t for _, t in rows])))
    near = np.bitwise_count(prints[::2] ^ prints[1::2]) <= 4
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(40)] == near.tolist() and near.any()


def test_only_what_is_alike_is_linked(spark):
    sets = spark.createDataFrame([(1, list(range(9))), (2, list(range(1, 10))), (3, list(range(2, 11))), (4, [])], "key long, set array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "a long, b long")
    assert {(r["a"], r["b"]) for r in nc.verified(pairs, sets).collect()} == {(1, 2), (2, 3)}


def test_a_chain_in_one_list(spark, monkeypatch):
    """Sets of which only neighbours are alike, in one list and many blocks: two chains, as one set is left out."""
    monkeypatch.setattr(nc, "ROOM", 3)
    nodes = [i for i in range(31) if i != 15]
    sets = spark.createDataFrame([(i, list(range(10 * i, 10 * i + 100))) for i in nodes], "key long, set array<long>")
    lists = spark.createDataFrame([(7, i) for i in nodes], "band long, key long")
    links = nc.rest(lists, sets, spark.createDataFrame([], "a long, b long"))
    assert {r["node"]: r["label"] for r in components(links).collect()} == {i: 0 if i < 15 else 16 for i in nodes}
