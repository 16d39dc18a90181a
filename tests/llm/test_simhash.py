"""Fingerprints and components against brute force, long lists, hard rows."""

import numpy as np
import pytest
import xxhash

from redactflow.llm import simhash as sh
from redactflow.llm.graph import components
from redactflow.llm.queries import QUERIES


def plain_print(text):
    w = bytes(text or "", "utf8").lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


def test_triples_cover():
    triples = sh.covering_triples()
    assert len(triples) == 20
    from itertools import combinations

    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    prints = [plain_print(t) for _, t in rows]
    want = dict(zip([i for i, _ in rows], zip([f"{p:016x}" for p in prints], plain_components([i for i, _ in rows], prints), strict=True), strict=True))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, folder).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [16, 4096])
def test_lists_longer_than_a_task_takes(spark, limit):
    """With a tiny limit every list goes through all rounds; nothing is lost."""
    rng = np.random.default_rng(5)
    prints = set()
    for base in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(60):
            flip = rng.choice(64, rng.integers(0, 7), replace=False)
            prints.add(base ^ sum(1 << int(b) for b in flip))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = sh.links(spark.createDataFrame([(p,) for p in signed], "fp long"), limit)
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    want = plain_components(list(range(len(prints))), prints)
    groups = {}
    for p, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(label.get(p, p))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_hard_rows(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (7, "one"), (7, "one"), (None, "one"), (9, "w " * 200_000), (8, "w " * 100), (None, "alone here we are all day")]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in sh.near_duplicates(data).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (2, 1), (7, 7), (7, 7), (None, 7), (9, 8), (8, 8), (None, None)], key=str)
    kept = sorted(((r["doc_id"], r["text"][:5]) for r in sh.one_of_each(data).collect()), key=str)
    assert kept == sorted([(1, ""), (7, "one"), (8, "w w w"), (None, "one"), (None, "alone")], key=str)
    assert sh.near_duplicates(data.limit(0)).count() == 0 and sh.one_of_each(data.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)] + [(300, i) for i in range(301, 340)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200} | {i: 300 for i in range(300, 340)}
