"""Targets, flows and what the mix takes."""

import itertools

import pytest
from pyspark.sql import functions as F

from redactflow.llm import mixing as mx


def shared_again(sizes, weights, passes=3):
    """The same targets by sharing the excess round after round."""
    stopped, goal = set(), [0.0] * len(sizes)
    while True:
        left = sum(sizes) - sum(passes * sizes[i] for i in stopped)
        free = [i for i in range(len(sizes)) if i not in stopped]
        for i in range(len(sizes)):
            goal[i] = passes * sizes[i] if i in stopped else left * weights[i] / sum(weights[j] for j in free)
        above = {i for i in free if goal[i] > passes * sizes[i]}
        if not above:
            return goal
        stopped |= above


@pytest.mark.parametrize("sizes", [[10, 10, 10], [100, 1, 1, 1], [1, 1000, 0, 5, 7], [0, 0], [5], [1, 2, 3, 4, 5, 6, 700]])
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert mx.targets(sizes, weights) == pytest.approx(shared_again(sizes, weights))


def cheapest(supply, quota, member):
    """Least repetition cost of a maximal flow, by trying all flows of a small graph."""
    options = []
    for s, m in zip(supply, member, strict=True):
        options.append([c for c in itertools.product(range(3 * s + 1), repeat=len(m)) if sum(c) <= 3 * s])
    best = None
    for pick in itertools.product(*options):
        into = [0] * len(quota)
        for c, m in zip(pick, member, strict=True):
            for n, s in zip(c, m, strict=True):
                into[s] += n
        if any(a > b for a, b in zip(into, quota, strict=True)):
            continue
        cost = sum(max(0, sum(c) - s) + max(0, sum(c) - 2 * s) for c, s in zip(pick, supply, strict=True))
        key = (-sum(into), cost)
        best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize(
    ("supply", "quota", "member"),
    [([2, 2], [3, 3], [[0], [0, 1]]), ([1, 2, 1], [4, 2], [[0], [0, 1], [1]]), ([2], [9], [[0]]), ([1, 1], [0, 5], [[0, 1], [1]]), ([2, 1], [2, 1], [[0, 1], [0]])],
)
def test_flow_is_maximal_and_cheapest(supply, quota, member):
    flow = mx.route(supply, quota, member)
    sent = [sum(f.values()) for f in flow]
    cost = sum(max(0, n - s) + max(0, n - 2 * s) for n, s in zip(sent, supply, strict=True))
    assert (-sum(sent), cost) == cheapest(supply, quota, member)


def mixed_rows(spark, rows, **more):
    data = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, taken string")
    return mx.mix(data, **more).collect()


def test_what_the_mix_takes(spark):
    rows = [(i, "w " * (i % 50), "abcdef"[i % 6] if i % 7 else None) for i in range(600)]
    rows += [(5, "w w w", "a"), (5, "w w w", "a"), (None, "x y", "b"), (1000, None, "null"), (1001, "", "null"), (1002, "v " * 100_000, "c")]
    got = mixed_rows(spark, rows)
    assert len(got) == len(rows)
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        own = per.setdefault(r["flow_pattern"], [0, 0, r["source_size"], r["target"]])
        own[0] += r["taken"]
        own[1] += r["size"]
    assert len(per) == 8
    for taken, size, source_size, target in per.values():
        assert size == source_size and taken == int(target)
    again = sorted(map(str, mixed_rows(spark, rows)))
    assert again == sorted(map(str, got))


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(40)]
    both = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))
    got = mixed_rows(spark, rows, sources=both)
    assert {r["flow_pattern"] for r in got} == {'["=a"]', '["=b"]', '["=a","=b"]'}
    assert sum(r["taken"] for r in got) > 0


def test_kept_rows(spark):
    rows = [(1, "a b c", "x", 5), (1, "a b c", "x", 5), (2, None, "y", 6), (3, "d", None, 7)]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mx.mixed(data).collect()
    assert [r["doc_id"] for r in out].count(1) == 1 and 2 not in [r["doc_id"] for r in out]
    assert mx.mixed(data.limit(0)).count() == 0 and mx.mix(data.limit(0)).count() == 0
