"""Elias-Fano sequences, and scores against the same model in plain dictionaries."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redactflow.llm import elias_fano as ef
from redactflow.llm import ngrams as ng
from redactflow.llm.queries import QUERIES
from redactflow.llm.words import words_of
from redactflow.session import scratch_path


@pytest.mark.parametrize(("universe", "n"), [(1 << 64, 5000), (1000, 0), (10, 8), (1 << 40, 3000), (300, 4000), (1, 1)])
def test_sequences(universe, n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
    held = ef.Sequence(ef.Sequence.build(values, universe))
    assert (held.get(np.arange(n)) == values).all()
    a, b = held.ranges(np.arange(max(0, n - 1)))
    assert (a == values[:-1]).all() and (b == values[1:]).all()
    values = np.unique(values)
    held = ef.Sequence(ef.Sequence.build(values, universe))
    asked = np.concatenate([values, rng.integers(0, min(2 * universe, (1 << 64) - 1), 2000, dtype=np.uint64, endpoint=True)])
    at, same = held.successor(asked)
    assert (same == np.isin(asked, values)).all()
    assert (at[same] == np.searchsorted(values, asked[same])).all()


def tokens(text):
    low = (text or "").encode().lower()
    return [*low.split(), None]


def plain(train, texts):
    counts = [Counter() for _ in range(ng.ORDER)]
    for t in train:
        w = tokens(t)
        for k in range(ng.ORDER):
            counts[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    n, v = sum(counts[0].values()), len(counts[0])
    kept = [counts[0]] + [{g: c for g, c in level.items() if c >= ng.MIN_COUNT} for level in counts[1:]]
    value = lambda p: ng._VALUE[ng.quantise(np.array([p]))[0]]
    direct, left = {}, {}
    for k in range(1, ng.ORDER):
        for g, c in kept[k].items():
            direct[g] = value((c - ng.DISCOUNT) / counts[k - 1][g[:-1]])
            left[g[:-1]] = left.get(g[:-1], 1.0) - direct[g]
    out = []
    for t in texts:
        w, base, full = tokens(t), 0.0, 0.0
        for i, word in enumerate(w):
            p = (counts[0][(word,)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, min(i, ng.ORDER - 1) + 1):
                h = tuple(w[i - k : i])
                if k > 1 and h not in kept[k - 1]:
                    break
                p = direct.get((*h, word), 0.0) + (value(left[h]) if h in left else 1.0) * p
            full += math.log10(p)
        out.append((len(w), sum((x,) in counts[0] for x in w), n, base, full))
    return out


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {i: crc32(str(i).encode()) % 7 == 2 for i in rows}
    want = dict(zip(rows, plain([t for i, t in rows.items() if not held[i]], rows.values()), strict=True))
    got = QUERIES["op1_ngram_scores"](spark, folder).collect()
    assert len(got) == len(rows)
    better = []
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], *w[:3])
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9) and r["score"] == pytest.approx(w[4], rel=1e-6)
        if r["held_out"]:
            better.append(r["score"] - r["base_score"])
    assert sum(better) > 0


def test_many_parts(spark):
    """Small parts: contexts are cut by their last word, and nothing changes."""
    texts = ["the a b the c d the a", "the a the a the b the b", "x y the a", None, "", "the a b the c d the e f g", "the a"] * 3
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(4)
    model = ng.learn(docs, room=3)
    assert any(len(level.split) for level in model.levels)
    asked = [*texts, "the q a b", "q", "b the c d the a"]
    ask = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = sorted(map(tuple, ng.score(ask, model).drop("text").collect()))
    for r, w in zip(got, plain(texts, asked), strict=True):
        assert r[1:4] == w[:3]
        assert r[4] == pytest.approx(w[3]) and r[5] == pytest.approx(w[4])


def sums(frame):
    return [tuple(r) for r in frame.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").orderBy("doc_id").collect()]


def test_told_blocks_and_the_parts_agree(spark):
    """What parts tell of a block, what they hold, and both ways to ask give the same scores; a block that was not asked
    for is looked up in the parts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train = F.col("doc_id") % 3 != 0
    together = ng.learn_and_score(docs, train, room=50_000)
    model = ng.learn(docs.filter(train), room=50_000)
    want = sums(ng.score(docs, model))
    assert np.allclose(sums(together), want, rtol=1e-9)
    # rows in another order: no block is the one that was asked for
    turned = ng._scored(docs.orderBy(F.desc("doc_id")), model, "text", scratch_path(spark, "told"))
    assert np.allclose(sums(turned), want, rtol=1e-9)


def test_what_is_told(tmp_path):
    pair = np.array([3, 9, 10, 500], np.uint64)
    found = (np.array([-1, 7, 8, -1]), np.array([0, 70_000, 2, 0]), np.array([5, 0, 1, 255], np.uint8))
    pieces = [ng._sealed(found, np.arange(4), ng._sum(pair)), ng._sealed(found, np.array([1]), ng._sum(pair[1:2]))]
    ef.save_sections(f"{tmp_path}/1-0", [4, 1 << 33], pieces)
    for got, want in zip(ng.Told(str(tmp_path), 4)(1, 0, pair), found, strict=True):
        assert got.tolist() == want.tolist()
    assert [x.tolist() for x in ng.Told(str(tmp_path), 1 << 33)(1, 0, pair[1:2])] == [[7], [70_000], [0]]
    # other pairs, another block, another part
    assert ng.Told(str(tmp_path), 4)(1, 0, pair + np.uint64(1)) is None
    assert ng.Told(str(tmp_path), 5)(1, 0, pair) is None and ng.Told(str(tmp_path), 4)(1, 1, pair) is None


def test_blocks_depend_on_rows_alone(spark, monkeypatch):
    """However Arrow batches are cut, the same texts stand in a block; a text longer than a block is whole."""
    monkeypatch.setattr(ng, "BLOCK", 20)
    monkeypatch.setattr(ng.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 2})()))
    texts = ["a" * 7, None, "b" * 15, "", "c" * 90, "d", "e" * 19, "f"] * 3
    whole = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    cut = lambda n: [whole.slice(i, n) for i in range(0, len(texts), n)]
    blocks = lambda batches: [(i, [t for r in rows for t in r.column("text").to_pylist()]) for i, rows in ng._blocks(iter(batches), "text")]
    want = blocks([whole])
    assert [t for _, b in want for t in b] == texts and len({i for i, _ in want}) == len(want) > 5
    assert all(blocks(cut(n)) == want for n in (1, 2, 3, 7))
    assert blocks([]) == [] and blocks([whole.slice(0, 0)]) == []


def test_ngrams_seen_once_are_stored(spark):
    """Every level holds all n-grams there are, and a phrase seen once scores better than its words put otherwise."""
    texts = ["red fox runs home", "blue fox sits here", "red dog sits home", None, "one"]
    model = ng.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    for k in range(1, ng.ORDER + 1):
        grams = {tuple(w[i : i + k]) for t in texts for w in [tokens(t)] for i in range(len(w) - k + 1)}
        assert model.levels[k - 1].bases[-1] == len(grams)
    asked = spark.createDataFrame([(0, "red fox runs home"), (1, "runs red home fox")], "doc_id long, text string")
    seen, other = (r["score"] for r in ng.score(asked, model).orderBy("doc_id").collect())
    assert seen > other + 1


def test_probabilities_sum_to_at_most_one(spark):
    """Over all known words, the end and one unknown word, after any context."""
    texts = ["a b c a b d", "a b c", "b c a", "c c c a b"] * 2
    model = ng.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    key = dict(zip("abcdx", words_of(pa.array(["a b c d x"]), lower=True).keys, strict=True)) | {"$": ng.END}
    for context in ("a b", "c", "b c", "d a", "x", "c c", ""):
        total = 0.0
        for word in "abcdx$":
            keys = np.array([key[w] for w in [*context.split(), word]], np.uint64)
            total += 10 ** ng._scores(model, keys)[2][-1]
        assert 0.85 < total <= 1 + 1e-9


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = ng.learn(none)
    assert ng.score(none, model).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = ng.score(one, model).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
