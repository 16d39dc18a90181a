"""Near copies by exact Jaccard similarity of five-word shingles; SimHash and, for the rest, MinHash propose whom to compare.

A text is the set of its runs of ``SHINGLE`` words (all its words, if it has fewer), lower-cased, as 64-bit keys. Two
texts are linked if the sets' Jaccard similarity is ``LIKE`` = 4/5 or more, computed on the whole sets. Texts with equal
sets are one node. Links are looked for in three steps, and only what passes the exact check connects:

1. The sets' fingerprints go through the inverted lists over byte positions of ``simhash``, with its count filter and
   its distance of 4 bits; what they connect is compared edge by edge.
2. Two texts at 0.8 differ in some 10 of 64 bits, and for a radius that wide byte positions no longer select. For the
   links beyond 4 bits there are ``BANDS`` bands of ``ROWS`` minima each: a pair at 0.8 shares no band with a probability
   of (1 - 0.8**5)**40 = 1.3e-7, one at 0.9 with 2e-16. A list of one band whose nodes are all connected already is
   dropped; in any other, one node is compared with all that it is not connected with, pair by pair.
3. Lists that still hold unconnected nodes, apart from the one compared, are joined in stars. Their components hold every
   pair left, and are linked in blocks of about ``ROOM`` nodes, each pair of blocks in a task of its own.

Null and empty texts have the empty set and are copies of one another. A document without an id takes part, but no
component is named after it; repeated rows share their component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.llm import simhash
from redactflow.llm.graph import components
from redactflow.llm.table import col
from redactflow.llm.words import chunks, mix, window_keys, words_of
from redactflow.session import cut_lineage

SHINGLE = 5
#: Similarity from which on texts are linked, as a fraction, so that it is compared in whole numbers.
LIKE = (4, 5)
BANDS, ROWS = 40, 5
SEED = 7
ROOM = 512
_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds): the set of text ``i`` is ``keys[bounds[i]:bounds[i + 1]]``, in order."""
    words = words_of(column, lower=True)
    counts = words.counts()
    at, keys = window_keys(words.keys, words.bounds, SHINGLE)
    found = [(np.searchsorted(words.bounds, at, side="right") - 1, keys)]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        at, keys = window_keys(words.keys, words.bounds, n, n)
        place = np.searchsorted(at, words.bounds[short])
        found.append((short, keys[place]))
    owner, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    owner, keys = owner[first], keys[first]
    return keys, np.searchsorted(owner, np.arange(len(column) + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each set, [text, band] values)."""
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    key, bands = np.zeros(len(sizes), np.uint64), np.zeros((len(sizes), BANDS), np.uint64)
    if len(some):
        at = bounds[some]
        key[some] = mix(np.add.reduceat(mix(keys ^ _FLIP[0]), at) + sizes[some].astype(np.uint64))
        for band in range(BANDS):
            value = np.full(len(some), band, np.uint64)
            for i in range(band * ROWS, (band + 1) * ROWS):
                value = mix(value + np.minimum.reduceat((keys ^ _FLIP[i]) * _TIMES[i], at))
            bands[some, band] = value
    return key, bands


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            keys, bounds = shingles(part.column("text"))
            key, bands = signatures(keys, bounds)
            ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
            lists = pa.ListArray.from_arrays(ends, pa.array(bands.ravel().view(np.int64)))
            fp = simhash.majority(keys, bounds)
            arrays = [part.column("doc_id"), part.column("text_key"), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "key", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            keys, bounds = shingles(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "set"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sets, those that are linked."""
    for batch in batches:
        hit = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            hit[i] = LIKE[1] * both >= LIKE[0] * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(hit))


def linked(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set, the number of the first one it is connected with. Sets are compared through the places of their
    keys; what is linked already is not compared again."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    distinct, ids = np.unique(keys, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    pointer = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(distinct)))])
    label, left = np.full(n, -1, np.int64), np.ones(n, bool)
    for first in range(n):
        if not left[first]:
            continue
        left[first], label[first], todo = False, first, [first]
        while todo and left.any():
            one = todo.pop()
            own = ids[bounds[one] : bounds[one + 1]]
            size = pointer[own + 1] - pointer[own]
            at = np.repeat(pointer[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = np.bincount(owner[at], minlength=n)
            hit = np.flatnonzero(left & (LIKE[1] * both >= LIKE[0] * (sizes[one] + sizes - both)))
            left[hit], label[hit] = False, first
            todo.extend(hit.tolist())
    return label


def _link(rows: pa.Table) -> pa.Table:
    sets = rows.column("set").combine_chunks()
    at = sets.offsets.to_numpy().astype(np.int64)
    keys = sets.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
    node = rows.column("key").to_numpy()
    label = node[linked(keys, at - at[0])]
    return pa.table([pa.array(node), pa.array(label)], ["a", "b"]).filter(pa.array(node != label))


def by_fingerprint(distinct: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b) that connect what fingerprints ``fp`` within reach connect."""
    heads = cut_lineage(distinct.groupBy("fp").agg(F.min("key").alias("head")), "prints")
    same = distinct.join(heads, "fp").filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    edges = simhash.links(heads.select("fp")).distinct()
    edges = edges.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
    edges = edges.join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return cut_lineage(same.unionByName(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))), "near")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    first = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a")
    rows = first.join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return cut_lineage(rows.mapInArrow(_alike, "a bigint, b bigint"), "alike")


def _mixed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(band, key, label) of the lists with nodes that ``links`` do not connect."""
    labels = components(links).select(F.col("node").alias("key"), "label")
    named = cut_lineage(lists.join(labels, "key", "left").select("band", "key", F.coalesce("label", "key").alias("label")), "named")
    mixed = named.groupBy("band").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b")
    return named.join(mixed.select("band"), "band")


def rest(lists: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` (a, b) and those that connect all nodes alike that share a list (band, key)."""
    mixed = cut_lineage(_mixed(lists, links), "mixed")
    # heads differ from list to list, so that a node meets many of a large group
    order = F.xxhash64("band", "key")
    heads = mixed.groupBy("band").agg(F.min_by(F.struct("key", "label"), order).alias("head"))
    with_head = cut_lineage(mixed.join(heads, "band").select("band", "key", "label", "head"), "heads")
    asked = with_head.filter("label <> head.label").select(F.col("head.key").alias("a"), F.col("key").alias("b"))
    links = links.unionByName(verified(asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets))
    left = cut_lineage(_mixed(with_head.filter("key <> head.key").select("band", "key"), links), "left")
    if left.isEmpty():
        return links
    stars = left.join(left.groupBy("band").agg(F.min("key").alias("head")), "band").filter("key <> head")
    groups = components(stars.select(F.col("key").alias("a"), F.col("head").alias("b")).distinct())
    counts = groups.groupBy("label").agg(F.ceil(F.count("*") / ROOM).cast("int").alias("n"))
    blocks = groups.join(counts, "label").withColumn("own", F.pmod(F.xxhash64("node"), "n"))
    dealt = blocks.select("label", F.col("node").alias("key"), "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("label", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = dealt.join(sets, "key").groupBy("label", "i", "j").applyInArrow(_link, "a bigint, b bigint")
    return links.unionByName(cut_lineage(found, "linked"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row: component_id is the smallest doc_id reachable over links."""
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    prints = cut_lineage(rows.mapInArrow(_prints, "doc_id bigint, text_key bigint, key bigint, fp bigint, bands array<bigint>"), "sets")
    one = prints.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("text_key").alias("text_key"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    distinct = cut_lineage(one, "distinct")
    near = by_fingerprint(distinct.select("key", "fp"))
    posted = distinct.select("key", F.explode("bands").alias("band"))
    shared = posted.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    lists = cut_lineage(posted.join(shared, "band"), "lists")
    wanted = lists.select("key").unionByName(near.select(F.col("a").alias("key"))).unionByName(near.select(F.col("b").alias("key")))
    wanted = cut_lineage(distinct.select("key", "text_key").join(wanted.distinct(), "key"), "wanted")
    texts = rows.select("text_key", "text").join(wanted, "text_key").dropDuplicates(["key"]).select("key", "text")
    sets = cut_lineage(texts.mapInArrow(_sets, "key bigint, set array<bigint>"), "sets")
    classes = components(rest(lists, sets, verified(near, sets)))
    labelled = distinct.select("key", "first").join(classes.select(F.col("node").alias("key"), "label"), "key", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "key"))
    named = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_set = cut_lineage(labelled.join(named, "label").select("key", "component_id"), "classes")
    return prints.select("doc_id", "key").join(of_set, "key").select("doc_id", "component_id")
