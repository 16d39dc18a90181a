"""SimHash near-duplicates through an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most ``MAX_BITS`` = 4 bits have at least ``MIN_BYTES`` = 4 of their 8
positional bytes in common. Every set of four positions contains one of 20 chosen triples, so a pair within reach
meets in the posting list of at least one triple of (position, byte). In a list, pairs are first counted: those with
fewer than ``MIN_BYTES`` equal positional bytes go, the rest are verified by their differing bits.

A list of at most ``LIST`` fingerprints is linked in one task, which returns a spanning forest of it, not its pairs.
A longer list goes to the next round: the bits not yet known to be equal are cut into five segments, one of which
must be equal in any pair within reach, and the list is dealt out by the value of each segment. Since a list holds
distinct fingerprints, this ends, and no link is lost.

Null and empty texts have fingerprint 0 and link like any other. A document without an id takes part, but no
component is named after it; repeated rows share fingerprint and component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.llm.graph import components
from redactflow.llm.table import boxed, col, unboxed
from redactflow.llm.words import chunks
from redactflow.session import cut_lineage

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
LIST = 4096
_BITS = 64


def covering_triples() -> list[tuple[int, ...]]:
    """Turan's 20 triples of byte positions: every four positions contain at least one of them.

    In three groups round a circle, a triple lies inside a group or has two in a group and one in the next.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for g in groups for t in combinations(g, 3)]
    return inside + [(x, y, z) for i in range(3) for x, y in combinations(groups[i], 2) for z in groups[(i + 1) % 3]]


def simhash(text: str | None) -> np.ndarray:
    """Hashes of the shingles of one text (none for a text without words)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(SHINGLE, len(words)) - 1
    pieces = [joined[a:b] for a, b in zip(starts[: len(starts) - k].tolist(), ends[k:].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per text: the bits set in over half of its hashes."""
    bounds = np.cumsum([0, *map(len, hashes)])
    return majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), bounds)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One fingerprint per text, text ``i`` having ``hashes[bounds[i]:bounds[i + 1]]``; zero for none."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            prints = fold([simhash(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(_print_batches, "doc_id bigint, fp bigint")


def _segments(known: int) -> list[int]:
    """Masks of five parts of the bits outside ``known``."""
    bits = [i for i in range(_BITS) if not known >> i & 1]
    return [sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(bits, dtype=object), MAX_BITS + 1) if len(part)]


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the 8 positional bytes of the XOR of two fingerprints are zero."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


def near(x: np.ndarray) -> np.ndarray:
    """Which XORs belong to a link: count filter first, then the exact distance."""
    ok = _equal_bytes(x) >= MIN_BYTES
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def forest(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is connected by links inside one list."""
    left, edges, todo = prints, [], []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        one = todo.pop()
        if len(left):
            hit = near(left ^ one)
            if hit.any():
                found = left[hit]
                edges.append((np.full(len(found), one), found))
                todo.extend(found)
                left = left[~hit]
    return edges


def _link(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """Posting lists arrive sorted; a list longer than ``room`` is handed on (``mask`` not null)."""
    fields = ["a", "b", "mask"]

    def edges_of(a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], fields
        )

    def handed_on(prints, mask):
        return pa.RecordBatch.from_arrays(
            [pa.array(prints.view(np.int64)), pa.nulls(len(prints), pa.int64()), pa.array(np.full(len(prints), mask))],
            fields,
        )

    held: list[np.ndarray] = []  # the list that the last batch ended in
    held_key, held_n, long = None, 0, False

    def close():
        if not long and held_n > 1:
            for a, b in forest(np.concatenate(held)):
                yield edges_of(a, b)

    for batch in batches:
        if not batch.num_rows:
            continue
        mask = batch.column("mask").to_numpy()
        value = batch.column("value").to_numpy()
        prints = batch.column("fp").to_numpy().view(np.uint64)
        change = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(mask)]])
        # the first list may continue the one held, and the last may go on in the next batch: both by hand
        for i in {0, len(starts) - 1} if len(starts) > 1 else {0}:
            own = prints[starts[i] : ends[i]]
            key = (mask[starts[i]], value[starts[i]])
            if key != held_key:
                yield from close()
                held, held_key, held_n, long = [], key, 0, False
            held_n += len(own)
            held.append(own)
            if long or held_n > room:
                for part in held:
                    yield handed_on(part, key[0])
                held, long = [], True
        inner = slice(1, len(starts) - 1)
        sizes = (ends - starts)[inner]
        two = starts[inner][sizes == 2]
        if len(two):
            hit = near(prints[two] ^ prints[two + 1])
            if hit.any():
                yield edges_of(prints[two][hit], prints[two + 1][hit])
        for s, n in zip(starts[inner][sizes > 2], sizes[sizes > 2], strict=True):
            own = prints[s : s + n]
            if n > room:
                yield handed_on(own, mask[s])
                continue
            for a, b in forest(own):
                yield edges_of(a, b)
    yield from close()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _posting(prints: DataFrame, masks: list[int]) -> DataFrame:
    lists = F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])
    return prints.select("fp", F.explode(lists).alias("mask"))


def links(prints: DataFrame, room: int = LIST) -> DataFrame:
    """(a, b) edges between distinct fingerprints ``fp`` that connect exactly what links connect."""
    triples = [sum(0xFF << (8 * p) for p in t) for t in covering_triples()]
    todo, found = _posting(prints, triples), None
    while True:
        lists = todo.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = lists.repartition(n, "mask", "value").sortWithinPartitions("mask", "value")
        out = cut_lineage(dealt.mapInArrow(lambda batches: _link(batches, room), "a bigint, b bigint, mask bigint"), "links")
        edges = out.filter("mask is null").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        again = out.filter("mask is not null").select(F.col("a").alias("fp"), "mask").distinct()
        masks = [r["mask"] for r in again.select("mask").distinct().collect()]  # 20 at first, five times that a round
        if not masks:
            return found
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), _finer(m))])
        todo = again.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))


def _finer(mask: int) -> Column:
    known = mask & (1 << 64) - 1
    return F.array(*[F.lit(_signed(known | part)).cast("bigint") for part in _segments(known)])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links."""
    prints = cut_lineage(fingerprints(docs, doc_id, text), "simhash")
    # distinct fingerprints stand for all their copies
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    classes = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "label")
    linked = distinct.join(classes, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = cut_lineage(linked.join(named, "label").select("fp", "component_id"), "classes")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The document that names its component, with all columns; of repeated rows of it, one. Rows without an id stay.
    ``groups`` gives (doc_id, component_id) of every row."""
    found = cut_lineage(groups(docs), "near")
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("_first"), F.count("*").alias("_n"))
    marked = boxed(docs, doc_id=F.col("doc_id").cast("bigint")).join(ids, "doc_id", "left").filter("doc_id is null or _first")
    once = marked.filter("doc_id is null or _n = 1")
    again = marked.filter("_n > 1").dropDuplicates(["doc_id"])
    return unboxed(once.unionByName(again))
