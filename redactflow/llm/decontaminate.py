"""Benchmark passages in documents: a set join filtered by rare prefixes, verified on whole windows.

A window is ``WIDTH`` consecutive words of an item; an item of fewer words, but not none, is one window. As a set of
positioned shingles (runs of up to ``SHINGLE`` words), a window occurs in a document only if all of them do, so the
necessary prefix of a window under any global order is its first shingle. The order is by rarity in the documents,
counted over all of them, so the prefix is the rarest. A document's shingle and its position fix where the window would
start; candidates whose window would not fit into the document (position and length bounds) go, the rest are compared
word by word.

Which shingles of documents are worth sending is told by a bitmap of fixed size over all item shingles; what passes by
chance is dropped in the join. Nothing else about the benchmark is held in a task, and benchmark and documents may be
of any size.

Null and empty texts have no words: no hits, not contaminated; an item without words occurs nowhere. Repeated
documents are judged each for itself; repeated items (rows with one item_id) count once. A null item_id is no item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.llm.table import boxed, col, unboxed
from redactflow.llm.words import SYMBOLS, Words, chunks, mix, window_keys, words_of
from redactflow.session import cut_lineage

WIDTH = 10
SHINGLE = 3
#: Bits of the bitmap that tells which shingles any item has: 2 MB, whatever the benchmark.
BITMAP_BITS = 1 << 24


def _slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def _shingles(words: Words, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every run of as many words as ``widths`` names."""
    each = [window_keys(words.keys, words.bounds, w, seed=w) for w in widths]
    return np.concatenate([at for at, _ in each]), np.concatenate([key for _, key in each])


def _plain(words: Words, first: int, end: int) -> str:
    """Words ``first`` to ``end`` - 1 with one blank between them."""
    raw = words.data[words.starts[first] : words.ends[end - 1]].tobytes().translate(_BLANKED)
    return b" ".join(raw.split(b" ")).decode() if b"  " not in raw else b" ".join(raw.split()).decode()


_BLANKED = bytes(0x20 if SYMBOLS[i] else i for i in range(256))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"), True, SYMBOLS)
            ids = part.column("item_id").to_pylist()
            out = {"item_id": [], "passage": [], "n": [], "keys": []}
            by_width = {}
            for width in range(1, SHINGLE + 1):
                at, key = window_keys(words.keys, words.bounds, width, seed=width)
                by_width[width] = np.zeros(len(words.keys), np.int64)
                by_width[width][at] = key.view(np.int64)
            for i, item in enumerate(ids):
                a, b = words.bounds[i], words.bounds[i + 1]
                n = int(min(WIDTH, b - a))
                width = min(SHINGLE, n)
                for first in range(a, b - n + 1) if n else ():
                    out["item_id"].append(item)
                    out["passage"].append(_plain(words, first, first + n))
                    out["n"].append(n)
                    out["keys"].append(by_width[width][first : first + n - width + 1].tolist())
            types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id as text, passage, n words, keys of its shingles) for every window of every item."""
    rows = items.select(col(item_id).cast("string").alias("item_id"), col(text).cast("string").alias("text"))
    return rows.dropna().mapInArrow(_item_windows, "item_id string, passage string, n int, keys array<bigint>")


def bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each slot that any of ``keys`` (column ``key``) falls into: BITMAP_BITS bits, from eight parts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_BITS, bool)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in keys.select("key").repartition(8).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = _slot(keys)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def shingle_counts(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """(key, n) over all documents, for the shingles that ``bits`` lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                _, keys = _shingles(words_of(part.column("text"), True, SYMBOLS), widths)
                found, n = np.unique(keys[_has(sent.value, keys)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """Per document: number of words and the places of shingles that ``bits`` lets pass, each with the words around."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    place = pa.list_(pa.struct([("at", pa.int64()), ("lo", pa.int64()), ("key", pa.int64()), ("around", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column("text"), True, SYMBOLS)
                at, keys = _shingles(words, widths)
                hit = _has(sent.value, keys)
                at, keys = at[hit], keys[hit].view(np.int64)
                owner = np.searchsorted(words.bounds, at, side="right") - 1
                out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for i, p, key in zip(owner.tolist(), at.tolist(), keys.tolist(), strict=True):
                    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                    lo, hi = max(a, p - WIDTH + 1), min(b, p + WIDTH)
                    out[i].append({"at": p - a, "lo": lo - a, "key": key, "around": _plain(words, lo, hi)})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(words.counts()), pa.array(out, place)],
                    ["doc_id", "text_key", "n_words", "places"],
                )

    schema = "doc_id bigint, text_key bigint, n_words bigint, places array<struct<at:bigint,lo:bigint,key:bigint,around:string>>"
    return docs.mapInArrow(find, schema)


def judge(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit (words inside occurrences), items (sorted ids)."""
    rows = docs.select(
        col(doc_id).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"), F.xxhash64(col(text)).alias("text_key")
    )
    windows = cut_lineage(item_windows(items), "windows")
    passages = windows.groupBy("passage").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    shingles = passages.select("passage", F.posexplode("keys").alias("offset", "key"))
    short = windows.filter(F.col("n") < SHINGLE).select("n").distinct().collect()  # at most SHINGLE - 1 rows
    widths = sorted({SHINGLE, *[r["n"] for r in short]})
    counted = shingle_counts(rows, bitmap(shingles.select("key").distinct()), widths)
    # the rarest shingle of each passage; one that no document has can't occur
    prefix = (
        shingles.join(counted, "key")
        .groupBy("passage")
        .agg(F.min_by(F.struct("offset", "key"), F.struct("n", "key", "offset")).alias("p"))
        .join(passages.select("passage", "n"), "passage")
        .select("passage", "n", "p.offset", "p.key")
    )
    prefix = cut_lineage(prefix, "prefixes")
    seen = _places(rows, bitmap(prefix.select("key").distinct()), widths)
    seen = cut_lineage(seen.withColumn("_row", F.monotonically_increasing_id()), "places")

    start = F.col("p.at") - F.col("offset")
    occur = (
        seen.select("_row", "n_words", F.explode("places").alias("p"))
        .join(prefix, F.col("p.key") == F.col("key"))
        .filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .filter(F.array_join(F.slice(F.split("p.around", " "), (start - F.col("p.lo") + 1).cast("int"), F.col("n")), " ") == F.col("passage"))
        .select("_row", "passage", start.alias("start"), "n")
    )
    occur = cut_lineage(occur, "occurrences")
    covered = occur.groupBy("_row").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    named = (
        occur.select("_row", "passage").distinct()
        .join(windows.select("passage", "item_id").distinct(), "passage")
        .groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return (
        seen.select("_row", "doc_id", "text_key", "n_words")
        .join(covered.select("_row", n_hit.cast("bigint").alias("n_hit")), "_row", "left")
        .join(named, "_row", "left")
        .select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with the columns of ``docs``."""
    leaks = judge(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return unboxed(boxed(docs, doc_id=F.col("doc_id").cast("bigint"), text_key=F.xxhash64("text")).join(leaks, same, "left_anti"))
