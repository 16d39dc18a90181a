"""Repeated passages, by suffix trees over prefix groups.

Every word position starts a suffix; a passage of ``WIDTH`` words that occurs twice is an internal node at that depth.
Documents are read in blocks (a run of rows of one partition, about ``BLOCK_BYTES`` of text, ordered by doc_id):

1. *Filter.* Each block sends the sorted, distinct keys of its windows, cut to ``KEY_BITS`` below those that name the
   range, to ranges of keys. A range answers each block with one bit per key: does another block have it? Only suffixes
   of which the answer is yes can lie below a shared deep node; chance hits are sorted out in step 2.
2. *Trees.* A suffix travels as its path: ``WIDTH`` words as edges of ``EDGE`` words, each edge hashed to 32 bits, so two
   different passages would have to agree in 160 bits. Groups are prefixes of variable length: ranges of first edges,
   of first and second edges where that is too much for one group, or of whole paths where it still is. A group sorts
   its suffixes, takes the depth common to neighbours, and so has its subtree; below each node of full depth all leaves
   but the first, by (doc_id, block, position), are repeats. A block sends a path once, whatever it repeats inside, so
   a passage that all documents share is one leaf for each block.
3. *Removal.* Blocks take the bits for their suffixes, add their inner repeats, and drop the covered words.

Blocks are computed anew in each step and bits are kept as tables by block under ``spark.checkpoint.dir``, so texts
are never shuffled and a lost executor costs its blocks only. If a block comes out different on a second reading, the
bits don't fit and the job fails; write the input as a table first in that case.

Null and empty texts have no words. Fewer than WIDTH words: no window, nothing is removed. Rows with one doc_id are
documents of their own; of equal passages in them, the one in the earlier row of the earlier block stays. A null
doc_id comes before all others. Input columns beside doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame

from redactflow.llm.packing import packed, unpacked
from redactflow.llm.table import col
from redactflow.llm.words import CHUNK_BYTES, Words, window_keys, words_of
from redactflow.session import cut_lineage, scratch_path

WIDTH = 20
EDGE = 4
BLOCK_BYTES = 8 << 20
#: Bits of a key inside its range; ranges grow in number with the input, so chance hits stay as rare.
KEY_BITS = 34
#: Suffixes that one group takes at most, by the counts of step 1.
GROUP_SUFFIXES = 2_000_000
_FAN = 64  # prefixes of one and of two edges are counted in _FAN and _FAN**2 ranges
_EDGES = WIDTH // EDGE
_FIRST_ID = -(1 << 63)


class Block:
    """The windows of a block: ``keys`` sorted and distinct, ``first`` the place of each key's first window."""

    def __init__(self, number: int, rows: pa.Table):
        self.number = number
        ids = pc.fill_null(rows.column("doc_id"), _FIRST_ID).to_numpy()
        rows = rows.take(pa.array(np.argsort(ids, kind="stable")))
        self.rows = rows
        self.ids = np.sort(ids)
        self.words = _joined(rows.column("text"))
        at, keys = window_keys(self.words.keys, self.words.bounds, WIDTH)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = at[order]
        self.keys, self.first, self.inner = keys[new], at[new], at[~new]

    def paths(self, which: np.ndarray) -> np.ndarray:
        """[suffix, edge] of the windows at places ``which``."""
        n = len(self.words.keys) - EDGE + 1
        edge = np.zeros(max(n, 0), np.uint32)
        at, keys = window_keys(self.words.keys, np.array([0, len(self.words.keys)]), EDGE, seed=1)
        edge[at] = (keys >> np.uint64(32)).astype(np.uint32)
        return np.stack([edge[which + EDGE * i] for i in range(_EDGES)], axis=1) if len(which) else np.zeros((0, _EDGES), np.uint32)

    def repeats(self, repeated: np.ndarray) -> np.ndarray:
        """Places of all windows but those that are first everywhere. ``repeated``: of each key, whether its first
        window here is no first one."""
        return np.concatenate([self.inner, self.first[repeated]])


def _joined(column: pa.ChunkedArray) -> Words:
    """Keys and bounds of a block's words, hashed piece by piece."""
    keys, counts = [], [np.zeros(1, np.int64)]
    for piece in column.chunks:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(piece), 0).to_numpy(zero_copy_only=False)) // CHUNK_BYTES
        cut = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(piece)]
        for a, b in zip(cut, cut[1:], strict=False):
            if b > a:
                words = words_of(piece.slice(a, b - a))
                keys.append(words.keys)
                counts.append(words.counts())
    none = np.zeros(0, np.int64)
    return Words(np.concatenate([np.zeros(0, np.uint64), *keys]), np.cumsum(np.concatenate(counts)), none, none, none, none)


def _blocks(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[Block]:
    """Runs of rows by size of text alone, so that batch borders don't matter."""
    held, size, number = [], 0, 0
    part = TaskContext.get().partitionId() << 24

    def close():
        return Block(part + number, pa.Table.from_batches(held).combine_chunks())

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            size += n
            if size >= room:
                held.append(batch.slice(start, i + 1 - start))
                yield close()
                held, size, number, start = [], 0, number + 1, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield close()


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of 64-bit keys starts among the sorted ``keys``."""
    edges = np.array([(i << 64) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _counts_of(paths: np.ndarray) -> np.ndarray:
    """How many suffixes each of _FAN**2 ranges of first and second edges has."""
    shift = np.uint32(32 - _FAN.bit_length() + 1)
    return np.bincount((paths[:, 0] >> shift).astype(np.int64) * _FAN + (paths[:, 1] >> shift), minlength=_FAN * _FAN)


def _key_rows(ranges: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, room):
            out = {"part": [], "block": [], "width": [], "blob": []}
            cuts = _ranges(block.keys, ranges)
            short = np.uint64(max(0, 64 - KEY_BITS - ranges.bit_length()))
            for i in range(ranges):
                if cuts[i + 1] > cuts[i]:
                    width, blob = packed((block.keys[cuts[i] : cuts[i + 1]] - np.uint64((i << 64) // ranges)) >> short)
                    for k, v in zip(out, (i, block.number, width, blob), strict=True):
                        out[k].append(v)
            for k, v in zip(out, (-1 - block.number % ranges, block.number, 8, _counts_of(block.paths(block.first)).astype("<i8").tobytes()), strict=True):
                out[k].append(v)
            yield _batch(out)

    return run


_ROW = "part int, block bigint, width int, blob binary"
_TYPES = {"part": pa.int32(), "block": pa.int64(), "width": pa.int32(), "blob": pa.binary()}


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in _TYPES.items()], list(_TYPES))


def _shared_keys(rows: pa.Table) -> pa.Table:
    """Of one range: for each block, which of its keys another block has. Negative parts: the sum of some blocks' counts."""
    blocks, widths, blobs = (rows.column(c).to_pylist() for c in ("block", "width", "blob"))
    if (part := rows.column("part")[0].as_py()) < 0:
        total = sum(np.frombuffer(b, "<i8") for b in blobs)
        return pa.Table.from_batches([_batch({"part": [part], "block": [-1], "width": [8], "blob": [total.tobytes()]})])
    each = [unpacked(w, b) for w, b in zip(widths, blobs, strict=True)]
    sizes = [len(x) for x in each]
    values = np.concatenate(each)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(ranked), bool)
    # two keys of one block may agree in the bits sent: then both count, which costs a suffix but loses none
    hit[order] = same[:-1] | same[1:]
    return _answer(rows, blocks, sizes, hit)


def _answer(rows: pa.Table, blocks: list[int], sizes: list[int], hit: np.ndarray) -> pa.Table:
    cuts = np.cumsum([0, *sizes])
    bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table([rows.column("part").combine_chunks(), pa.array(blocks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], list(_TYPES))


def _by_block(answers: DataFrame, label: str) -> str:
    """Writes answers as one folder per block and returns the path."""
    path = scratch_path(answers.sparkSession, label)
    answers.repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(path)
    return path


def _bits(path: str, block: int, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The answers for a block, by part; they must be as many as the block asked for."""
    system, root = pafs.FileSystem.from_uri(path)
    found = system.get_file_info(pafs.FileSelector(f"{root}/block={block}", allow_not_found=True))
    files = [f.path for f in found if f.path.endswith(".parquet")]
    out = {}
    for f in files:
        t = pq.read_table(system.open_input_file(f))
        for part, n, blob in zip(*[t.column(c).to_pylist() for c in ("part", "width", "blob")], strict=True):
            out[part] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
    if {k: len(v) for k, v in out.items()} != sizes:
        raise RuntimeError(f"block {block} came out different on another reading of the documents: write them as a table first")
    return out


def plan_groups(counts: np.ndarray, parts: int, limit: int = GROUP_SUFFIXES) -> tuple[np.ndarray, np.ndarray]:
    """(first group, groups) of each range of first and second edges.

    A range of first edges that fits into a group is one; otherwise its ranges of second edges are packed into groups
    in order, and one that alone is too large gets several groups, told apart by the whole path.
    """
    fits = max(1, min(limit, -(-int(counts.sum()) // max(1, parts))))
    base, many, group = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0
    for i in range(_FAN):
        own = counts[i * _FAN : (i + 1) * _FAN]
        if own.sum() <= fits:
            base[i * _FAN : (i + 1) * _FAN] = group
            group += 1
            continue
        room = 0
        for j, n in enumerate(own.tolist(), i * _FAN):
            if n > fits:
                group += room > 0
                base[j], many[j], room = group, -(-n // fits), 0
                group += many[j]
                continue
            if room + n > fits:
                group, room = group + 1, 0
            base[j] = group
            room += n
        group += room > 0
    return base, many


def _grouped(block: Block, path: str, ranges: int, base: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes of a block that another block may share: (index of key, group, path), by group and path."""
    cuts = _ranges(block.keys, ranges)
    sizes = {i: int(n) for i, n in enumerate(np.diff(cuts)) if n}
    answers = _bits(path, block.number, sizes)
    shared = np.flatnonzero(np.concatenate([np.zeros(0, bool), *[answers[i] for i in sorted(answers)]]))
    paths = block.paths(block.first[shared])
    shift = np.uint32(32 - _FAN.bit_length() + 1)
    cell = (paths[:, 0] >> shift).astype(np.int64) * _FAN + (paths[:, 1] >> shift)
    whole = paths.astype(np.uint64) @ np.array([3, 5, 7, 11, 13], np.uint64)
    group = base[cell] + (whole % many[cell].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((*paths.T[::-1], group))
    return shared[order], group[order], paths[order]


def _suffix_rows(path: str, ranges: int, base: np.ndarray, many: np.ndarray, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, room):
            shared, group, paths = _grouped(block, path, ranges, base, many)
            doc = np.searchsorted(block.words.bounds, block.first[shared], side="right") - 1
            out = {"part": [], "block": [], "width": [], "blob": []}
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            for a, b in zip(cuts, cuts[1:], strict=False):
                record = np.empty(b - a, [("path", "<u4", _EDGES), ("doc", "<i8")])
                record["path"], record["doc"] = paths[a:b], block.ids[doc[a:b]]
                for k, v in zip(out, (int(group[a]), block.number, b - a, record.tobytes()), strict=True):
                    out[k].append(v)
            yield _batch(out)

    return run


def common_depth(paths: np.ndarray) -> np.ndarray:
    """Edges that each sorted path has in common with the one before it: the depth of the node between two leaves."""
    same = np.zeros((len(paths), _EDGES), bool)
    same[1:] = paths[1:] == paths[:-1]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _tree(rows: pa.Table) -> pa.Table:
    """The subtree of one group: leaves below a node of full depth that are not its first."""
    blocks, sizes, blobs = (rows.column(c).to_pylist() for c in ("block", "width", "blob"))
    record = np.frombuffer(b"".join(blobs), [("path", "<u4", _EDGES), ("doc", "<i8")])
    block = np.repeat(np.array(blocks, np.int64), sizes)
    order = np.lexsort((np.arange(len(record)), block, record["doc"], *record["path"].T[::-1]))
    again = np.zeros(len(record), bool)
    again[order] = common_depth(record["path"][order]) == _EDGES
    return _answer(rows, blocks, sizes, again)


def _removal(key_path: str, tree_path: str, ranges: int, base: np.ndarray, many: np.ndarray, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, room):
            shared, group, _ = _grouped(block, key_path, ranges, base, many)
            groups, sizes = np.unique(group, return_counts=True)
            answers = _bits(tree_path, block.number, dict(zip(groups.tolist(), sizes.tolist(), strict=True)))
            repeated = np.zeros(len(block.keys), bool)
            repeated[shared] = np.concatenate([np.zeros(0, bool), *[answers[g] for g in groups.tolist()]])
            bounds, n = block.words.bounds, len(block.words.keys)
            cover = np.zeros(n + 1, np.int32)
            at = block.repeats(repeated)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WIDTH, -1)
            keep = np.cumsum(cover[:-1]) == 0
            del cover, at, repeated
            gone = np.concatenate([[0], np.cumsum(~keep)])
            removed = gone[bounds[1:]] - gone[bounds[:-1]]
            step = 2000
            for lo in range(0, block.rows.num_rows, step):
                part = block.rows.slice(lo, step)
                kept = []
                for i, text in enumerate(part.column("text"), lo):
                    words = (text.as_py() or "").encode().split()
                    kept.append(b" ".join(compress(words, keep[bounds[i] : bounds[i + 1]].tolist()) if removed[i] else words).decode())
                hi = lo + part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").combine_chunks(), pa.array(np.diff(bounds)[lo:hi]), pa.array(removed[lo:hi]), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def _total(rows: DataFrame) -> np.ndarray:
    """Sum of all counts: eight partial sums go to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_FAN * _FAN, np.int64)
        for batch in batches:
            for blob in batch.column("blob"):
                total += np.frombuffer(blob.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    parts = rows.filter("part < 0").select("blob").repartition(8).mapInArrow(add, "blob binary").collect()
    return sum(np.frombuffer(r["blob"], "<i8") for r in parts)


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", room: int = BLOCK_BYTES, limit: int = GROUP_SUFFIXES
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one blank) of every row."""
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    shared = rows.mapInArrow(_key_rows(ranges, room), _ROW).groupBy("part").applyInArrow(_shared_keys, _ROW)
    shared = cut_lineage(shared, "shared")
    key_path = _by_block(shared.filter("part >= 0"), "shared")
    base, many = plan_groups(_total(shared), ranges, limit)
    suffixes = rows.mapInArrow(_suffix_rows(key_path, ranges, base, many, room), _ROW)
    tree_path = _by_block(suffixes.groupBy("part").applyInArrow(_tree, _ROW), "repeats")
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    return rows.mapInArrow(_removal(key_path, tree_path, ranges, base, many, room), out)
