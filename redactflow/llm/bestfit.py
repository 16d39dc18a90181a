"""Documents packed into sequences of a fixed number of tokens by Best-two-fit (Friesen and Langston, 1991).

Sequences are filled one at a time: the longest piece that still fits goes in until none does; then, if the sequence
holds more than one piece, its smallest is exchanged for the two unpacked pieces whose sum is largest, provided they fit
the gap widened by it and fill it better. Only a document longer than a sequence is cut, into whole sequences and a rest.

What decides is how many pieces there are of each length, never which. The plan is therefore made from a histogram of
at most ``capacity`` numbers, whatever the corpus: a filling is repeated for as long as every length it uses lasts,
which gives the very sequences that filling one by one gives, and some pieces run out each time, so fillings are few.
Pieces of one length are numbered where they are cut (their task and their place among its pieces of that length, kept
in a written table) and the plan tells each number its sequence and place there. No piece is shuffled for packing except
to learn where its task's numbers begin, and no length or source meets in one task.

Tokens are those of a tokenizer file that splits at white space, computed once for each distinct word of a chunk and kept
for later chunks of the same worker; words are told apart by 64-bit keys. Null texts count as empty: one piece with the
end token alone. Repeated rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactflow.llm.table import col
from redactflow.llm.words import BLANKS, Words, chunks, span_keys, text_bytes
from redactflow.session import cut_lineage, spread

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose tokens a worker keeps; with more it starts anew. About 40 MB.
KEPT_WORDS = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, _task int, _nth long"
_SPECIAL = b"<|"


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name among the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def units_of(column: pa.Array) -> Words:
    """Words, ASCII letters lower-cased (the tokenizer does so too) unless a special token might be written in the chunk;
    one closing mark after a letter is a unit of its own, as it is for the tokenizer. So more words are alike."""
    data, offsets = text_bytes(column)
    if _SPECIAL not in data.tobytes():
        upper = (data >= ord("A")) & (data <= ord("Z"))
        data = np.where(upper, data + np.uint8(32), data)
    inside = ~BLANKS[data]
    # letters: ASCII ones, and those of two bytes from U+00E0 to U+00FF but for the division sign
    letter = ((data | 32) >= ord("a")) & ((data | 32) <= ord("z"))
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0xA0) & (data[1:] <= 0xBF) & (data[1:] != 0xB7)
    mark = _MARKS[data]
    mark[1:] &= letter[:-1]
    mark[:1] = False
    mark[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    # the byte after a text's last one is another text's: a mark there may or may not stand apart, the tokens are the same
    edges = edges[edges < len(data)]
    mark[edges] = False
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | mark[1:]
    last[:-1] &= ~inside[1:] | mark[1:]
    first[edges] = inside[edges]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(span_keys(data, starts, ends), np.searchsorted(starts, offsets), starts, ends, data, offsets)


_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True


class Encoder:
    """Token ids of whole texts; remembers the tokens of words."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.bounds, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """``keys`` ascending, none of them known."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        all_keys = np.concatenate([self.keys, keys])
        starts = np.concatenate([self.bounds[:-1], self.bounds[-1] + np.cumsum(sizes) - sizes])
        all_sizes = np.concatenate([np.diff(self.bounds), sizes])
        all_ids = np.concatenate([self.ids, flat])
        order = np.argsort(all_keys, kind="stable")
        self.keys, (self.ids, self.bounds) = all_keys[order], gathered(all_ids, starts[order], all_sizes[order])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text)."""
        units = units_of(column)
        distinct, first, which = np.unique(units.keys, return_index=True, return_inverse=True)
        at, known = self._places(distinct)
        if not known.all():
            if len(self.keys) + len(distinct) > KEPT_WORDS:
                self._forget()
                known[:] = False
            raw = units.data.tobytes()
            new = first[~known]
            self._learn(distinct[~known], [raw[a:b].decode() for a, b in zip(units.starts[new].tolist(), units.ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        starts, sizes = self.bounds[at][which], np.diff(self.bounds)[at][which]
        ids, ends = gathered(self.ids, starts, sizes)
        return ids, ends[units.bounds]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``values`` one after another, and their bounds in the result."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cut(tokenizer: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path(tokenizer))
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, bounds = encoder.encode(part.column("text"))
                sizes = np.diff(bounds) + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(sizes[row] - start, capacity)
                closed = np.insert(ids, bounds[1:], end).astype("<u4")
                own = (bounds[:-1] + np.arange(len(sizes)))[row] + start
                raw = closed.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(own.tolist(), length.tolist(), strict=True)]
                # the n-th piece of its length in this task
                order = np.argsort(length, kind="stable")
                ranked, nth = length[order], np.empty(len(length), np.int64)
                lead = np.searchsorted(ranked, ranked)
                nth[order] = seen[ranked] + np.arange(len(ranked)) - lead
                seen += np.bincount(length, minlength=capacity + 1)
                if with_ids:
                    flat, ends = gathered(closed, own, length)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
                else:
                    lists = pa.nulls(len(row), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(number, pa.int32()),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        lists,
                        pa.array(np.full(len(row), task, np.int32)),
                        pa.array(nth),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "_task", "_nth"],
                )

    return run


def fillings(counts: np.ndarray) -> Iterator[tuple[dict[int, int], int]]:
    """What Best-two-fit puts into sequences, given how many pieces there are of each length (``counts[n]``; the last
    index is the capacity): pieces of each length, longest first, and how many sequences in turn are filled so."""
    counts = counts.astype(np.int64).copy()
    capacity = len(counts) - 1
    lengths = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(counts > 0, lengths, 0))  # the longest piece left of at most that length
    while below[capacity]:
        use, gap, n = {}, capacity, int(below[capacity])
        while n:
            use[n] = int(min(counts[n], gap // n))
            gap -= n * use[n]
            n = int(below[min(gap, n - 1)])
        limit = None
        if gap and sum(use.values()) > 1:
            small = min(use)
            pair = _best_pair(counts, below, gap + small, small, use)
            if pair:
                use[small] -= 1
                limit = (int(counts[small]) - 1) // use[small] if use[small] else None
                if not use[small]:
                    del use[small]
                for n in pair:
                    use[n] = use.get(n, 0) + 1
        times = min(int(counts[n]) // k for n, k in use.items())
        times = times if limit is None else max(1, min(times, limit))
        for n, k in use.items():
            counts[n] -= k * times
        if any(counts[n] == 0 for n in use):
            below = np.maximum.accumulate(np.where(counts > 0, lengths, 0))
        yield dict(sorted(use.items(), reverse=True)), times


def _best_pair(counts: np.ndarray, below: np.ndarray, gap: int, small: int, use: dict[int, int]) -> tuple[int, int] | None:
    """Two pieces that are not in use, longer together than ``small`` but not than ``gap``; the longest such pair, and of
    equal ones that with the longest piece."""
    left = counts[: gap + 1].copy()
    for n, k in use.items():
        if n <= gap:
            left[n] -= k
    longest = np.maximum.accumulate(np.where(left > 0, np.arange(gap + 1), 0))
    a = np.flatnonzero(left > 0)
    a = a[a < gap]
    if not len(a):
        return None
    b = longest[np.minimum(gap - a, a)]
    twin = (a == b) & (left[a] < 2)
    b = np.where(twin, longest[np.maximum(b - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = len(a) - 1 - int(np.argmax(total[::-1]))
    return (int(a[best]), int(b[best])) if total[best] > small else None


def plan(counts: np.ndarray) -> np.ndarray:
    """Rows (length, first number, first sequence, pieces of the length in each, place of the first there), by length and
    number: the pieces of a length with the numbers from there on go to these sequences."""
    rows, taken, sequence = [], np.zeros(len(counts), np.int64), 0
    for use, times in fillings(counts):
        place = 0
        for n, k in use.items():
            rows.append((n, int(taken[n]), sequence, k, place))
            taken[n] += k * times
            place += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


#: Numbers of pieces of one length stay below this.
_MANY = np.int64(1) << 48


def _placed(rows: np.ndarray):
    keys = rows[:, 0] * _MANY + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "_number"))
            row = rows[np.searchsorted(keys, length * _MANY + number, "right") - 1]
            sequence, slot = np.divmod(number - row[:, 1], row[:, 3])
            rest = [c for c in batch.schema.names if c != "_number"]
            arrays = [batch.column(c) for c in rest] + [pa.array(row[:, 2] + sequence), pa.array(row[:, 4] + slot * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*rest, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (tokens of its document before it), length, ids_crc32, ids (null
    unless ``with_ids``), sequence_id and offset. Other columns of ``docs`` are not read."""
    rows = spread(docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")))
    pieces = cut_lineage(rows.mapInArrow(_cut(tokenizer, capacity, end, with_ids), PIECES), "pieces")
    per_task = cut_lineage(pieces.groupBy("length", "_task").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task")) - F.col("n")
    numbered = pieces.join(per_task.select("length", "_task", before.alias("_before")), ["length", "_task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("_before") + F.col("_nth")).alias("_number")
    )
    result = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"
    return numbered.mapInArrow(_placed(plan(counts)), result)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, pieces in their order: sequence_id, ids. Needs ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
