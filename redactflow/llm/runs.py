"""Periodic runs of words in each text, found with a dictionary of basic factors (Crochemore and Rytter).

For every length 2**k the dictionary gives each place the name of the factor of that length that starts there: two
names are equal if and only if the factors are. A place's successor is the next place with its name; if that lies within
2 * 2**k, the distance is proposed as a period. Neighbouring places that propose one period form a progression, of which
only the ends matter: the stretch it covers is extended to both sides by descending through the lengths, and equal
stretches are dropped. A run of period p and 4 * p words or more is proposed for the k with 2**k >= p > 2**(k-1): a
factor as long as the period recurs first one period on. A distance that is a multiple of a smaller period is never
proposed inside a run of it, because the successor is the nearest place.

Names are kept only for factors that occur again in the same text, which is why lengths beyond a few words cost next to
nothing in prose; a factor without a name equals no other. All texts of a chunk are named together, with one sort a
length. No Python object is made per word.

A run is a stretch with smallest period q, ``max(6, 4 * q)`` words or longer, that no neighbouring word extends. Null and
empty texts have no runs and an empty collapsed text. Rows are judged each for itself, so repeated rows and ids change
nothing; an empty table gives an empty result. Texts may be of any length: the arrays of a chunk are some ten times the
text. Words are told apart by 64-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactflow.llm.table import col, without
from redactflow.llm.words import CHUNK_BYTES, Words, chunks, words_of

#: A run has at least this many words and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_BLANK = 0x20


@dataclass
class _Level:
    """Names of the factors of ``width`` words: ``names[i]`` belongs to place ``at[i]``, ascending. The other places
    hold factors that occur once in their text."""

    width: int
    at: np.ndarray
    names: np.ndarray

    def name(self, places: np.ndarray) -> np.ndarray:
        """Names at ``places``, -1 where there is none."""
        if not len(self.at):
            return np.full(len(places), -1, np.int64)
        i = np.minimum(np.searchsorted(self.at, places), len(self.at) - 1)
        return np.where(self.at[i] == places, self.names[i], -1)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left = self.name(a)
        return (left >= 0) & (left == self.name(b))


def _named(at: np.ndarray, keys: np.ndarray, text: np.ndarray, width: int) -> tuple[_Level, np.ndarray]:
    """The level of the factors told apart by ``keys``, without those that occur once in their text, and for each place
    its successor in the same text (-1: none)."""
    order = np.argsort(keys, kind="stable")
    same = (keys[order[1:]] == keys[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    after = np.full(len(at), -1, np.int64)
    after[order[:-1][same]] = at[order[1:][same]]
    again = after >= 0
    again[order[1:][same]] = True
    fresh = np.ones(len(at), bool)
    fresh[1:] = ~same
    names = np.empty(len(at), np.int64)
    names[order] = np.cumsum(fresh) - 1
    return _Level(width, at[again], names[again]), after[again]


def dictionary(keys: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[_Level, np.ndarray]]:
    """Levels by growing width, each with the successors of its places, as long as any factor recurs. Text ``i`` holds
    words ``bounds[i]`` to ``bounds[i + 1]``; no factor reaches beyond its text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    level, after = _named(np.arange(len(keys)), keys, text, 1)
    while len(level.at):
        yield level, after
        # the factor of twice the width is the pair of names of its halves
        second = level.name(level.at + level.width)
        whole = (second >= 0) & (level.at + 2 * level.width <= bounds[1:][text[level.at]])
        at, first, second = level.at[whole], level.names[whole], second[whole]
        level, after = _named(at, first * (len(keys) + 1) + second, text[at], 2 * level.width)


def _reach(levels: list[_Level], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many words agree from places ``a`` and ``b`` on, forward or backward (``a`` and ``b`` then not included)."""
    out = np.zeros(len(a), np.int64)
    for level in reversed(levels):
        step = out if forward else -out - level.width
        out += np.where(level.equal(a + step, b + step), level.width, 0)
    return out


def runs_of(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and then period. Starts count over all texts."""
    levels, starts, ends, periods = [], [], [], []
    for level, after in dictionary(keys, bounds):
        levels.append(level)
        gap = after - level.at
        near = (after >= 0) & (gap <= 2 * level.width)
        at, gap = level.at[near], gap[near]
        # neighbouring places with one distance: the stretch from the first to the last one's factor has that period
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])
        head = np.flatnonzero(first)
        tail = np.append(head[1:], len(at)) - 1 if len(head) else head
        starts.append(at[head])
        ends.append(at[tail] + level.width)
        periods.append(gap[head])
    if not levels:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = map(np.concatenate, (starts, ends, periods))
    start = start - _reach(levels, start, start + period, forward=False)
    length = end + _reach(levels, end, end + period, forward=True) + period - start
    found = np.unique(np.stack([start, period, length]), axis=1)
    keep = found[2] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * found[1])
    start, period, length = found[:, keep]
    return start, length, period


def _kept(words: Words, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period."""
    change = np.zeros(len(words.keys) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text with one blank between them."""
    n = np.diff(np.concatenate([[0], np.cumsum(kept)])[words.bounds])
    starts, sizes = words.starts[kept], (words.ends - words.starts)[kept] + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    data = np.append(words.data, np.uint8(_BLANK))[take]
    data[offsets[1:] - 1] = _BLANK
    # the blank after a text's last word goes
    bounds = np.concatenate([[0], np.cumsum(n)])
    alive = np.ones(len(data), bool)
    alive[offsets[bounds[1:][n > 0]] - 1] = False
    ends = offsets[bounds] - np.concatenate([[0], np.cumsum(n > 0)])
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[alive])])


def _find(room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", room):
                yield _judged(part)

    return run


def _judged(part: pa.RecordBatch) -> pa.RecordBatch:
    words = words_of(part.column("_text"))
    start, length, period = runs_of(words.keys, words.bounds)
    ends = np.searchsorted(start, words.bounds)
    collapsed = _joined(words, _kept(words, start, length, period))
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(ends))
    fields = [pa.array(x, pa.int64()) for x in (start - words.bounds[text], length, period)]
    runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    rest = [c for c in part.schema.names if c != "_text"]
    arrays = [*[part.column(c) for c in rest], pa.array(words.counts(), pa.int64()), runs, collapsed.cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [*rest, "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text", room: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period; places are word numbers from 0) and ``collapsed``: the
    words that no run holds after its first period. Columns of ``docs`` with these names go. One pass, no shuffle.
    Texts are taken in chunks of about ``room`` bytes, which changes no result."""
    # the other columns travel in one struct: whatever their names are
    rest = without(docs, ["n_words", "runs", "collapsed"])
    held = F.struct(*[col(c) for c in rest.columns]) if rest.columns else F.struct(F.lit(None).cast("int").alias("_"))
    boxed = docs.select(held.alias("_doc"), col(text).cast("string").alias("_text"))
    schema = T.StructType([boxed.schema["_doc"], *T.StructType.fromDDL(RESULT).fields])
    found = boxed.mapInArrow(_find(room), schema)
    return found.select(*(["_doc.*"] if rest.columns else []), "n_words", "runs", "collapsed")


def longest(runs: Column) -> Column:
    """The run with the greatest length; of equal ones the one that starts first, then the one of smallest period."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))


def listed(runs: Column) -> Column:
    """All runs as lines of ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, every tenth of them by crc32 with a periodic tail: with h = crc32(doc_id), g = h // 10
    and n words, each word from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null doc_id
    leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("_h")).withColumn(
        "_w", F.when(F.col("_h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    )
    numbered = words.withColumns({"_n": F.size("_w"), "_g": F.floor(F.col("_h") / 10)}).withColumn("_a", F.expr("cast(_g % nullif(_n, 0) as int)"))
    tail = F.expr("transform(sequence(0, _n - _a - 1), i -> _w[_a + i % _p])")
    changed = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")
    periods = numbered.withColumn("_p", F.expr("cast(1 + floor((_n - _a) / (3 + _g % 8)) as int)"))
    return periods.select("doc_id", F.when(F.col("_n") > 0, changed).otherwise(F.col("text")).alias("text"))
