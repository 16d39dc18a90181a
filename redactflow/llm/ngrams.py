"""Language-model scores from an n-gram trie in Elias-Fano levels.

Level 1 holds the words of the training texts by their keys, level k the n-grams of k words as (node of the first k - 1
words, number of the last word). A level is cut into parts by ranges of that pair, about ``PART_TOKENS`` tokens each; a
context with more than that is cut by the last word. In a part three sequences are kept as Elias-Fano: the contexts
that have n-grams here, the monotone pointers to the first n-gram of each, and the n-grams as context * words + word.
An n-gram is found by the successor of its value inside its context's range. Parts are files under
``spark.checkpoint.dir``, written by the tasks that gather them and mapped into memory by those that score.

Probabilities are smoothed by interpolation with absolute discounting: p(w | h) = max(c(hw) - D, 0) / c(h) + g(h) p(w | h'),
where g(h) is what the stored first terms of h leave of 1, and the lowest order is (c(w) + 1) / (N + V + 1). First
terms and g are quantised to one byte on a log scale, rounded down, so probabilities never sum up to more than 1.
All n-grams are stored (``MIN_COUNT`` = 1); with a larger one, the mass of those of two or more words seen less often
would be in g(h).

Work goes level by level. A block of text sorts its different pairs and sends them, with their training counts, to the
parts that own them. A part sums the counts, writes its file, looks up the union of what was asked once in ascending
order, and writes for each block what it found; the block takes its nodes from there when it asks the next level. So
every pair of a block is looked up once, and no part is visited again. What was told is only a copy: a block whose rows
have changed since looks its pairs up in the parts. Nothing but one short row for each part comes to the driver. The
model grows with the corpus. Null and empty texts consist of the end alone. Repeated rows count and are scored each for
itself. Nothing to learn from: N = V = 0, every token has probability 1 / 1. Input columns named like a result are
replaced. Different words are told apart by their 64-bit keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactflow.llm import elias_fano as ef
from redactflow.llm.packing import plain, wide
from redactflow.llm.table import col, without
from redactflow.llm.words import chunks, mix, words_of
from redactflow.session import scratch_path

ORDER = 3
MIN_COUNT = 1
DISCOUNT = 0.5
PART_TOKENS = 4_000_000
#: Bytes of text that ask the parts together.
BLOCK = 12 << 20
#: Pairs of a part that are looked up at a time.
LOOKED = 1 << 19
#: Cuts that a part proposes for the next level.
PIECES = 16
#: One byte holds -log10 of a probability in these steps.
STEP = 0.04
END = np.uint64(0x9D5C_1F0A_77E3_B2C5)
RESULT = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-300)) / STEP - 1e-9), 0, 255).astype(np.uint8)


_VALUE = 10.0 ** (-STEP * np.arange(256))

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Level:
    """``edges``: least pair of each part; ``bases``: nodes in all parts before; ``files``: which parts have a file.
    ``split``, ``mass``: contexts that lie in several parts and the sum of their stored first terms."""

    edges: np.ndarray
    bases: np.ndarray
    files: np.ndarray
    split: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mass: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Model:
    path: str
    order: int
    words: int
    tokens: int
    levels: list[Level]

    def file(self, k: int, part: int) -> dict[str, np.ndarray]:
        return ef.load(f"{self.path}/{k}-{part}")


def counts_of(model: Model, k: int, nodes: np.ndarray) -> np.ndarray:
    """Training counts of ascending nodes."""
    level, out = model.levels[k - 1], np.zeros(len(nodes), np.int64)
    cuts = np.searchsorted(nodes, level.bases)
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[part], cuts[part + 1])
        out[at] = model.file(k, part)["counts"][nodes[at] - level.bases[part]]
    return out


def _in_part(file: dict[str, np.ndarray], k: int, words: int, pair: np.ndarray, edge: np.uint64) -> Found:
    """(place in the part or -1, count or code of the first term, code of the context's g) of ascending, different pairs,
    read forwards."""
    place, back = np.full(len(pair), -1, np.int64), np.zeros(len(pair), np.uint8)
    if k == 1:
        at, same = ef.part_of(file, "grams").successor(pair - edge)
        place[same], count = at[same], np.zeros(len(pair), np.int64)
        count[same] = file["counts"][at[same]]
        return place, count, back
    first = int(file["first"][0])
    own, last = (x.astype(np.int64) for x in np.divmod(pair, np.uint64(max(1, words))))
    at = np.arange(np.searchsorted(own, first), len(pair))
    context, inside = ef.part_of(file, "contexts").successor((own[at] - first).astype(np.uint64))
    at, context = at[inside], context[inside]
    back[at] = file["back"][context]
    a, b = (x.astype(np.int64) for x in ef.part_of(file, "pointers").ranges(context))
    value = context.astype(np.uint64) * np.uint64(words) + last[at].astype(np.uint64)
    where, same = ef.part_of(file, "grams").successor(value, a, b)
    direct = np.zeros(len(pair), np.uint8)
    place[at[same]], direct[at[same]] = where[same], file["direct"][where[same]]
    return place, direct, back


def find(model: Model, k: int, pair: np.ndarray, told: Told | None = None) -> Found:
    """(node or -1, count of a word or stored first term, g of the context) of ascending, different pairs of level k, or
    of words by their keys: from what the parts told of a block, else from the parts themselves. In the last level only
    the sign of a node has a meaning."""
    level = model.levels[k - 1]
    node, back = np.full(len(pair), -1, np.int64), np.ones(len(pair))
    direct = np.zeros(len(pair), np.int64 if k == 1 else float)
    cuts = np.append(np.searchsorted(pair, level.edges), len(pair))
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        if not level.files[part]:
            continue
        at = slice(cuts[part], cuts[part + 1])
        got = told(k, part, pair[at]) if told else None
        place, code, of_context = got or _in_part(model.file(k, part), k, model.words, pair[at], level.edges[part])
        node[at] = np.where(place >= 0, level.bases[part] + place, -1)
        direct[at] = code if k == 1 else np.where(place >= 0, _VALUE[code], 0)
        back[at] = _VALUE[of_context]
    if k > 1 and len(level.split):
        own = (pair // np.uint64(max(1, model.words))).astype(np.int64)
        slot = np.minimum(np.searchsorted(level.split, own), len(level.split) - 1)
        same = level.split[slot] == own
        back[same] = _VALUE[quantise(1 - level.mass[slot[same]])]
    return node, direct, back


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds) of the tokens: words, then the end of each text."""
    words = words_of(column, lower=True)
    n = len(column)
    keys = np.full(len(words.keys) + n, END)
    keys[np.arange(len(words.keys)) + np.repeat(np.arange(n), words.counts())] = words.keys
    return keys, words.bounds + np.arange(n + 1)


class Walk:
    """Tokens on their way through the levels: ``ask`` gives the different pairs of the next level in ascending order,
    ``take`` the nodes found for them."""

    def __init__(self, keys: np.ndarray, words: int):
        self.keys, self.words = keys, np.uint64(words)
        self.at = np.arange(len(keys))
        self.word = self.before = self.again = None

    def ask(self) -> np.ndarray:
        value = self.keys
        if self.word is not None:
            # tokens after an n-gram with a node, in one text; an unknown word is in no n-gram, but its context is asked for
            self.at = np.flatnonzero((self.before[:-1] >= 0) & (self.keys[:-1] != END)) + 1
            value = self.before[self.at - 1].astype(np.uint64) * self.words + np.maximum(self.word[self.at], 0).astype(np.uint64)
        pair, self.again = np.unique(value, return_inverse=True)
        return pair

    def take(self, node: np.ndarray) -> None:
        node = node[self.again]
        if self.word is None:
            self.word = self.before = node
        else:
            node[self.word[self.at] < 0] = -1
            self.before = np.full(len(self.keys), -1, np.int64)
            self.before[self.at] = node


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(number, rows) of blocks of about ``BLOCK`` bytes of text; where they end depends on the rows alone."""
    task, seen, number, held = TaskContext.get().partitionId() << 32, 0, 0, []
    for batch in batches:
        upto = seen + np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        block = upto // BLOCK
        cuts = np.flatnonzero(np.diff(block, prepend=number))
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a in cuts and held:
                yield task + number, held
                held = []
            if b > a:
                number, held = int(block[a]), [*held, batch.slice(a, b - a)]
        seen = int(upto[-1]) if len(upto) else seen
    if held:
        yield task + number, held


def _block_tokens(rows: list[pa.RecordBatch], text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of tokens of each text)"""
    parts = [_tokens(c.column(text)) for r in rows for c in chunks(r, text)]
    return np.concatenate([k for k, _ in parts]), np.concatenate([np.diff(b) for _, b in parts])


def _squeezed(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned integers byte by byte of equal rank, compressed: high bytes, counts and codes are mostly alike."""
    width, rows = plain(values)
    return width, pa.compress(np.frombuffer(rows, np.uint8).reshape(-1, width).T.tobytes(), "zstd", asbytes=True)


def _loose(width: int, size: int, blob: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, size * width, "zstd", asbytes=True), np.uint8)
    return wide(width, planes.reshape(width, size).T.tobytes())


def _sum(pair: np.ndarray) -> np.ndarray:
    return np.array([len(pair), np.bitwise_xor.reduce(mix(pair), initial=np.uint64(0))], np.uint64)


def _sealed(found: Found, at: np.ndarray, total: np.ndarray) -> bytes:
    place, code, back = (x[at] for x in found)
    ascending = np.maximum.accumulate(np.maximum(place, 0))
    arrays = [np.packbits(place >= 0), np.diff(ascending, prepend=0), code, back]
    pieces = [_squeezed(a.astype(np.uint64)) for a in arrays]
    return total.tobytes() + np.array([(w, len(b)) for w, b in pieces], "<u4").tobytes() + b"".join(b for _, b in pieces)


class Told:
    """What the parts told of one block: a copy of what their files hold for its pairs. If the rows of a block are not
    those that were asked for (a scan may be cut otherwise after executors were lost), it says None."""

    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def __call__(self, k: int, part: int, pair: np.ndarray) -> Found | None:
        blob = ef.section(f"{self.path}/{k}-{part}", self.block)
        if blob is None or blob[:16] != _sum(pair).tobytes():
            return None
        n, at, out = len(pair), 48, []
        for size, (width, length) in zip([-(-n // 8), n, n, n], np.frombuffer(blob, "<u4", 8, 16).reshape(4, 2).tolist(), strict=True):
            out.append(_loose(width, size, blob[at : at + length]))
            at += length
        has = np.unpackbits(out[0].astype(np.uint8), count=n).astype(bool)
        return np.where(has, np.cumsum(out[1]).astype(np.int64), -1), out[2].astype(np.int64), out[3].astype(np.uint8)


_ROW = "part int, block bigint, size int, width int, pairs binary, deep int, counts binary"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]


def _count(model: Model, k: int, edges: np.ndarray, told: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block and part, the different pairs of level k and how often training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches, "text"):
            keys, sizes = _block_tokens(rows, "text")
            train = np.repeat(np.concatenate([r.column("train").to_numpy(zero_copy_only=False) for r in rows]), sizes)
            walk = Walk(keys, model.words)
            for j in range(1, k):
                walk.take(find(model, j, walk.ask(), Told(told, block))[0])
            pairs = walk.ask()
            counts = np.bincount(walk.again, train[walk.at], len(pairs)).astype(np.uint64)
            cuts = np.append(np.searchsorted(pairs, edges), len(pairs))
            out = [
                (i, block, b - a, *_squeezed(np.diff(pairs[a:b], prepend=edges[i])), *_squeezed(counts[a:b]))
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                if b > a
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return run


def _level_part(model: Model, k: int, edges: np.ndarray, build: bool, told: str | None) -> Callable[[pa.Table], pa.Table]:
    """Sums the counts of a part and writes its file (if to be built), then looks up what each block asked for, once and
    in order, and writes that down block by block (if it is to be told)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        part, blocks, sizes, *blobs = (rows.column(c).to_pylist() for c in _NAMES)
        part = part[0]
        pairs = np.concatenate([np.cumsum(_loose(w, n, b), dtype=np.uint64) for n, w, b in zip(sizes, *blobs[:2], strict=True)]) + edges[part]
        counts = np.concatenate([_loose(w, n, b) for n, w, b in zip(sizes, *blobs[2:], strict=True)]).astype(np.int64)
        order = np.argsort(pairs, kind="stable")
        ranked = pairs[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        distinct, total = ranked[new], np.add.reduceat(counts[order], np.flatnonzero(new))
        meta = _meta(part, total[:0], 0, _NO_EDGE)
        if build:
            kept = total >= (1 if k == 1 else MIN_COUNT)
            if kept.any():
                meta = (_word_part if k == 1 else _gram_part)(model, k, edges, part, distinct[kept], total[kept], int(total.sum()))
        has = bool(meta.column("nodes")[0].as_py()) if build else bool(model.levels[k - 1].files[part])
        if told and has:
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new) - 1
            del ranked, order, counts, total
            slices = [_in_part(model.file(k, part), k, model.words, distinct[a : a + LOOKED], edges[part]) for a in range(0, len(distinct), LOOKED)]
            place, *codes = map(np.concatenate, zip(*slices, strict=True))
            # nobody asks beyond the last level: that an n-gram is there is all that is told of it
            found = (place if k < model.order else np.minimum(place, 0), *codes)
            cuts = np.cumsum([0, *sizes])
            pieces = [_sealed(found, rank[a:b], _sum(pairs[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            ef.save_sections(f"{told}/{k}-{part}", blocks, pieces)
        return meta

    return run


_META = "part int, nodes bigint, total bigint, cuts binary, loads binary, first bigint, first_mass double, last bigint, last_mass double"


def _meta(part: int, counts: np.ndarray, total: int, edge: tuple) -> pa.Table:
    """What the driver learns of a part: its size, where it could be cut for the next level, its outer contexts."""
    n = len(counts)
    upto = np.cumsum(counts)
    goal = (np.arange(1, PIECES) * (int(upto[-1]) / PIECES)) if n else np.zeros(0)
    at = np.searchsorted(upto, goal)
    cuts = np.unique(np.concatenate([np.zeros(min(n, 1), np.int64), at, at + 1]))
    cuts = cuts[cuts < n]
    loads = np.diff(np.append(np.concatenate([[0], upto])[cuts], upto[-1] if n else 0)) if len(cuts) else cuts
    values = [part, n, total, cuts.astype("<i8").tobytes(), loads.astype("<i8").tobytes(), *edge]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
    return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in _META.split(", ")])


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts


_NO_EDGE = (-1, 0.0, -1, 0.0)


def _word_part(model: Model, k: int, edges: np.ndarray, part: int, keys: np.ndarray, counts: np.ndarray, total: int) -> pa.Table:
    room = (int(edges[part + 1]) if part + 1 < len(edges) else 1 << 64) - int(edges[part])
    grams = ef.prefixed("grams", ef.Sequence.build(keys - edges[part], room))
    ef.save(f"{model.path}/{k}-{part}", grams | {"counts": _small(counts)})
    return _meta(part, counts, total, _NO_EDGE)


def _gram_part(model: Model, k: int, edges: np.ndarray, part: int, pairs: np.ndarray, counts: np.ndarray, total: int) -> pa.Table:
    context, word = (x.astype(np.int64) for x in np.divmod(pairs, np.uint64(model.words)))
    start = np.flatnonzero(np.diff(context, prepend=-1))
    contexts = context[start]
    place = np.repeat(np.arange(len(contexts)), np.diff(np.append(start, len(context))))
    direct = quantise((counts - DISCOUNT) / counts_of(model, k - 1, contexts)[place])
    mass = np.bincount(place, _VALUE[direct], minlength=len(contexts))
    first = int(contexts[0])
    value = place.astype(np.uint64) * np.uint64(model.words) + word.astype(np.uint64)
    arrays = (
        ef.prefixed("contexts", ef.Sequence.build((contexts - first).astype(np.uint64), int(contexts[-1]) - first + 1))
        | ef.prefixed("pointers", ef.Sequence.build(np.append(start, len(word)).astype(np.uint64), len(word) + 1))
        | ef.prefixed("grams", ef.Sequence.build(value, len(contexts) * model.words + 1))
        | {"direct": direct, "back": quantise(1 - mass), "first": np.array([first], np.int64)}
        | ({"counts": _small(counts)} if k < model.order else {})
    )
    ef.save(f"{model.path}/{k}-{part}", arrays)
    return _meta(part, counts, total, (first, float(mass[0]), int(contexts[-1]), float(mass[-1])))


def _level(meta: list, edges: np.ndarray, words: int) -> Level:
    nodes, files = np.zeros(len(edges), np.int64), np.zeros(len(edges), bool)
    seen: dict[int, list[float]] = {}
    for r in meta:
        nodes[r["part"]], files[r["part"]] = r["nodes"], r["nodes"] > 0
        for context, mass in {(r["first"], r["first_mass"]), (r["last"], r["last_mass"])}:
            if context >= 0:
                seen.setdefault(context, []).append(mass)
    # contexts with a cut inside; each of their parts holds no other context
    split = sorted({int(e) // words for e in edges.tolist() if int(e) % words}) if words else []
    mass = np.array([sum(seen.get(c, [])) for c in split], float)
    return Level(edges, np.concatenate([[0], np.cumsum(nodes)]), files, np.array(split, np.int64), mass)


def _next_edges(meta: list, level: Level, words: int, room: int) -> np.ndarray:
    """Least pairs of the parts of the next level: whole contexts of about ``room`` tokens together, or, for a context
    with more, ranges of its words."""
    edges, load = [0], 0
    for r in sorted(meta, key=lambda r: r["part"]):
        cuts, loads = np.frombuffer(r["cuts"], "<i8").tolist(), np.frombuffer(r["loads"], "<i8").tolist()
        for i, (at, n) in enumerate(zip(cuts, loads, strict=True)):
            node = int(level.bases[r["part"]]) + at
            alone = (cuts[i + 1] if i + 1 < len(cuts) else r["nodes"]) == at + 1
            if load and load + n > room:
                edges.append(node * words)
                load = 0
            if alone and n > room:
                parts = -(-n // room)
                edges += [node * words + j * words // parts for j in range(1, parts)]
                edges.append((node + 1) * words)
                load = 0
            else:
                load += n
    return np.array(sorted(set(edges)), np.uint64)


def _rows(docs: DataFrame, text: str, train: Column) -> DataFrame:
    return docs.select(F.coalesce(col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))


def _pass(rows: DataFrame, model: Model, k: int, edges: np.ndarray, build: bool, told: str, tell: bool) -> list:
    counted = rows.mapInArrow(_count(model, k, edges, told), _ROW).groupBy("part")
    return counted.applyInArrow(_level_part(model, k, edges, build, told if tell else None), _META).collect()


def _learn(rows: DataFrame, order: int, room: int, told: str, ask: bool) -> Model:
    parts = max(1, rows.rdd.getNumPartitions())
    edges = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    model = Model(scratch_path(rows.sparkSession, "ngrams"), order, 0, 0, [])
    for k in range(1, order + 1):
        meta = _pass(rows, model, k, edges, True, told, ask or k < order)
        model.levels.append(_level(meta, edges, model.words))
        if k == 1:
            model.words = int(model.levels[0].bases[-1])
            model.tokens = sum(r["total"] for r in meta)
        if k < order:
            edges = _next_edges(meta, model.levels[-1], max(1, model.words), room)
    return model


def learn(docs: DataFrame, text: str = "text", order: int = ORDER, room: int = PART_TOKENS) -> Model:
    """Counts all n-grams of all texts and writes the levels."""
    return _learn(_rows(docs, text, F.lit(True)), order, room, scratch_path(docs.sparkSession, "told"), False)


def learn_and_score(docs: DataFrame, train: Column, text: str = "text", order: int = ORDER, room: int = PART_TOKENS) -> DataFrame:
    """``score`` of all ``docs`` under a model of those where ``train`` holds: what has to be found is asked for while
    the levels are built, in the same shuffles."""
    told = scratch_path(docs.sparkSession, "told")
    return _scored(docs, _learn(_rows(docs, text, train), order, room, told, True), text, told)


def _scores(model: Model, keys: np.ndarray, told: Told | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training count, log10 base probability, log10 probability) of each token."""
    walk = Walk(keys, model.words)
    node, counts, _ = find(model, 1, walk.ask(), told)
    count = counts[walk.again]
    walk.take(node)
    p = (count + 1) / (model.tokens + model.words + 1)
    base = np.log10(p)
    for k in range(2, len(model.levels) + 1):
        node, direct, back = find(model, k, walk.ask(), told)
        first = np.where(walk.word[walk.at] >= 0, direct[walk.again], 0)
        p[walk.at] = first + back[walk.again] * p[walk.at]
        walk.take(node)
    return count, base, np.log10(p)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model)."""
    told = scratch_path(docs.sparkSession, "told")
    rows = _rows(docs, text, F.lit(False))
    for k, level in enumerate(model.levels, 1):
        _pass(rows, model, k, level.edges, False, told, True)
    return _scored(docs, model, text, told)


def _scored(docs: DataFrame, model: Model, text: str, told: str) -> DataFrame:
    names = [f.split()[0] for f in RESULT.split(", ")]
    rest = without(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches, "_text"):
            keys, sizes = _block_tokens(rows, "_text")
            count, base, full = _scores(model, keys, Told(told, block))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.add.reduceat(x, bounds[:-1]) for x in ((count > 0).astype(np.int64), base, full)]
            at = 0
            for part in rows:
                own = slice(at, at := at + part.num_rows)
                results = [sizes[own], sums[0][own], np.full(part.num_rows, model.tokens), sums[1][own], sums[2][own]]
                kept = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *map(pa.array, results)], [*kept, *names])

    schema = T.StructType([*rest.schema.fields, *T.StructType.fromDDL(RESULT).fields])
    texts = F.coalesce(col(text).cast("string"), F.lit("")).alias("_text")
    return docs.select(*[col(c) for c in rest.columns], texts).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))
