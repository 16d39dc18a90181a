"""Document fingerprints by consistent weighted sampling (gamma-based, Ioffe 2010).

A text is a weighted set: its words by their 64-bit keys, each weighing as often as it occurs. For each of ``SAMPLES``
samples and each word, r and c are Gamma(2, 1) and b is uniform, hashed from the key, the sample and the seed. With
t = floor(ln w / r + b), the word with the least ln c - r (t - b) - r is the sample; two texts draw the same (word, t)
with a probability equal to their generalised Jaccard similarity, sum of least weights over sum of greatest.

Each Python worker keeps the draws of the first ``KEPT`` words it meets and hashes those of all others as they come;
both give the same. A fingerprint is a hex string of SAMPLES 16-bit tags of (word, t); texts that draw different pairs
share a tag once in 65536 samples.

Null and empty texts have no words: their fingerprint is all zeros, its likeness to an equal one is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.llm.table import col
from redactflow.llm.words import mix, words_of

KEPT = 1 << 15
SAMPLES = 64
SEED = 9
#: Rows are handled in groups of about this many code points.
GROUP_CHARS = 1 << 20
#: Words drawn for at once.
BLOCK = 1 << 12


_COUNTERS = mix(np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) + np.uint64(SEED << 32)).reshape(3, SAMPLES)


def _drawn(keys: np.ndarray) -> np.ndarray:
    """r, b, ln c - r, and the value for weight 1, each [word, sample]."""

    def bits(i: int) -> np.ndarray:
        return mix(keys[:, None] ^ _COUNTERS[i])

    def gamma(x: np.ndarray) -> np.ndarray:
        """Gamma(2, 1) is the sum of two exponentials."""
        return -np.log(((x >> np.uint64(32)) + 0.5) * 2.0**-32 * (((x & np.uint64(0xFFFFFFFF)) + 0.5) * 2.0**-32))

    r, b = gamma(bits(0)), (bits(1) >> np.uint64(40)) * 2.0**-24
    cr = np.log(gamma(bits(2))) - r
    # weight 1: ln w = 0, so t = floor(b) = 0
    return np.stack([r, b, cr, cr + r * b]).astype(np.float32)


class _Kept:
    """Draws of up to ``KEPT`` words; ``keys`` in order, ``slots`` where each has its row."""

    def __init__(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows = np.zeros((4, KEPT, SAMPLES), np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each of these different words, -1 for those not kept, after keeping what there is room for."""
        out = self._find(keys)
        n = len(self.keys)
        new = keys[out < 0][: KEPT - n]
        if len(new):
            for a in range(0, len(new), BLOCK):
                part = new[a : a + BLOCK]
                self.rows[:, n + a : n + a + len(part)] = _drawn(part)
            self.keys, self.slots = np.append(self.keys, new), np.append(self.slots, np.arange(n, n + len(new)))
            order = np.argsort(self.keys)
            self.keys, self.slots = self.keys[order], self.slots[order]
            out = self._find(keys)
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)


@lru_cache(1)
def _kept() -> _Kept:
    return _Kept()


def _draw(keys: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The tags of one weighted set."""
    all_rows, columns = _kept().rows, np.arange(SAMPLES)
    least, word, at_t = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    for held in (True, False):
        chosen = np.flatnonzero((slots >= 0) == held)
        for start in range(0, len(chosen), BLOCK):
            own = chosen[start : start + BLOCK]
            if held:
                rows, at = all_rows, slots[own]
            else:
                rows, at = _drawn(keys[own]), np.arange(len(own))
            r, b, cr, ones = rows
            value = ones[at]
            t = np.zeros(value.shape, np.float32)
            more = np.flatnonzero(weights[own] > 1)
            if len(more):
                place = at[more]
                log_w = np.log(weights[own[more]]).astype(np.float32)[:, None]
                t[more] = np.floor(log_w / r[place] + b[place])
                value[more] = cr[place] - r[place] * (t[more] - b[place])
            best = value.argmin(axis=0)
            found, key = value[best, columns], keys[own[best]]
            # of equal values the smaller key, whatever is kept
            better = (found < least) | ((found == least) & (key < word))
            least[better], word[better], at_t[better] = found[better], key[better], t[best, columns][better]
    return (mix(mix(word) + at_t.astype(np.int64).astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)


def sample(texts: list[str]) -> np.ndarray:
    """[text, sample] tags."""
    words = words_of(pa.array(texts, pa.large_string()))
    text = np.repeat(np.arange(len(texts), dtype=np.int64), words.counts())
    distinct, term = np.unique(words.keys, return_inverse=True)
    n = max(1, len(distinct))
    pair, weights = np.unique(text * n + term, return_counts=True)
    bounds = np.searchsorted(pair, np.arange(len(texts) + 1) * n)
    slots = _kept().find(distinct)
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            own = pair[a:b] % n
            out[i] = _draw(distinct[own], slots[own], weights[a:b])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=-1)


def _hex(tags: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in tags]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) first ones of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "_text"]
            arrays = [*[batch.column(c) for c in rest], pa.array(_hex(sample(texts)), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*rest, "fingerprint"])

    kept = [c for c in docs.columns if c.lower() != "fingerprint"]
    source = docs.select(*[col(c) for c in kept], col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, docs.select(*[col(c) for c in kept]).withColumn("fingerprint", F.lit("")).schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order, each followed by its next document; rows with ``carry`` only follow."""
    held: list[tuple] = []

    def result(last: tuple) -> pa.RecordBatch:
        rows = [r for r in held if not r[3]]
        texts = [r[2] for r in held]
        after = texts[1:] + [last[2]]
        pairs = [(r, edited(r[2], n)) for r, n in zip(held, after, strict=True) if not r[3]]
        tags = sample([*texts, last[2]])
        own = np.array([i for i, r in enumerate(held) if not r[3]], np.int64)
        new = sample([e for _, e in pairs])
        columns = [
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([len(r[2]) for r in rows], pa.int64()),
            pa.array([sha256(e.encode()).hexdigest() for _, e in pairs], pa.string()),
            pa.array(_hex(tags[own]), pa.string()),
            pa.array(_hex(new), pa.string()),
            pa.array(likeness(tags[own], new)),
            pa.array(likeness(tags[own], tags[own + 1])),
        ]
        return pa.RecordBatch.from_arrays(columns, NEIGHBOUR_NAMES)

    size = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            # a row that only follows ends its run: what comes next belongs to another part of the order
            if held and (size > GROUP_CHARS or row[3]):
                yield result(row)
                held, size = [], 0
            if not row[3]:
                held.append(row)
                size += len(row[2])


NEIGHBOUR_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
NEIGHBOUR_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document's, and their likeness.

    Next is the following row by (doc_id, text), null ids first; after the last comes the first. Texts are shuffled
    once, by ranges of doc_id; the first row of each range goes to the range before it as well, so a document's next
    one is always in its partition.
    """
    spark = docs.sparkSession
    rows = docs.select(
        col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("ord"),
    )
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # one id for each partition goes to the driver, here and below
    cuts = rows.approxQuantile("ord", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    placed = rows.withColumn("part", F.expr(_bisect(cuts, 0, len(cuts))))
    firsts = sorted((r["part"], r["first"]) for r in placed.groupBy("part").agg(F.min("ord").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    goes = F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<bigint,bigint>")
    own = F.struct(F.col("part").cast("int").alias("to"), F.lit(False).alias("carry"))
    carried = F.struct(goes[F.col("ord")].cast("int").alias("to"), F.lit(True).alias("carry"))
    sent = placed.select("ord", "doc_id", "text", F.explode(F.filter(F.array(own, carried), lambda x: x["to"].isNotNull())).alias("x"))
    dealt = sent.select("ord", "doc_id", "text", "x.carry", "x.to").repartitionById(n, F.col("to"))
    return dealt.sortWithinPartitions("carry", "ord", "text").select("ord", "doc_id", "text", "carry").mapInArrow(_compare, NEIGHBOUR_SCHEMA)


def _bisect(cuts: list[int], lo: int, hi: int) -> str:
    """SQL for the number of cuts at or below ord, as nested comparisons."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"CASE WHEN ord >= {cuts[mid]} THEN {_bisect(cuts, mid + 1, hi)} ELSE {_bisect(cuts, lo, mid)} END"
