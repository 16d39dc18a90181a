"""Language identification with bit-sliced Bloom filters of byte n-grams.

Learning counts the n-grams of each language over all training texts. A language's filter holds the n-grams whose
share in it is at least ``RATIO`` of their share in any language and at least ``MIN_SHARE``; so a language can have at
most ``1 / MIN_SHARE`` n-grams, and what goes to the driver and to every task is bounded whatever the corpus is.
All filters share one slot table: the word at a slot has one bit for each language, and the AND of an n-gram's
slots is the set of languages that contain it. A text's hits per language are popcounts of those sets, corrected for
each filter's own false-positive rate; the language with the most corrected hits is predicted.

Null text or text without a letter: ``und``, score 0. Equal hits: the language first in code point order. Nothing
learned (no labelled row): ``und``. Repeated rows are predicted each for itself. Input columns named like a result
column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactflow.llm.table import boxed, col, unboxed, without
from redactflow.llm.words import LOWER, chunks, mix, text_bytes
from redactflow.session import cut_lineage

WIDTH = 4
RATIO = 0.4
MIN_SHARE = 1e-5
SLOTS = 1 << 21
PROBES = 3
UNKNOWN = "und"
#: A text in which fewer n-grams than this share belong to its language is not text of a known language.
MIN_COVERAGE = 0.05
RESULT = "lang_pred string, score double, coverage double"
_LETTER = re.compile(r"[^\W\d_]")
_NORMAL = LOWER.copy()
_NORMAL[[i for i in range(0x80) if not chr(i).isalpha()]] = 0x20


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, n-gram) of all n-grams; each text stands between blanks, runs of blanks count once."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    wide = np.full(len(data) + n + 1, 0x20, np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    wide[np.arange(len(data)) + owner + 1] = _NORMAL[data]
    text = np.zeros(len(wide), np.int32)
    text[np.arange(len(data)) + owner + 1] = owner
    blank = wide == 0x20
    text[offsets[:-1] + np.arange(n)] = np.arange(n)  # the blank in front of a text belongs to it
    keep = np.ones(len(wide), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    wide, text = wide[keep].astype(np.uint32), text[keep]
    m = len(wide) - WIDTH + 1
    if m <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    gram = np.zeros(m, np.uint32)
    for i in range(WIDTH):
        gram = (gram << np.uint32(8)) | wide[i : i + m]
    # an n-gram over the blank between two texts belongs to neither
    whole = np.ones(m, bool)
    inner = wide == 0x20
    for i in range(1, WIDTH - 1):
        whole &= ~inner[i : i + m]
    return text[:m][whole], gram[whole]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language of one task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        for part in chunks(batch, "text"):
            langs = part.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy()
            text, gram = _grams(part.column("text"))
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.unique(gram[codes[text] == code], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append(own)
                if len(parts) > 8:
                    held[lang] = [merged(parts)]
    for lang, parts in held.items():
        grams, n = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
        )


@dataclass
class Filters:
    """``slots[i, w]``: languages 64w to 64w+63 that set slot ``i``; ``false_rate``: of each language."""

    langs: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    fallback: str


def _slots(gram: np.ndarray, probe: int, size: int) -> np.ndarray:
    return (mix(gram.astype(np.uint64) + np.uint64(probe << 40)) & np.uint64(size - 1)).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all rows with a language and a text."""
    rows = docs.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # one row per n-gram: its counts in all languages side by side, so the largest share needs no second shuffle
    per_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    per_gram = cut_lineage(per_gram, "grams")
    each = per_gram.select("gram", F.explode("by").alias("x")).select("gram", "x.lang", "x.n")
    totals = {r["lang"]: r["n"] for r in each.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: x.encode())
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(1.0 / totals[k]))]) if langs else None
    if share is None:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), UNKNOWN)
    scored = per_gram.withColumn("by", F.transform("by", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] * share[x["lang"]]).alias("s"))))
    best = F.array_max(F.transform("by", lambda x: x["s"]))
    kept = F.filter("by", lambda x: (x["s"] >= F.lit(MIN_SHARE)) & (x["s"] >= best * RATIO))
    # at most 1 / MIN_SHARE rows for each language
    rows = scored.select("gram", F.transform(kept, lambda x: x["lang"]).alias("langs")).filter(F.size("langs") > 0).collect()
    number = {k: i for i, k in enumerate(langs)}
    slots = np.zeros((SLOTS, (len(langs) + 63) // 64), np.uint64)
    grams = np.array([r["gram"] for r in rows], np.int64)
    for k, i in number.items():
        own = grams[np.array([k in r["langs"] for r in rows], bool)] if len(rows) else grams
        for probe in range(PROBES):
            slots[_slots(own, probe, SLOTS), i // 64] |= np.uint64(1 << (i % 64))
    fill = np.array([((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Filters(langs, slots, fill**PROBES, max(langs, key=lambda k: (totals[k], k)))


def _hits(model: Filters, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Corrected hits [text, language] and the number of n-grams of each text."""
    text, gram = _grams(column)
    n = np.bincount(text, minlength=len(column)).astype(float)
    raw = np.zeros((len(column), len(model.langs)))
    at = [_slots(gram, probe, len(model.slots)) for probe in range(PROBES)]
    for w in range(model.slots.shape[1]):
        sets = model.slots[at[0], w]
        for more in at[1:]:
            sets &= model.slots[more, w]
        for i in range(64 * w, min(64 * w + 64, len(model.langs))):
            bit = (sets >> np.uint64(i % 64)) & np.uint64(1)
            raw[:, i] = np.bincount(text, bit.astype(np.float32), minlength=len(column))
    fixed = (raw - n[:, None] * model.false_rate) / (1 - model.false_rate)
    return np.clip(fixed, 0, None), n


def predict(docs: DataFrame, model: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the winner's share of all corrected hits) and ``coverage``
    (the share of the text's n-grams that belong to the winner)."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS words: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in chunks(batch, "_text"):
                column = part.column("_text")
                known = np.array([bool(_LETTER.search(t or "")) for t in column.to_pylist()], bool)
                pred = np.full(len(column), UNKNOWN, object)
                score, cover = np.zeros(len(column)), np.zeros(len(column))
                if m.langs:
                    hits, n = _hits(m, column)
                    best, total = hits.max(axis=1), hits.sum(axis=1)
                    some = known & (total > 0)
                    pred[known] = m.fallback
                    pred[some] = np.array(m.langs, object)[hits.argmax(axis=1)][some]
                    score[some] = best[some] / total[some]
                    cover[some] = np.minimum(1, best[some] / n[some])
                kept = [c for c in part.schema.names if c != "_text" or text == "_text"]
                arrays = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(pred, pa.string()), pa.array(score), pa.array(cover)], [*kept, *names])

    rest = without(docs, names)
    schema = T.StructType([*rest.schema.fields, *T.StructType.fromDDL(RESULT).fields])
    source = docs if text == "_text" else docs.select(*[col(c) for c in rest.columns], col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, schema)


def of_known_language(docs: DataFrame, model: Filters) -> DataFrame:
    """The rows whose text is of a learned language, with the columns of ``docs``."""
    judged = predict(boxed(docs, _text=F.col("text").cast("string")), model, "_text")
    return unboxed(judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("coverage") >= MIN_COVERAGE)))


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that learning never sees: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
