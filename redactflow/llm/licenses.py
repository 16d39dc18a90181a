"""License scan: ordered signature rules behind a keyword test.

A text's words are intersected with the keywords of all rules; only rules whose keyword sets are all met are tried, on
the words joined by one blank. Detections are then taken in order of priority (longer first, then earlier, then the rule that stands first): one
that lies inside an accepted detection, or overlaps one, is suppressed. Base phrases are rules like the others, but
every place of them is reported, suppressed or not.

Null and empty texts have no words and no detections. Repeated rows are scanned each for itself. Input columns named
like a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from redactflow.llm.license_rules import Rule, rules
from redactflow.llm.table import col, without
from redactflow.llm.words import LOWER, SYMBOLS

_TABLE = bytes(0x20 if SYMBOLS[i] else int(LOWER[i]) for i in range(256))
DETECTION = "struct<label:string,rule:string,priority:int,start:bigint,end:bigint,base:boolean,kept:boolean>"
RESULT = f"n_words bigint, detections array<{DETECTION}>"


@lru_cache(1)
def _index() -> tuple[list[Rule], frozenset, dict[bytes, list[int]]]:
    """All rules, all keywords, and for each keyword of a rule's first set the rules it admits."""
    found = rules()
    admits: dict[bytes, list[int]] = {}
    for i, rule in enumerate(found):
        for word in rule.needs[-1]:
            admits.setdefault(word, []).append(i)
    words = frozenset(w for r in found for n in r.needs for w in n)
    return found, words, admits


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def detect(words: list[bytes]) -> list[tuple[Rule, int, int]]:
    """All matches of all admitted rules: (rule, first word, end word)."""
    found, keywords, admits = _index()
    held = keywords.intersection(words)
    tried = sorted({i for w in held for i in admits.get(w, ())})
    tried = [found[i] for i in tried if all(n & held for n in found[i].needs)]
    if not tried:
        return []
    plain, starts, out = b" ".join(words), None, []
    for rule in tried:
        for m in rule.pattern.finditer(plain):
            if starts is None:
                sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
                starts = np.cumsum(sizes) - sizes
            first = int(np.searchsorted(starts, m.start()))
            out.append((rule, first, int(np.searchsorted(starts, m.end()))))
    return out


def resolve(matches: list[tuple[Rule, int, int]]) -> list[bool]:
    """Which matches are accepted. Accepted intervals never overlap, so one look at the neighbours decides."""
    order = sorted(range(len(matches)), key=lambda i: (-matches[i][0].priority, matches[i][1] - matches[i][2], matches[i][1], i))
    kept, starts, ends = [False] * len(matches), [], []
    for i in order:
        _, start, end = matches[i]
        at = bisect_right(starts, start)
        if (at and ends[at - 1] > start) or (at < len(starts) and starts[at] < end):
            continue
        kept[i] = True
        starts.insert(at, start)
        ends.insert(at, end)
    return kept


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    detection = pa.list_(
        pa.struct(
            [("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("kept", pa.bool_())]
        )
    )
    for batch in batches:
        counts, found = [], []
        for text in batch.column("_text"):
            words = words_in(text.as_py())
            counts.append(len(words))
            matches = detect(words)
            found.append(
                [
                    {"label": r.label, "rule": r.name, "priority": r.priority, "start": a, "end": b, "base": r.base, "kept": k}
                    for (r, a, b), k in zip(matches, resolve(matches), strict=True)
                    if k or r.base
                ]
            )
        rest = [c for c in batch.schema.names if c != "_text"]
        arrays = [*[batch.column(c) for c in rest], pa.array(counts, pa.int64()), pa.array(found, detection)]
        yield pa.RecordBatch.from_arrays(arrays, [*rest, "n_words", "detections"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``detections``: accepted ones and all base phrases, places counted in words."""
    rest = without(docs, ["n_words", "detections"])
    schema = T.StructType([*rest.schema.fields, *T.StructType.fromDDL(RESULT).fields])
    return docs.select(*[col(c) for c in rest.columns], col(text).cast("string").alias("_text")).mapInArrow(_scan, schema)
