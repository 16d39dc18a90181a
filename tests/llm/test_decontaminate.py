"""Hits against a plain search on hand-made cases; the query is compared with SQL in test_queries."""

import re

from redactflow.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(dc.WIDTH, len(w))
        for k in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i % 37}x{i % 11}" for i in range(60))
ITEMS = [
    (1, LONG), (2, "Short item"), (3, "one"), (4, None), (5, ""), (6, "a b c d e f g h i j k"), (6, "B C d e F g h I j k"), (7, "a b c d e f g h i j"),
    (None, "no id item here"), (8, "é ü ß"), (9, "the the the the the the the the the the the the"), (2, "Short item"),
]
DOCS = [
    (1, "prefix " + LONG + " suffix"), (2, "x " + " ".join(LONG.split()[5:15]) + " y " + " ".join(LONG.split()[20:29])), (3, None), (4, ""), (5, "a SHORT, item! and one"),
    (5, "a SHORT, item! and one"), (6, "a b c d e f g h i j k l"), (7, "É ü ß é ü ß"), (8, "the " * 5000), (9, "word " * 60_000 + "one"), (None, "short item"), (10, "shortitem"),
]


def test_against_plain_search(spark):
    docs = spark.createDataFrame([(*d, "clash", 1) for d in DOCS], "doc_id long, text string, items string, key int")
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, n int")
    got = sorted(map(tuple, dc.judge(docs, items).select("doc_id", "n_words", "n_hit", "items").collect()), key=str)
    assert got == plain(DOCS, ITEMS)
    clean = dc.clean(docs, items)
    assert clean.columns == docs.columns
    want = sorted((d[0] for d, r in zip(sorted(DOCS, key=lambda d: str((d[0], len(words(d[1]))))), plain(DOCS, ITEMS), strict=True) if r[2] == 0), key=str)
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    got = dc.judge(docs, items).collect()
    assert len(got) == len(DOCS) and not any(r["n_hit"] for r in got)
    assert dc.judge(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
