"""Edited texts, the order of neighbours, and collision rates against exact generalised Jaccard."""

from collections import Counter
from hashlib import sha256

import numpy as np

from redactflow.llm import fingerprints as fp
from redactflow.llm.queries import QUERIES


def jaccard(a, b):
    a, b = Counter(a.encode().split()), Counter(b.encode().split())
    top = sum(max(a[k], b[k]) for k in {*a, *b})
    return sum(min(a[k], b[k]) for k in a) / top if top else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        out.append((i, len(text), sha256(new.encode()).hexdigest(), new, text, after))
    return out


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op9_fingerprints"](spark, folder).collect()}
    want = expected(rows)
    assert len(got) == len(want)
    errors = []
    for i, n, digest, new, text, after in want:
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (n, digest)
        errors.append(got[i]["near_edited"] - jaccard(text, new))
        errors.append(got[i]["near_next"] - jaccard(text, after))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.07
    same = {}
    for _, _, _, _, text, _ in want:
        same.setdefault(text, set())
    for i, _, _, _, text, _ in want:
        same[text].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_hard_rows(spark):
    rows = [(5, "é😀 üb" * 9), (5, None), (None, "no id here"), (7, ""), (7, ""), (9, "long " * 90000), (-3, "x"), (12, "a a a b")]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string")
    got = sorted(map(tuple, fp.with_next(data, parts=3).select("doc_id", "n_chars", "edited_sha256").collect()), key=str)
    assert got == sorted([r[:3] for r in expected(rows)], key=str)


def test_one_and_none(spark):
    one = spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")
    r = fp.with_next(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == sha256(b"abcd efab").hexdigest()
    assert fp.with_next(one.limit(0)).count() == 0
    tags = fp.fingerprint(spark.createDataFrame([(None,), ("",)], "text string")).collect()
    assert {r["fingerprint"] for r in tags} == {"0" * 4 * fp.SAMPLES}


def test_long_texts_against_exact_jaccard():
    """60,000 different words a text: 64 samples are within 0.2 of the truth, and nothing in common is nothing alike."""
    words = [f"w{i}" for i in range(120_000)]
    texts = [" ".join(words[:60_000]), " ".join(words[60_000:]), " ".join(words[20_000:80_000]), " ".join(words[:60_000] + words[:30_000])]
    tags = fp.sample(texts)
    likeness = {(i, j): fp.likeness(tags[i], tags[j]) for i in range(4) for j in range(i)}
    assert likeness[1, 0] < 0.02 and likeness[3, 1] < 0.02
    assert all(abs(v - jaccard(texts[i], texts[j])) < 0.2 for (i, j), v in likeness.items())


def test_kept_draws_change_nothing(monkeypatch):
    texts = ["a b c a b a", " ".join(f"v{i % 700}" for i in range(1000)), "x"]
    want = fp.sample(texts)
    for room in (0, 5, 300):
        monkeypatch.setattr(fp, "KEPT", room)
        fp._kept.cache_clear()
        assert (fp.sample(texts) == want).all()
    fp._kept.cache_clear()
