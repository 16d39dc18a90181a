"""Held-out accuracy, the counting of n-grams, false-positive correction, hard texts."""

from zlib import crc32

import numpy as np
import pyarrow as pa

from redactflow.llm import language as lg
from redactflow.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op7_language_id"](spark, folder).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98


def plain_grams(text):
    data = bytes(lg._NORMAL[b] for b in (text or "").encode())
    padded = b" " + b" ".join(data.split(b" ")) + b" "
    while b"  " in padded:
        padded = padded.replace(b"  ", b" ")
    found = [padded[i : i + lg.WIDTH] for i in range(len(padded) - lg.WIDTH + 1)]
    return sorted(int.from_bytes(g, "big") for g in found if b" " not in g[1:-1])


def test_grams():
    texts = ["One two, THREE", None, "", "a", "ab", "Été 12 - où", "x" * 50, "   lone   "]
    owner, gram = lg._grams(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(gram[owner == i].tolist()) == plain_grams(t)


def test_hard_rows(spark):
    train = [("the cat and the dog are here", "en"), ("le chat et le chien sont ici", "fr"), (None, "en"), ("no language", None)]
    model = lg.learn(spark.createDataFrame(train, "text string, lang string"))
    assert model.langs == ["en", "fr"]
    rows = [(1, None), (2, ""), (3, "1234 !!"), (4, "the dog"), (4, "the dog"), (5, "chien"), (6, "zzzz qqqq"), (7, "É"), (8, "the cat " * 100_000)]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "id long, text string, score string")
    got = sorted((r["id"], r["lang_pred"], round(r["score"], 3)) for r in lg.predict(data, model).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "en", "en", "fr", model.fallback, model.fallback, "en"]
    assert [g[2] for g in got[:3]] == [0, 0, 0] and got[3][2] == 1
    odd = spark.createDataFrame([("the cat", "en"), ("12 3", "xx"), ("", "yy")], "text string, lang string").coalesce(1)
    assert lg.learn(odd).langs == ["en"]
    none = spark.createDataFrame([], "id long, text string, lang string")
    assert lg.predict(none, lg.learn(none)).count() == 0
    assert lg.predict(data, lg.learn(none)).select("lang_pred").distinct().first()[0] == "und"


def test_false_positives_are_taken_off():
    """A nearly full filter says yes to everything; corrected, it doesn't win."""
    rng = np.random.default_rng(0)
    slots = np.zeros((lg.SLOTS, 1), np.uint64)
    slots[rng.random(lg.SLOTS) < 0.99] |= np.uint64(1)
    text = "plain words of one language"
    _, gram = lg._grams(pa.array([text]))
    for probe in range(lg.PROBES):
        slots[lg._slots(gram, probe, lg.SLOTS), 0] |= np.uint64(2)
    rate = np.array([((slots[:, 0] >> np.uint64(i)) & np.uint64(1)).mean() ** lg.PROBES for i in (0, 1)])
    hits, n = lg._hits(lg.Filters(["full", "own"], slots, rate, "full"), pa.array([text]))
    assert hits[0, 1] > hits[0, 0] and n[0] == len(gram)
