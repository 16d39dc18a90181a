"""Base spans against plain regular expressions, contexts on planted identifiers, hard texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from redactflow.llm import pii
from redactflow.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


HARD = [
    None,
    "",
    "a@b.c-x_y@d.ee.f a@b.c@d.e x@y",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3.4000",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111111111 4111  1111 1111 1111",
    "+1 (988) 555-2485. +1 2 3 +4 +12345678 +1234567890123456",
    "éü😀 me@x.org 😀+49 30 1234567 é1.2.3.4",
    "a" * 20000 + "@x.org",
    "1" * 20000 + " 1.2.3",
    "1 " * 20000,
    "." * 5000 + "@" * 5000,
    "x@" + "a." * 5000,
    "+" + "()" * 10000 + "1",
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(HARD)] + [(2, HARD[2], "again", None), (None, "q@r.st", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string, value string")


def test_base_spans(spark, hard):
    got = pii.personal_data(hard).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()
    assert len(got) == len(HARD) + 2
    for r in got:
        text = HARD[r["doc_id"]] if r["doc_id"] is not None else "q@r.st"
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op10_pii"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert r["spans"].startswith(listed)


def planted(spark):
    rows = [(i, f"the mail reach me: user{i}@x.org and more") for i in range(8)]
    rows += [(100 + i, f"reach me: K{i}-77{i}31 now") for i in range(1)]
    rows += [(200 + i, f"badge no. K0-77031, or badge no. user{i}@x.org") for i in range(6)]
    rows += [(300, "badge no. ZZ-9981 here"), (301, "page 12345 of 99999")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_find_unseen_values(spark):
    got = {r["doc_id"]: r["s"] for r in pii.personal_data(planted(spark)).select("doc_id", pii.listed(F.col("extra")).alias("s")).collect()}
    # "reach me:" has 8 known of 9 instances: not yet enough; "badge no." neither
    assert got[301] == ""
    more = planted(spark).unionByName(
        spark.createDataFrame([(400 + i, f"please reach me: other{i}@y.org") for i in range(20)], "doc_id long, text string")
    ).unionByName(spark.createDataFrame([(500 + i, f"badge no. one{i}@z.org") for i in range(20)], "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in pii.personal_data(more).select("doc_id", pii.listed(F.col("extra")).alias("s")).collect()}
    assert got[100] == "id:10:18"  # K0-77031 after a pattern with 28 of 29 known
    assert got[200].startswith("id:10:18")  # and wherever else it stands
    assert got[300] == "id:10:17"  # found through "badge no."
    assert got[301] == ""


CARDS = [f"4111 1111 11{i:02} 11{j}" for i in range(10) for j in [next(j for j in range(10, 100) if luhn(f"4111111111{i:02}11{j}"))]]


def test_spaced_phones_and_cards_are_seeds(spark):
    """No seed is a token: every one is a phone or a card written with blanks."""
    assert all(luhn(c.replace(" ", "")) for c in CARDS)
    texts = [f"call me at +1 (743) 555-38{i}4" for i in range(10)] + [f"or fon=+49 30 12345{i}7 please" for i in range(10)]
    texts += [f"billed to card {c} today" for c in CARDS]
    asked = ["call me at EXT99-1234", "or fon=X-20417 please", "billed to card VX-88123 today", "page 12345 of 99999", "seen EXT99-1234"]
    docs = spark.createDataFrame(list(enumerate([*texts, *asked])), "doc_id long, text string")
    got = [r["s"] for r in pii.personal_data(docs).select("doc_id", pii.listed(F.col("extra")).alias("s")).orderBy("doc_id").collect()]
    assert got == [""] * len(texts) + ["id:11:21", "id:7:14", "id:15:23", "", "id:5:15"]
    masked = [r["text"] for r in pii.mask(docs).orderBy("doc_id").collect()][len(texts) :]
    assert masked == ["call me at [ID]", "or fon=[ID] please", "billed to card [ID] today", "page 12345 of 99999", "seen [ID]"]


def test_patterns_of_spans_are_those_of_tokens(spark):
    fronts = ["call me at ", "call me at (", "my tel:", "my tel:(", "a std::", "x (=", "x y = ", "http://", "A  1b\t", "one ", "", "é ü <", "k=-:"]
    docs = spark.createDataFrame([(i, f + "+4930123456") for i, f in enumerate(fronts)], "doc_id long, text string")
    _, entities = pii.places(docs)
    found = {}
    for r in entities.collect():
        found.setdefault(r["_row"], {})[r["kind"]] = (r["start"], r["pattern"])
    assert len(found) == len(fronts) and all(f["phone"] == f["token"] for f in found.values())


def test_mask(spark):
    rows = spark.createDataFrame([(0, "write a@b.org, 4111 1111 1111 1111 or 10.0.0.1", 1), (1, None, 2), (2, "", 3)], "doc_id long, text string, n int")
    out = {r["doc_id"]: r["text"] for r in pii.mask(rows).collect()}
    assert out == {0: "write [EMAIL], [CARD] or [IP]", 1: None, 2: ""}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(none).count() == 0 and pii.mask(none).count() == 0
