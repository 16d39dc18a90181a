"""Base phrases against a plain search, suppression, gates and hard texts."""

import re

import pytest

from redactflow.llm import license_rules, licenses
from redactflow.llm.license_rules import PHRASES, rules
from redactflow.llm.queries import QUERIES


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), places


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op2_licenses"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        n, places = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        at = [i for i, _ in places]
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def kept(text):
    matches = licenses.detect(licenses.words_in(text))
    return sorted(r.label for (r, _, _), k in zip(matches, licenses.resolve(matches), strict=True) if k)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", ["apache-2"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa"]),
        ("SPDX-License-Identifier: MPL-2.0", ["mpl-2"]),
        ("Released under the MIT License. All rights reserved.", ["all-rights-reserved", "mit"]),
        ("wir gehen mit dem Hund", []),
        ("permit the license", []),
        ("", []),
    ],
)
def test_statements(text, labels):
    assert kept(text) == labels


def test_gates_never_lose_a_match():
    """Every rule whose pattern matches a text is tried on it."""
    texts = [
        f"x {f} y"
        for f in ("licensed under the gnu gpl v2 license", "spdx license identifier bsl 1 0", "license cc by sa 4 0", "mit license", "placed into the public domain")
    ]
    for text in texts:
        words = text.encode().split()
        tried = {r.name for r, _, _ in licenses.detect(words)}
        assert tried == {r.name for r in rules() if r.pattern.search(text.encode())}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: Python-2.0", ["psf-2"]),
        ("license: llama2", ["llama"]),
        ("license: llama3", ["llama"]),
        ("licensed under MS-PL", ["ms-pl"]),
        ("licensed under MS-RL", ["ms-rl"]),
        ("Do What The Fuck You Want To Public License", ["wtfpl"]),
        ("Public Domain Dedication and License", ["pddl"]),
    ],
)
def test_alternatives_pass_their_gates(text, labels):
    assert kept(text) == labels


def test_every_spelling_passes_its_gate():
    """For every rule, spellings in which each alternative of its pattern occurs."""
    forms = {f: sorted(license_rules.spellings(re.sub("{[ni]}", "NAME", around).replace("{l}", "").replace("{v}", "").replace(r"\d", "2"))) for f, _, around, _ in license_rules.FORMS}
    names = {label: (name, short) for label, name, short in license_rules.FAMILIES}
    tried = 0
    for rule in rules():
        form, label = rule.name.split(":")
        if form in forms:
            inner = license_rules.spellings(names[label][form not in ("granted", "offered", "named")])
            texts = [f.replace("NAME", x) for f in forms[form] for x in inner]
        else:
            pattern = next((p for a, _, p, _ in license_rules.STATEMENTS if form == "statement" and a == label), None)
            pattern = pattern.replace(r"\d{4}", "1999") if pattern else next(p for p, a in PHRASES if a == label)
            texts = license_rules.spellings(pattern)
        for text in texts:
            if rule.pattern.search(text.encode()):
                tried += 1
                held = set(text.encode().split())
                assert all(n & held for n in rule.needs), (rule.name, text)
    assert tried > 10_000


def test_hundreds_of_rules():
    assert len(rules()) > 300 and len({r.name for r in rules()}) == len(rules())


def test_hard_rows(spark):
    long = "cc by nc " * 20000
    rows = [(1, None, 5), (2, "", 5), (3, "É" * 50000, 5), (4, long, 5), (4, long, 5), (None, "under the mit license", 5)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int"))
    got = [(r["doc_id"], r["n_words"], sum(d["base"] for d in r["detections"])) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 60000, 20000), (4, 60000, 20000), (None, 4, 1)], key=str)
    assert licenses.scan(spark.createDataFrame([], "text string")).count() == 0
