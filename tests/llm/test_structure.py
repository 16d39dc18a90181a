"""Repairs against an exhaustive search, in one segment and in many, on hard tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from redactflow.llm import grammar, structure

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """turns: (role, text, must go, truncated). Least (cost, audit) and the repaired lines, by trying everything."""

    @lru_cache(None)
    def go(i, state, row):
        ways = []
        if i == len(turns) and state in ("", "a"):
            ways.append((0, "", ()))
        if row < 3:
            for c in "ua":
                if (state, c) in MOVES and (rest := go(i, MOVES[state, c], row + 1)):
                    ways.append((5 + rest[0], "I" + rest[1], (f"{NAMES[c]}:", *rest[2])))
        if i < len(turns):
            role, text, gone, open_ = turns[i]
            if rest := go(i + 1, state, 0):
                ways.append((2 + rest[0], "D" + rest[1], rest[2]))
            for c, cost, letter, name in () if gone else ((role[:1], 0, "K", role), ("u", 1, "R", "user"), ("a", 1, "R", "assistant")):
                if (state, c) in MOVES and (rest := go(i + 1, MOVES[state, c], 0)):
                    ways.append((cost + 5 * open_ + rest[0], letter + rest[1], (f"{name}:{text}", *rest[2])))
        return min(ways, default=None)

    return go(0, "", 0)


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation."""
    tidy = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    tidy.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in tidy:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in tidy if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(tidy, tidy[1:], strict=False))
    cost, audit, lines = cheapest(tuple((r, x, f in ("blank", "duplicate"), f == "truncated") for (_, r, x), f in zip(tidy, faults, strict=True)))
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), "\n".join(lines)


def conversation(rng, n):
    texts = ["Hello there.", "What?", "I see", "", " \n", "Yes!", None, "over ", "Fine. \n", "né"]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "User"]
    rows, turn = [], 0
    for _ in range(n):
        turn += rng.choice([0, 1, 1, 1, 3])
        rows.append((rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.randint(0, 99)}."))
        if rng.random() < 0.15:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_grammar_against_exhaustive_search(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(grammar.SYMBOLS if seed % 2 else "uuuaaasx") for _ in range(rng.randint(0, 14))) for _ in range(80)]
    rows, matrices = grammar.transfer(texts, whole=False), grammar.transfer(texts, whole=True)
    for text, row, m in zip(texts, rows, matrices, strict=True):
        want = cheapest(tuple((c.lower(), "", c == "x", c.isupper()) for c in text))
        assert grammar.closed(row) == grammar.closed(m[0]) == want[:2]


def test_grammar_of_long_and_shared_sequences():
    left, rules = grammar.re_pair([[0, 1] * 512, [0, 1] * 512, [2]], 3)
    assert left[0] == left[1] and len(left[0]) == 1 and left[2] == [2] and len(rules) == 10
    text = "ua" * 3000 + "a"
    assert grammar.closed(grammar.transfer([text], whole=False)[0]) == (2, "K" * 5999 + "DK")


@pytest.mark.parametrize("size", [0, 5, 200])
def test_ropes_compare_like_their_texts(size):
    rng = random.Random(size)

    def rope(text):
        leaves = re.findall("I*[^I]", text)
        if len(leaves) <= 1:
            return grammar.Rope(None, None, text)
        k = sum(map(len, leaves[: rng.randint(1, len(leaves) - 1)]))
        return grammar.Rope(rope(text[:k]), rope(text[k:]), None)

    for _ in range(100):
        head = "".join(rng.choice(["D", "K", "IK", "R"]) for _ in range(size))
        a, b = (head + "".join(rng.choice(["D", "K", "IIR"]) for _ in range(3)) for _ in range(2))
        assert grammar.less(rope(a), rope(b)) == (a < b) and str(rope(a)) == a


@pytest.mark.parametrize("segment", [1024, 4, 1])
def test_repair(spark, segment):
    rng = random.Random(segment)
    talks = {i: conversation(rng, rng.randint(1, 12)) for i in range(40)} | {None: conversation(rng, 5), 100: conversation(rng, 60), 101: [(3, "user", "Same.")] * 9}
    rows = [(i, *r, "x", 1) for i, talk in talks.items() for r in talk]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, seq int").repartition(6)
    found = structure.repair(frame, segment=segment, fan=3)
    got = {r["conv_id"]: tuple(r)[1:] for r in found.summary.collect()}
    pieces = {}
    for r in found.pieces.orderBy("conv_id", "piece").collect():
        pieces.setdefault(r["conv_id"], []).append(r["text"])
    assert got.keys() == talks.keys()
    for i, talk in talks.items():
        want, text = plain_repair(talk)
        assert got[i] == want, (i, talk)
        assert "\n".join(pieces.get(i, [])) == text


def test_damage_and_conversations_that_vanish(spark):
    rows = [(i, t, ["user", "assistant"][t % 2], f"Turn {t} of {i}. ") for i in range(30) for t in range(6)] + [(i, 0, "user", "Alone.") for i in range(100, 160)]
    rows += [(None, None, None, None)]
    got = {r["conv_id"]: tuple(r)[1:] for r in structure.repair_damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    after = {}
    for i, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after.setdefault(i, []).extend([(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    assert any(not talk for talk in after.values())
    for i, talk in after.items():
        assert got.pop(i) == (plain_repair(talk)[0] if talk else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
    assert not got


def test_empty_table(spark):
    assert structure.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 1_000_000)]
    got = structure.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).summary.first()
    assert (got["cost"], got["audit"], got["truncated"]) == (4, "DD", 1)
