"""Linking, order, validation and canonical form on hand-made conversations."""

import json

from redactflow.llm.toolcalls import link

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False)}, "say": {"text": ("string", True), "opts": ("object", False)}}


def call(body):
    return f"<tool_call>{body if isinstance(body, str) else json.dumps(body)}</tool_call>"


def result(i, content):
    return f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"


def linked(spark, rows, extra=False):
    cols = "conv_id long, turn long, role string, text string" + (", id string, level int" if extra else "")
    data = spark.createDataFrame([(*r, "clash", 9) if extra else r for r in rows], cols)
    return {(r["conv_id"], r["position"]): r for r in link(data, SCHEMAS).collect()}


def test_order_and_canonical_json(spark):
    rows = [
        (1, 0, "assistant", "x " + call({"id": "c", "name": "say", "arguments": {"text": "z\n\"é/", "opts": {"b": 1.50, "a": [1, {"y": 1, "x": 2}]}}, "after": ["b"]})),
        (1, 1, "assistant", call({"id": "b", "name": "add", "arguments": {"b": 2, "a": 1}, "after": ["a"]}) + call({"id": "a", "name": "add", "arguments": {"a": 7}})),
        (1, 2, "tool", result("a", {"v": 7}) + result("b", 3)),
        (1, 3, "tool", result("c", None) + result("a", "later")),
    ]
    got = linked(spark, rows, extra=True)
    assert [got[1, i]["id"] for i in (1, 2, 3)] == ["a", "b", "c"]
    assert [got[1, i]["level"] for i in (1, 2, 3)] == [0, 1, 2]
    assert got[1, 1]["json"] == '{"arguments":{"a":7},"id":"a","name":"add","result":{"v":7}}'
    assert got[1, 2]["json"] == '{"arguments":{"a":1,"b":2},"id":"b","name":"add","result":3}'
    assert got[1, 3]["json"] == '{"arguments":{"opts":{"a":[1,{"x":2,"y":1}],"b":1.5},"text":"z\\n\\"é/"},"id":"c","name":"say","result":null}'
    assert (got[1, 1]["n_results"], got[1, 1]["result_turn"], got[1, 1]["valid"]) == (2, 2, True)


def test_problems(spark):
    rows = [
        (1, 0, "assistant", call("{broken") + call([1]) + call({"name": "add"}) + "<tool_call>{never closed"),
        (1, 1, "assistant", call({"id": "x", "name": "add", "arguments": {"a": "1", "zz": 1}}) + call({"id": "x", "name": "add", "arguments": {"a": 1}})),
        (1, 2, "assistant", call({"id": "p", "name": "nope", "arguments": {}, "after": ["q"]}) + call({"id": "q", "name": "add", "arguments": 5, "after": ["p"]})),
        (1, 3, "assistant", call({"id": "r", "name": "add", "arguments": {"b": True}, "after": ["gone", "gone"]})),
        (1, 4, "assistant", None),
        (1, 5, "tool", None),
        (2, 0, "assistant", ""),
    ]
    got = linked(spark, rows)
    by_id = {}
    for r in got.values():
        by_id.setdefault(r["id"], []).append(r["problems"])
    assert by_id[None] == ["malformed; no result"] * 3
    assert sorted(by_id["x"]) == ["duplicate id; no result", "not integer: a; unexpected zz; no result"]
    assert by_id["p"] == ["unknown tool; cycle; no result"] and by_id["q"] == ["no arguments; cycle; no result"]
    assert by_id["r"] == ["missing a; not number: b; unknown call; no result"]
    assert {c for c, _ in got} == {1} and len(got) == 8


def test_repeated_rows_long_texts_and_null_ids(spark):
    one = (1, 0, "assistant", "y" * 300_000 + call({"id": "k", "name": "say", "arguments": {"text": "w" * 200_000}}) * 2000)
    rows = [one, one, (None, 0, "assistant", call({"id": "k", "name": "add", "arguments": {"a": 1}})), (1, 1, "tool", result("k", 1))]
    got = linked(spark, [(c, t, r, x[:900_000] if x.startswith("y") else x) for c, t, r, x in rows])
    own = [r for (c, _), r in got.items() if c == 1]
    assert len(own) == 4 and sum("duplicate id" in r["problems"] for r in own) == 3
    assert got[None, 1]["id"] == "k"


def test_empty(spark):
    assert linked(spark, []) == {}
