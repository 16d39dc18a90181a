"""Tool-call linking in conversations. DataFrame functions only.

Assistant messages carry calls, ``<tool_call>{"id": ..., "name": ..., "arguments": {...}, "after": [ids]}</tool_call>``,
tool messages carry results, ``<tool_result>{"id": ..., "content": ...}</tool_result>``, any number in a message.
Calls and results meet in a join on conversation and identifier. Calls are ordered topologically by ``after``, level by
level; inside a level by turn and place. Arguments are checked against a schema for each tool; call and result are
written as JSON of one form: keys in code point order at every depth, no blanks. Numbers keep the form Spark gives them, so equal
numbers written differently (1e3, 1000.0, 1000) may stay different, and 1000.0 is no integer to a schema.

A conversation may hold any share of the rows: joins are on conversation and identifier, results are reduced to the
first one before the join, and positions come from one ordered shuffle, not from a window over a conversation.

Defined cases: a text that is null, or a block that is not closed, holds no call. A block that is no JSON object, or
has no id, is a call without id: ``malformed``, linked to nothing. Of several results of one call the first counts
(``n_results`` tells); of calls with one id the first takes the result, later ones are ``duplicate id``. ``after`` an
unknown id is ``unknown call``; calls in a cycle, or after one, come last and say ``cycle``. Repeated rows are repeated
calls. Other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.llm.table import col
from redactflow.operators.order import group_ordinal
from redactflow.session import cut_lineage

#: Kind of an argument -> the types a value of it has.
KINDS = {
    "string": "STRING",
    "integer": "BIGINT|TINYINT|SMALLINT|INT",
    "number": r"BIGINT|TINYINT|SMALLINT|INT|DOUBLE|FLOAT|DECIMAL\(.*\)",
    "boolean": "BOOLEAN",
    "object": "OBJECT.*",
    "array": "ARRAY.*",
}
#: tool -> argument -> (kind, needed)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def _blocks(text: Column, tag: str) -> Column:
    """What stands between ``<tag>`` and the next ``</tag>``."""
    after = F.split(text, f"<{tag}>")
    pieces = F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0)))
    return F.transform(F.filter(pieces, lambda p: F.contains(p, F.lit(f"</{tag}>"))), lambda p: F.substring_index(p, f"</{tag}>", 1))


def _parsed(messages: DataFrame, names: Mapping[str, str], tag: str, role: str) -> DataFrame:
    rows = messages.select(*[col(names[k]).alias(k) for k in ("conv_id", "turn", "role", "text")]).filter(F.col("role") == role)
    blocks = rows.select("conv_id", "turn", F.posexplode(_blocks(F.col("text"), tag)).alias("place", "block"))
    json = F.try_parse_json("block")
    return blocks.withColumn("json", F.when(F.schema_of_variant(json).startswith("OBJECT"), json)).withColumn(
        "id", F.try_variant_get("json", "$.id", "string")
    )


def _problems(schemas: Schemas) -> Column:
    """array<string> of what is wrong with ``arguments`` of the tool ``name``."""
    kind = F.schema_of_variant("arguments")
    shaped = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        found = []
        for name, (wanted, needed) in sorted(fields.items()):
            value = F.try_variant_get("arguments", f"$['{name}']", "variant")
            if needed:
                found.append(F.when(value.isNull(), F.lit(f"missing {name}")))
            found.append(F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(f"^(?:{KINDS[wanted]})$"), F.lit(f"not {wanted}: {name}")))
        known = F.array(*[F.lit(n) for n in fields])
        keys = F.json_object_keys(F.to_json("arguments"))
        extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unexpected "), k))
        own = F.when(shaped, F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), extra)).otherwise(F.array(F.lit("no arguments")))
        out = F.when(F.col("name") == tool, own).otherwise(out)
    return out


def _levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, id, level) of calls that can be ordered, and (conv_id, id) of those that wait for no known call."""
    first = calls.filter("id is not null and nth = 1")
    known = first.select("conv_id", F.col("id").alias("dep"))
    wanted = first.select("conv_id", "id", F.explode(F.array_distinct("after")).alias("dep"))
    edges = cut_lineage(wanted.join(known, ["conv_id", "dep"], "left_semi"), "edges")
    missing = wanted.join(known, ["conv_id", "dep"], "left_anti").select("conv_id", "id").distinct()
    waiting = edges.select("conv_id", "id").distinct()
    new = first.join(waiting, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("level"))
    new = done = cut_lineage(new, "level")
    while not edges.isEmpty():
        # an edge goes once its call is ordered; a call follows when it has no edge left
        reached = done.select("conv_id", F.col("id").alias("dep"), "level")
        state = edges.join(reached, ["conv_id", "dep"], "left").groupBy("conv_id", "id")
        state = state.agg(F.max("level").alias("level"), F.count("level").alias("n"), F.count("*").alias("of"))
        new = cut_lineage(state.filter("n = of").select("conv_id", "id", (F.col("level") + 1).alias("level")), "level")
        if new.isEmpty():
            break
        done = done.unionByName(new)
        edges = cut_lineage(edges.join(new.select("conv_id", "id"), ["conv_id", "id"], "left_anti"), "edges")
    return done, missing


def link(
    messages: DataFrame, schemas: Schemas, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each call: conv_id, position (from 1, in topological order), level, id, name, call_turn, result_turn,
    n_results, valid, problems (joined by "; ") and json."""
    names = {"conv_id": conv_id, "turn": turn, "role": role, "text": text}
    calls = _parsed(messages, names, "tool_call", "assistant").select(
        "conv_id",
        F.col("turn").alias("call_turn"),
        "place",
        "id",
        F.try_variant_get("json", "$.name", "string").alias("name"),
        F.try_variant_get("json", "$.arguments", "variant").alias("arguments"),
        F.coalesce(F.try_variant_get("json", "$.after", "array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    calls = calls.withColumn("problems", F.when(F.col("id").isNull(), F.array(F.lit("malformed"))).otherwise(_problems(schemas)))
    calls = calls.withColumn("arguments", F.to_json("arguments")).withColumn("_row", F.monotonically_increasing_id())
    calls = cut_lineage(calls, "calls")
    # which call an identifier means: the first by turn and place; found by an aggregation, not by a window
    key, order = ["conv_id", "id"], F.struct("call_turn", "place", "_row")
    owner = calls.filter("id is not null").groupBy(*key).agg(F.min(order).alias("owner"))
    calls = calls.join(owner, key, "left").withColumn("nth", F.when(F.col("id").isNull() | (order == F.col("owner")), 1).otherwise(2)).drop("owner")
    calls = cut_lineage(calls, "calls")

    results = _parsed(messages, names, "tool_result", "tool").filter("id is not null")
    content = F.to_json(F.try_variant_get("json", "$.content", "variant"))
    results = results.select("conv_id", "id", "turn", F.struct("turn", "place", content.alias("content")).alias("r"))
    results = results.groupBy(*key).agg(F.min_by("r", F.struct("r.turn", "r.place", "r.content")).alias("r"), F.count("*").alias("n_results"))
    done, missing = _levels(calls)
    joined = (
        calls.join(results.withColumn("nth", F.lit(1)), [*key, "nth"], "left")
        .join(done.withColumn("nth", F.lit(1)), [*key, "nth"], "left")
        .join(missing.withColumns({"nth": F.lit(1), "lost": F.lit(True)}), [*key, "nth"], "left")
    )
    alone = F.col("id").isNull() | (F.col("nth") > 1)
    notes = F.array(
        F.when(F.col("nth") > 1, F.lit("duplicate id")),
        F.when(F.col("lost"), F.lit("unknown call")),
        F.when(~alone & F.col("level").isNull(), F.lit("cycle")),
        F.when(F.col("r").isNull(), F.lit("no result")),
    )
    problems = F.concat("problems", F.filter(notes, lambda x: x.isNotNull()))
    parts = {"arguments": F.col("arguments"), "id": _quoted("id"), "name": _quoted("name"), "result": F.col("r.content")}
    json = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in parts.items()]), F.lit("}"))
    flat = joined.select(
        "conv_id",
        F.when(alone, F.lit(0)).otherwise(F.col("level")).cast("bigint").alias("level"),
        "id",
        "name",
        "call_turn",
        F.col("r.turn").alias("result_turn"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        (F.size("problems") == 0).alias("valid"),
        F.array_join(problems, "; ").alias("problems"),
        json.alias("json"),
        "place",
        "_row",
    )
    late = F.coalesce("level", F.lit((1 << 31) - 1))
    return group_ordinal(flat, ["conv_id"], [late, F.col("call_turn"), F.col("place"), F.col("_row")], "position").drop("place", "_row")


def _quoted(name: str) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(name))
    return F.when(F.col(name).isNotNull(), F.substring(inside, 2, F.length(inside) - 2))
