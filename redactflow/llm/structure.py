"""Repair of the turn structure of conversations: the cheapest edits that make the roles read ``(s?(ua)+)?``.

``grammar`` has the method: Re-Pair symbols over role and fault sequences, one min-plus transfer matrix with an audit
rope per rule. Here Spark cuts, shares and puts together:

1. Equal turns of a conversation become one row with a count, before the shuffle. What was said in an earlier turn is
   told by an aggregation of hashes, likewise combined before the shuffle.
2. One range shuffle orders all turns; a conversation of any length is cut into segments of ``SEGMENT`` rows.
3. Each different sequence of symbols is evaluated once, however many conversations share it. Conversations of one
   segment need no more than that. Matrices of the segments of longer ones are multiplied in rounds of up to ``FAN``
   neighbours, so no task holds more than ``FAN`` of them; the audit of the product is cut up for the segments again.
4. Each segment writes its repaired turns. The digest of a conversation of several segments runs over them in order,
   one at a time: it needs their bytes in one task, but holds one segment.

Null role and text count as one blank. Faults, the first counts: blank (no character but white space), duplicate (role
and text occur in an earlier turn or earlier among equal turns), truncated (the last character that is no white space
is not ``.``, ``!`` or ``?``). Turns are ordered with nulls first; turns of one number by role and text. A null conv_id is a
conversation. An empty table gives no rows; other columns are not read. Costs and letters are in ``grammar``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.llm import grammar
from redactflow.llm.table import col
from redactflow.session import cut_lineage

SEGMENT = 1024
FAN = 64
#: Bytes of turns that one part of the global order is meant to hold.
PART_BYTES = 64 << 20
#: Symbols that one grammar is built over.
GRAMMAR_SYMBOLS = 500_000
#: Rows that monotonically_increasing_id can number in one part of the global order.
_PART_ROWS = 1 << 33
_MATRIX = "array<struct<cost:long,audit:string>>"


@dataclass(frozen=True)
class Repaired:
    """``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    ``pieces``: conv_id, piece (ascending), text: the repaired turns as lines ``role:text``, cut into pieces."""

    summary: DataFrame
    pieces: DataFrame


def _same(left: str, right: str, names: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def _ordered(turns: DataFrame, segment: int) -> DataFrame:
    """Turns with a count of equal ones and their fault, in the order of conversations and turns (``seq``)."""
    text_key = F.sha2("text", 256)
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    said = turns.groupBy("conv_id", "role", text_key.alias("text_key")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    later = said.filter("first < last").select("conv_id", "role", "text_key", F.col("first.turn").alias("first_turn"))
    marked = (
        rows.withColumn("text_key", text_key)
        .alias("r")
        .join(later.alias("l"), _same("r", "l", ["conv_id", "role", "text_key"]), "left")
        .select("r.*", (F.col("l.text_key").isNotNull() & ~F.col("r.turn").eqNullSafe(F.col("l.first_turn"))).alias("said"))
    )
    ending = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    faulty = marked.withColumns(
        {
            "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
            "open": ~ending.isin(".", "!", "?"),
            "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("o"),
        }
    )
    letter = F.when(F.col("blank") | F.col("said"), "x").when(F.col("open"), F.upper("initial")).otherwise(F.col("initial"))
    size = turns._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(str(size)) // PART_BYTES, 1 << 17))
    order = ["conv_id", "turn", "role", "text_key"]
    sorted_turns = faulty.withColumn("symbol", letter).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut_lineage(
        sorted_turns.select(
            "conv_id", "turn", "role", "text", "n", "blank", "initial", "symbol", F.monotonically_increasing_id().alias("seq")
        ).withColumn("segment", F.expr(f"seq div {segment}")),
        "turns",
    )


def _counts(ordered: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation."""
    is_copy = F.when(F.col("blank"), 0).otherwise(F.col("n") - 1)
    return ordered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(is_copy + F.when((F.col("symbol") == "x") & ~F.col("blank"), 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(F.col("symbol").isin("S", "U", "A", "O"), 1).otherwise(0)).alias("truncated"),
    )


def _segments(ordered: DataFrame) -> DataFrame:
    """Each segment's symbols, number of turns, initials at both ends and neighbours that do not follow each other."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "symbol", "initial", "n")))
    grouped = ordered.groupBy("conv_id", "segment").agg(rows.alias("r"))
    heads = F.transform("r", lambda r: r["initial"])
    tails = F.slice(heads, F.lit(2), F.greatest(F.size(heads) - 1, F.lit(0)))
    steps = F.zip_with(heads, tails, lambda a, b: F.concat(a, b))  # the last is null
    legal = F.size(F.filter(steps, lambda s: s.isin("su", "ua", "au")))
    turns = F.aggregate("r", F.lit(0).cast("long"), lambda acc, r: acc + r["n"])
    symbols = F.array_join(F.transform("r", lambda r: F.concat(r["symbol"], F.repeat(F.lit("x"), (r["n"] - 1).cast("int")))), "")
    return grouped.select(
        "conv_id",
        "segment",
        symbols.alias("symbols"),
        turns.alias("turns"),
        (turns - 1 - legal).alias("illegal"),
        heads[0].alias("first"),
        F.element_at(heads, -1).alias("last"),
    )


def _by_symbols(texts: list[str]) -> Iterator[list[str]]:
    """Parts of about ``GRAMMAR_SYMBOLS`` symbols."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > GRAMMAR_SYMBOLS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _by_symbols(batch.column("symbols").to_pylist()):
            found = [grammar.closed(row) for row in grammar.transfer(part, whole=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                ["symbols", "cost", "audit"],
            )


def _as_rows(m: grammar.Matrix) -> list[dict | None]:
    return [None if e is None else {"cost": e[0], "audit": str(e[1])} for row in m for e in row]


def _as_matrix(rows: list[dict | None]) -> grammar.Matrix:
    each = [None if r is None else (r["cost"], grammar.Rope(None, None, r["audit"])) for r in rows]
    return [each[4 * i : 4 * i + 4] for i in range(4)]


_ARROW_MATRIX = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _by_symbols(batch.column("symbols").to_pylist()):
            for i, m in enumerate(grammar.transfer(part, whole=True)):
                yield pa.RecordBatch.from_arrays([pa.array([part[i]]), pa.array([_as_rows(m)], _ARROW_MATRIX)], ["symbols", "m"])


_NODE = [pa.field("m", _ARROW_MATRIX), pa.field("illegal", pa.int64()), pa.field("first", pa.string()), pa.field("last", pa.string())]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One node for the nodes of a group, which come in order."""
    for batch in batches:
        for i, nodes in enumerate(batch.column("nodes")):
            nodes = nodes.as_py()
            m = reduce(grammar.times, [_as_matrix(n["m"]) for n in nodes])
            steps = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(nodes, nodes[1:], strict=False))
            one = [_as_rows(m), steps + sum(n["illegal"] for n in nodes), nodes[0]["first"], nodes[-1]["last"]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(i, 1) for c in ("conv_id", "key")], *[pa.array([v], f.type) for v, f in zip(one, _NODE, strict=True)]],
                ["conv_id", "key", *[f.name for f in _NODE]],
            )


def _long(segments: DataFrame, id_type: str, fan: int) -> DataFrame:
    """Cost, audit and illegal neighbours of conversations of several segments, their matrices multiplied in rounds."""
    schema = f"conv_id {id_type}, key long, m {_MATRIX}, illegal long, first string, last string"
    known = segments.select("symbols").distinct().mapInArrow(_matrices, f"symbols string, m {_MATRIX}")
    nodes = segments.join(known, "symbols").select("conv_id", "key", "m", "illegal", "first", "last")
    several = True
    while several:
        group = F.array_sort(F.collect_list(F.struct("key", "m", "illegal", "first", "last")))
        grouped = nodes.groupBy("conv_id", F.expr(f"key div {fan}").alias("_up")).agg(group.alias("nodes"))
        nodes = cut_lineage(grouped.select("conv_id", F.col("_up").alias("key"), "nodes").mapInArrow(_joined, schema), "nodes")
        several = not nodes.groupBy("conv_id").count().filter("count > 1").isEmpty()
    return nodes.mapInArrow(_close, f"conv_id {id_type}, cost long, audit string, illegal long")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, m in enumerate(batch.column("m").to_pylist()):
            cost, audit = grammar.closed(_as_matrix(m)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").slice(i, 1), pa.array([cost], pa.int64()), pa.array([audit], pa.string()), batch.column("illegal").slice(i, 1)],
                ["conv_id", "cost", "audit", "illegal"],
            )


def shares(symbols: str, audit: str, state: int, end: int) -> tuple[int, int]:
    """How far into ``audit`` the turns ``symbols`` reach from ``end`` on, and the state after them."""
    for symbol in symbols:
        while True:
            letter = audit[end]
            end += 1
            state = _after(state, letter, symbol)
            if letter != "I":
                break
    return end, state


def _after(state: int, letter: str, symbol: str) -> int:
    if letter == "D":
        return state
    role = symbol.lower() if letter == "K" else ("a" if state == grammar._USER else "u")
    return grammar.MOVES[state, role]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit cut up for its segments, with the state each starts in."""
    for batch in batches:
        for i in range(batch.num_rows):
            audit, end, state = batch.column("audit")[i].as_py(), 0, 0
            parts = batch.column("parts")[i].as_py()
            out = {"segment": [], "audit": [], "state": []}
            for k, p in enumerate(parts):
                stop, after = shares(p["symbols"], audit, state, end)
                out["segment"].append(p["segment"])
                out["audit"].append(audit[end : stop if k + 1 < len(parts) else None])
                out["state"].append(state)
                end, state = stop, after
            ids = batch.column("conv_id").take(pa.array([i] * len(parts), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out["segment"], pa.int64()), pa.array(out["audit"], pa.string()), pa.array(out["state"], pa.int32())],
                ["conv_id", "segment", "audit", "state"],
            )


def repaired_lines(turns: list[dict], audit: str, state: int) -> list[str]:
    """``role:text`` of the turns of a segment after its edits."""
    out, todo = [], iter((t["role"], t["text"], "x" if i else t["symbol"]) for t in turns for i in range(t["n"]))
    for letter in audit:
        role, text, symbol = (None, "", "x") if letter == "I" else next(todo)
        state = _after(state, letter, symbol)
        if letter == "K":
            out.append(f"{role}:{text}")
        elif letter in "RI":
            out.append(f"{grammar.ROLE_NAMES[state]}:{text}")
    return out


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(c)[i].as_py() for c in ("turns", "audit", "state")]
            lines = repaired_lines(*row)
            text = "\n".join(lines) if lines else None
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").slice(i, 1), batch.column("segment").slice(i, 1), pa.array([text], pa.string())],
                ["conv_id", "segment", "text"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, which come in order."""
    now, running = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([now, pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.column("conv_id").slice(i, 1)
            if now is None or not one.equals(now):
                if now is not None:
                    yield done()
                now, running, some = one, hashlib.sha256(), False
            text = batch.column("text")[i].as_py()
            if text is not None:
                running.update(("\n" if some else "").encode() + text.encode())
                some = True
    if now is not None:
        yield done()


def repair(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment: int = SEGMENT,
    fan: int = FAN,
) -> Repaired:
    """Least costs, audits and repaired turns of all conversations of ``turns``. ``segment`` and ``fan``: see above; they
    change no result."""
    blank = F.lit(" ")
    tidy = turns.select(
        col(conv_id).alias("conv_id"),
        col(turn).cast("long").alias("turn"),
        F.coalesce(col(role).cast("string"), blank).alias("role"),
        F.coalesce(col(text).cast("string"), blank).alias("text"),
    )
    id_type = tidy.schema["conv_id"].dataType.simpleString()
    ordered = _ordered(tidy, segment)
    segments = cut_lineage(_segments(ordered), "segments")
    per = segments.groupBy("conv_id").agg(F.count("*").alias("many"), F.min("segment").alias("least"))
    several = per.filter("many > 1").select("conv_id", "least")
    # neighbouring segments get neighbouring keys, also where the global order goes on in the next part
    room = _PART_ROWS // segment
    most = segments.agg(F.max(F.col("segment") % room)).first()[0] or 0

    def key(name: str) -> Column:
        return F.expr(f"{name} div {room} * {most + 1} + {name} % {room}")

    keyed = segments.alias("s").join(several.alias("p"), _same("s", "p", ["conv_id"])).select("s.*", (key("s.segment") - key("p.least")).alias("key"))
    long_ones = cut_lineage(keyed, "long")
    short_ones = segments.alias("s").join(several.alias("p"), _same("s", "p", ["conv_id"]), "left_anti")

    solved = segments.select("symbols").distinct().mapInArrow(_solve, "symbols string, cost long, audit string")
    short_found = cut_lineage(
        short_ones.join(solved, "symbols").select("conv_id", "segment", "cost", "audit", "illegal"), "short"
    )
    found = short_found.select("conv_id", "cost", "audit", "illegal")
    dealt = short_found.select("conv_id", "segment", "audit", F.lit(0).alias("state"))
    some_long = not long_ones.isEmpty()
    if some_long:
        long_found = cut_lineage(_long(long_ones, id_type, fan), "long")
        parts = long_ones.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "symbols"))).alias("parts"))
        with_parts = long_found.alias("f").join(parts.alias("p"), _same("f", "p", ["conv_id"])).select("f.conv_id", "f.audit", "p.parts")
        found = found.unionByName(long_found)
        dealt = dealt.unionByName(with_parts.mapInArrow(_deal, f"conv_id {id_type}, segment long, audit string, state int"))

    said = F.array_sort(F.collect_list(F.struct("seq", "role", "text", "symbol", "n")))
    held = ordered.groupBy("conv_id", "segment").agg(said.alias("turns"))
    pieces = cut_lineage(
        held.alias("h")
        .join(dealt.alias("d"), _same("h", "d", ["conv_id", "segment"]))
        .select("h.conv_id", "h.segment", "h.turns", "d.audit", "d.state")
        .mapInArrow(_write, f"conv_id {id_type}, segment long, text string"),
        "pieces",
    )
    empty = F.coalesce("text", F.lit(""))
    if some_long:
        mine = pieces.alias("s").join(several.alias("p"), _same("s", "p", ["conv_id"]), "left_semi")
        digests = mine.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_digest, f"conv_id {id_type}, repaired_sha256 string")
        rest = pieces.alias("s").join(several.alias("p"), _same("s", "p", ["conv_id"]), "left_anti")
        digests = digests.unionByName(rest.select("conv_id", F.sha2(empty, 256).alias("repaired_sha256")))
    else:
        digests = pieces.select("conv_id", F.sha2(empty, 256).alias("repaired_sha256"))
    summary = (
        _counts(ordered).alias("c")
        .join(found.alias("f"), _same("c", "f", ["conv_id"]))
        .join(digests.alias("d"), _same("c", "d", ["conv_id"]))
        .select("c.*", "f.illegal", "f.cost", "f.audit", "d.repaired_sha256")
    )
    return Repaired(summary, pieces.select("conv_id", F.col("segment").alias("piece"), "text").filter("text is not null"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults planted by crc32(``conv_id:turn``) % 20: 0 drops the turn, 1 empties it, 2 takes its ``.!?``
    away, 3 repeats it, 4 gives it to the user. Nulls count as one blank."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    marked = turns.withColumn("_kind", kind).filter("_kind <> 0")
    changed = marked.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return changed.drop("_copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``summary`` for every conversation of ``turns`` after ``damaged``; zeros where no turn is left."""
    found = repair(damaged(turns)).summary
    every = turns.select("conv_id").distinct()
    zero = {c: F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.alias("e").join(found.alias("f"), _same("e", "f", ["conv_id"]), "left").select(
        "e.conv_id", *zero.values(), F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
