"""Queries over inputs larger, deeper or more repeated than the tables hold: long runs, nested secrets, hot items, second
exports, moved audit rows, interrupted runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.functions.secrets import redact_struct
from redactflow.operators import verify as V
from redactflow.operators.screen import image_dims
from redactflow.operators.text import mask_entities
from redactflow.plans.registry import query
from redactflow.plans.text_queries import found_sql
from redactflow.plans.views import Tables
from redactflow.plans.waves import run_waves
from redactflow.session import scratch_path
from redactflow.sinks import tables
from redactflow.sinks.export import export_clean, read_export

_RUNS = """(SELECT doc_id, repeat('a', CAST(300 + doc_id % 7 AS BIGINT)) || doc_id || '@' || repeat('b', 270) || '.org and ' ||
  repeat('4', CAST(14 + doc_id % 19 AS BIGINT)) || ' acct: ' || repeat('7', CAST(4 + doc_id % 10 AS BIGINT)) || '-' || repeat('8', 9) || ' ' || text AS text FROM documents)"""


@query(f"WITH {found_sql(_RUNS, 'doc_id', 'text')} SELECT doc_id, sha256(masked) AS masked_sha256, entity_count, masked_chars FROM found")
def mask_long_runs(t: Tables) -> DataFrame:
    """Addresses and numbers longer than any usual limit."""
    of = lambda c, n: F.repeat(F.lit(c), F.lit(n).cast("int") if isinstance(n, int) else n.cast("int"))
    k = F.col("doc_id")
    text = F.concat(
        of("a", 300 + k % 7), k.cast("string"), F.lit("@"), of("b", 270), F.lit(".org and "), of("4", 14 + k % 19),
        F.lit(" acct: "), of("7", 4 + k % 10), F.lit("-"), of("8", 9), F.lit(" "), F.col("text"),
    )
    masked = mask_entities(t.texts("documents", "doc_id", "text").select("doc_id", text.alias("text")), "text")
    return masked.select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), "entity_count", "masked_chars")


@query(
    """WITH d AS (SELECT doc_id, doc_id % 10000 // 1000 AS a, doc_id % 1000 // 100 AS b, doc_id % 100 // 10 AS c, doc_id % 10 AS d FROM documents)
    SELECT doc_id, '[PLATE]; [ADDRESS]; [IPV4]; [SSN]; [ACCOUNT]; [PHONE]; {[SECRET]}; ' ||
      CASE WHEN (24 + 2 * a - CASE WHEN a > 4 THEN 9 ELSE 0 END + b + 2 * c - CASE WHEN c > 4 THEN 9 ELSE 0 END + d) % 10 = 0 THEN '[CARD]'
      ELSE '4111 1111 1111 ' || a || b || c || d END AS head FROM d"""
)
def mask_whole_runs(t: Tables) -> DataFrame:
    """Seven kinds of runs longer than they may be or quoted, and a grouped card number that is one in ten times: nothing
    of an entity stays, and nothing of what is none goes."""
    k = F.col("doc_id")
    head = F.concat(
        F.lit("plate ABC"), k * 1003 + 10, F.lit("X9; "), k + 100_000, F.lit("7 Main Street; 10.20.30."), k + 4567, F.lit("; 123-45-6"), k + 7890,
        F.lit("; account: 12-34-56-"), k + 10, F.lit("; (555) 123-4"), k + 5678, F.lit('; {"password": "p '), k,
        F.lit(' \\"q\\""}; 4111 1111 1111 '), F.lpad((k % 10_000).cast("string"), 4, "0"),
    )
    text = t.texts("documents", "doc_id", "text").select("doc_id", F.concat(head, F.lit("\n"), "text").alias("text"))
    return mask_entities(text, "text").select("doc_id", F.substring_index("masked", "\n", 1).alias("head"))


@query(
    """SELECT event_id, '***REDACTED***' AS listed, event_type AS note, NULL::BIGINT AS number, user_id AS plain_number,
    '{"k":' || event_id || ',"token":"***REDACTED***","z":[{"n":' || user_id || ',"secret":"***REDACTED***"}]}' AS payload FROM events"""
)
def redact_nested_payload(t: Tables) -> DataFrame:
    """Secrets under keys of maps of lists and of numbers, and deep inside variants."""
    payload = F.concat(
        F.lit('{"token":{"a":[{"b":"hunter2 '), "event_id", F.lit('"}],"c":[[1],[]]},"k":'), "event_id",
        F.lit(',"z":[{"secret":["x",{"y":"hunter2"}],"n":'), "user_id", F.lit("}]}"),
    )
    nested = t.events.select(
        "event_id",
        F.create_map(F.lit("password"), F.array(F.lit("hunter2")), F.lit("note"), F.array("event_type")).alias("m"),
        F.create_map(F.lit("api_token"), F.col("user_id"), F.lit("n"), F.col("user_id")).alias("i"),
        F.parse_json(payload).alias("v"),
    )
    return redact_struct(nested).select(
        "event_id",
        F.col("m")["password"][0].alias("listed"),
        F.col("m")["note"][0].alias("note"),
        F.col("i")["api_token"].alias("number"),
        F.col("i")["n"].alias("plain_number"),
        F.to_json("v").alias("payload"),
    )


def _short(value: Column) -> Column:
    """Two bytes, low one first, as hexadecimal digits."""
    digits = F.lpad(F.hex(value.cast("bigint")), 4, "0")
    return F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2))


@query("SELECT c_custkey, 1 + c_custkey % 900 AS width, 1 + c_custkey % 700 AS height FROM customer")
def image_dims_tail_directory(t: Tables) -> DataFrame:
    """TIFF files whose directory stands behind 70,000 bytes of pixels."""
    width, height = 1 + F.col("c_custkey") % 900, 1 + F.col("c_custkey") % 700
    entry = lambda tag, v: F.concat(F.lit(tag), F.lit("030001000000"), _short(v), F.lit("0000"))
    pixels = F.unhex(F.concat(F.lit("49492A0078110100"), F.repeat(F.lit("00"), F.lit(70_000))))  # alike in every file
    body = F.concat(pixels, F.unhex(F.concat(F.lit("0200"), entry("0001", width), entry("0101", height), F.lit("00000000"))))
    files = t.texts("customer", "c_custkey").select("c_custkey", body.alias("content"))
    return image_dims(files).select("c_custkey", "width", "height")


@query(
    """WITH n AS (SELECT l_returnflag AS stem, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, (n + 4095) // 4096 AS parts FROM n)
    SELECT stem, part, parts, least(4096, n - part * 4096) AS boxes FROM (SELECT *, unnest(range(parts)) AS part FROM p)"""
)
def attach_detections_hot(t: Tables) -> DataFrame:
    """All line items as boxes of three items, most of them equal to others."""
    box = F.array(F.array(F.lit(0.0), F.col("l_quantity").cast("double")))
    boxes = t.texts("lineitem", "l_returnflag", "l_quantity").select(
        F.col("l_returnflag").alias("stem"), box.alias("polygon"), F.lit("line").alias("text"), F.lit(0.5).alias("score")
    )
    rows = V.attach_detections(boxes.select("stem").distinct(), boxes)
    return rows.select("stem", "part", "parts", F.size("boxes").alias("boxes"))


def _exported(t: Tables, target: str, ending: str, torn: bool, between: Callable[[], None] = lambda: None) -> None:
    content = F.concat("p_name", F.lit(ending)).cast("binary")
    items = t.part.select(F.concat(F.lit("parts/"), "p_partkey").alias("path"), F.concat(F.lit("p"), "p_partkey").alias("stem"), content.alias("content"))
    items = items.withColumns({"sha256": F.sha2("content", 256), "final_decision": F.lit("pass")})
    audit = items.select("stem", F.struct(F.lit("pass").alias("final_decision")).alias("qa"))
    tries = []

    def write(df: DataFrame, path: str) -> None:
        tries.append(path)
        bad = F.when(F.length("content") % 3 == 0, F.lit(b"torn")).otherwise(F.col("content"))
        (df.withColumn("content", bad) if torn and len(tries) == 1 else df).write.mode("overwrite").parquet(path)
        between()

    export_clean(t.spark, items, audit, target, "2024-06-01T00:00:00", write)


@query("SELECT 'parts/' || p_partkey AS path, sha256(p_name || '-1') AS content_sha256 FROM part")
def export_clean_repaired(t: Tables) -> DataFrame:
    """A third of the first copies are torn; the second ones count."""
    target = scratch_path(t.spark, "export")
    _exported(t, target, "-1", torn=True)
    return read_export(t.spark, target).select("path", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT 'parts/' || p_partkey AS path, sha256(p_name || '-2') AS content_sha256 FROM part")
def export_clean_twice(t: Tables) -> DataFrame:
    """After a repaired export, a second one to the same place: only its contents are there."""
    target = scratch_path(t.spark, "export")
    _exported(t, target, "-1", torn=True)
    _exported(t, target, "-2", torn=False)
    return read_export(t.spark, target).select("path", F.sha2("content", 256).alias("content_sha256"))


@query(
    """SELECT 's' || s_suppkey AS stem, CASE WHEN s_suppkey % 3 = 0 OR s_nationkey = 3 THEN 'moved-' || s_suppkey % 5
    ELSE 'batch-' || s_nationkey END AS batch FROM supplier"""
)
def upsert_audit_moved(t: Tables) -> DataFrame:
    """Items that move to other batches leave the old ones, one of which is emptied."""
    path, now = scratch_path(t.spark, "audit"), F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    stem = F.concat(F.lit("s"), "s_suppkey").alias("stem")
    tables.write_audit(t.supplier.select(stem, F.concat(F.lit("batch-"), "s_nationkey").alias("batch_id")), path, now)
    moved = t.supplier.filter("s_suppkey % 3 = 0 OR s_nationkey = 3")
    tables.upsert_audit(t.spark, moved.select(stem, F.concat(F.lit("moved-"), F.col("s_suppkey") % 5).alias("batch_id")), path, now)
    return tables.audit_rows(t.spark, path).select("stem", F.col("batch_id").alias("batch"))


@query(
    """SELECT unnest(['before', 'during', 'after']) AS reader, 'parts/' || p_partkey AS path,
    unnest([sha256(p_name || '-1'), sha256(p_name || '-1'), sha256(p_name || '-2')]) AS content_sha256 FROM part"""
)
def export_clean_snapshots(t: Tables) -> DataFrame:
    """Readers that open before, during and after a second export to the same place, all read at its end."""
    target, readers = scratch_path(t.spark, "export"), {}
    _exported(t, target, "-1", torn=True)
    readers["before"] = read_export(t.spark, target)
    _exported(t, target, "-2", torn=False, between=lambda: readers.update(during=read_export(t.spark, target)))
    readers["after"] = read_export(t.spark, target)
    seen = [df.select(F.lit(name).alias("reader"), "path", F.sha2("content", 256).alias("content_sha256")) for name, df in readers.items()]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


_BATCHES = ("007", "7", "1e3", "1000.0", "2024-01-01", "0x10", "true", "NULL", "batch=1", "a/b")


@query(
    f"""WITH s AS (SELECT 's' || s_suppkey AS stem, s_suppkey % 10 AS b, s_suppkey % 3 AS m, {list(_BATCHES)!r} AS ids FROM supplier)
    SELECT stem, CASE WHEN m = 0 THEN ids[(b + 2) % 10 + 1] WHEN m = 1 THEN ids[(b + 1) % 10 + 1] ELSE ids[b + 1] END AS batch,
    CASE WHEN m = 0 THEN 2 WHEN m = 1 THEN 1 ELSE 0 END AS retry_count FROM s WHERE NOT (m = 2 AND b = 3)"""
)
def upsert_audit_numeric_ids(t: Tables) -> DataFrame:
    """Batches whose ids look like numbers, dates or paths; two thirds of the items move once and a third of them again, with
    a compaction in between; at last one batch is written anew without its items."""
    path, now = scratch_path(t.spark, "audit"), F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    key, ids = F.col("s_suppkey"), F.array(*[F.lit(b) for b in _BATCHES])

    def moved(by: int) -> DataFrame:
        batch = F.element_at(ids, ((key % 10 + by) % 10 + 1).cast("int"))
        return t.supplier.filter(key % 3 <= 2 - by).select(
            F.concat(F.lit("s"), key).alias("stem"), batch.alias("batch_id"), F.lit(by).alias("retry_count"), key
        )

    tables.write_audit(moved(0).drop("s_suppkey"), path, now)
    tables.upsert_audit(t.spark, moved(1).drop("s_suppkey"), path, now)
    tables.compact_audit(t.spark, path)
    tables.upsert_audit(t.spark, moved(2).drop("s_suppkey"), path, now)
    rest = tables.audit_rows(t.spark, path).filter((F.col("batch_id") == _BATCHES[3]) & (F.col("retry_count") > 0))
    tables.write_audit(rest, path, now)
    return tables.audit_rows(t.spark, path).select("stem", F.col("batch_id").alias("batch"), "retry_count")


@query(
    """SELECT 'o' || o_orderkey AS stem, CASE WHEN o_orderkey % 5 = 0 THEN 'manual_review' ELSE 'final_clean' END AS route,
    CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END AS retry_count FROM orders"""
)
def run_waves_resumed(t: Tables) -> DataFrame:
    """A run over half of the orders, then one over all: what is settled stays, the rest goes on; one in five never passes."""
    folder = scratch_path(t.spark, "run")
    items = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("stem"), F.concat(F.lit("in/"), "o_orderkey").alias("path"), "o_orderkey")

    def process(chosen: DataFrame) -> DataFrame:
        bad = F.col("o_orderkey") % 5 == 0
        tries = F.col("retry_count") + F.when(bad, 1).otherwise(0)
        return chosen.select(
            "stem",
            "path",
            F.when(bad, "fail").otherwise("pass").alias("final_decision"),
            F.when(bad, "bad").alias("failure_reason"),
            F.when(~bad, "final_clean").when(tries >= 3, "manual_review").otherwise("quarantine").alias("route"),
            tries.cast("int").alias("retry_count"),
        )

    run_waves(t.spark, items.filter("o_orderkey % 2 = 0"), process, folder)
    return run_waves(t.spark, items, process, folder).select("stem", "route", "retry_count")
