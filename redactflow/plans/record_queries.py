"""Queries over audit records, manifests and logs: written in the shared folder by Spark, read back, reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow import sinks, sources
from redactflow.functions.boxes import box_count, max_score, normalize_boxes
from redactflow.functions.messages import parse_check_mismatch
from redactflow.functions.names import sha256_hex
from redactflow.functions.secrets import sanitize_for_export as sanitize
from redactflow.operators import route as X
from redactflow.operators import verify as V
from redactflow.operators.qa import decide
from redactflow.plans.registry import query
from redactflow.plans.views import Tables
from redactflow.schemas import AUDIT_DDL, RUN_SCOPE_DDL
from redactflow.session import scratch_path
from redactflow.sinks.tables import batch_summary as summary_of

NOW = "2024-01-02 00:00:00"


def audits(t: Tables) -> DataFrame:
    """Nested audit records from documents and labels: toxic ones failed, unlabelled ones have no QA block."""
    joined = t.documents.select("doc_id", "text", "source", "n_chars").join(t.labels, "doc_id", "left")
    toxic, labelled = F.col("toxic") == 1, F.col("toxic").isNotNull()
    decision = F.when(toxic, "fail").when(labelled, "pass")
    record = F.struct(
        F.col("doc_id").cast("string").alias("stem"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".png")).alias("image"),
        F.concat(F.lit("/tmp/"), F.col("doc_id")).alias("decode_path"),
        F.concat(F.lit("batch_"), F.col("source")).alias("batch_id"),
        F.when(labelled, F.col("quality").cast("int")).alias("retry_count"),
        F.when(toxic, F.concat(F.lit("password: p"), F.col("doc_id"))).alias("failure_reason"),
        F.struct(F.sha2("text", 256).alias("source_sha256")).alias("integrity_hashes"),
        F.struct(F.struct(F.col("n_chars").cast("int").alias("count")).alias("text")).alias("detections"),
        F.struct(
            F.when(labelled, "completed").alias("processing_status"), F.col("quality").cast("int").alias("text_regions_inpainted")
        ).alias("success_metrics"),
        F.struct(
            decision.alias("final_decision"), F.when(toxic, "quarantine").when(labelled, "final_clean").alias("final_route"),
            F.struct(F.when(toxic, 0.95).otherwise(0.1).alias("max_det_score")).alias("detection"),
        ).alias("qa"),
    )
    # through the fixed schema: fields not given are null
    return joined.select(F.from_json(F.to_json(record), " ".join(AUDIT_DDL.split())).alias("a")).select("a.*")


_AUDIT = """audit AS (SELECT CAST(d.doc_id AS VARCHAR) AS stem, 'doc_' || d.doc_id || '.png' AS image, 'batch_' || source AS batch_id,
    CASE WHEN toxic IS NOT NULL THEN CAST(quality AS BIGINT) END AS retry_count,
    CASE WHEN toxic = 1 THEN d.doc_id END AS secret_of, sha256(text) AS source_sha256, n_chars, quality,
    CASE WHEN toxic = 1 THEN 'fail' WHEN toxic = 0 THEN 'pass' END AS final_decision,
    CASE WHEN toxic = 1 THEN 'quarantine' WHEN toxic = 0 THEN 'final_clean' END AS route,
    CASE WHEN toxic = 1 THEN 0.95::DOUBLE ELSE 0.1::DOUBLE END AS score,
    CASE WHEN toxic IS NOT NULL THEN 'completed' END AS processing_status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_MASTER = f"""WITH {_AUDIT} SELECT image, final_decision, route, retry_count, n_chars AS text_regions_detected,
    CAST(quality AS BIGINT) AS text_regions_inpainted, NULL AS original_face_count, NULL AS face_gan_applied,
    processing_status FROM audit"""


@query(_MASTER)
def master_rows(t: Tables) -> DataFrame:
    return X.master_row(audits(t))


@query(_MASTER)
def audit_json_round_trip(t: Tables) -> DataFrame:
    """Records as JSON, read back by the audit reader."""
    folder = scratch_path(t.spark, "audit")
    audits(t).write.json(folder)
    return X.master_row(sources.read_audit(t.spark, folder, multi_line=False))


@query(
    f"""WITH {_AUDIT} SELECT stem, image, batch_id, 'redactflow.audit.v1' AS schema, '{NOW}' AS updated_at, final_decision FROM audit"""
)
def write_audit(t: Tables) -> DataFrame:
    """Written twice: the second write replaces the first."""
    folder, now = scratch_path(t.spark, "audit"), F.to_timestamp(F.lit(NOW))
    for _ in range(2):
        sinks.write_audit(audits(t), folder, now)
    rows = sinks.audit_rows(t.spark, folder)
    stamp = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at")
    return rows.select("stem", "image", "batch_id", "schema", stamp, F.col("qa.final_decision").alias("final_decision"))


@query(
    f"""WITH {_AUDIT} SELECT image, final_decision AS decision, retry_count FROM audit
    UNION ALL SELECT image, final_decision, retry_count FROM audit"""
)
def append_master_audit(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "master")
    rows = X.master_row(audits(t))
    for _ in range(2):
        sinks.append_master_audit(rows, folder)
    return t.spark.read.parquet(folder)


@query(
    f"""WITH {_AUDIT} SELECT batch_id, image, final_decision, route AS final_route, CAST(score AS VARCHAR) AS max_ocr_score FROM audit"""
)
def batch_summary(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "summaries")
    sinks.write_batch_summary(summary_of(audits(t)), folder)
    rows = t.spark.read.option("header", "true").csv(folder)
    return rows.select("batch_id", "image", "final_decision", "final_route", "max_ocr_score")


@query(
    f"""WITH {_AUDIT} SELECT image, final_decision, CAST(retry_count AS VARCHAR) AS retry_count FROM audit"""
)
def write_master_summary(t: Tables) -> DataFrame:
    """Two reports per image; the later one is kept."""
    folder = scratch_path(t.spark, "summary")
    rows = X.master_row(audits(t)).select("image", "final_decision", "retry_count")
    early = rows.withColumns({"final_decision": F.lit("fail"), "batch_index": F.lit(0), "seq": F.lit(7)})
    late = rows.withColumns({"batch_index": F.lit(1), "seq": F.lit(0)})
    sinks.write_master_summary(early.unionByName(late), folder)
    return t.spark.read.option("header", "true").csv(folder).select("image", "final_decision", "retry_count")


@query(
    f"""WITH {_AUDIT} SELECT stem, CASE WHEN secret_of IS NOT NULL THEN 'password=***REDACTED***' END AS failure_reason,
    source_sha256, FALSE AS has_decode_path FROM audit"""
)
def sanitize_for_export(t: Tables) -> DataFrame:
    clean = sanitize(audits(t))
    return clean.select(
        "stem", "failure_reason", F.col("integrity_hashes.source_sha256").alias("source_sha256"),
        F.lit("decode_path" in clean.columns).alias("has_decode_path"),
    )


@query(
    f"""WITH {_AUDIT} SELECT CASE WHEN secret_of IS NOT NULL THEN 'password=***REDACTED***' END AS note, stem,
    '***REDACTED***' AS session_token FROM audit"""
)
def append_events(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "events")
    events = audits(t).select("stem", F.col("failure_reason").alias("note"), F.col("image").alias("session_token"))
    sinks.append_events(events, folder)
    return t.spark.read.schema("stem string, note string, session_token string").json(folder)


@query(
    f"""WITH {_AUDIT} SELECT stem, error FROM (SELECT stem, unnest([
      'missing_hashes', CASE WHEN final_decision IS NULL THEN 'missing_final_decision' END,
      CASE WHEN retry_count IS NULL THEN 'missing_retry_count' END, 'unexpected_strip_method']) AS error FROM audit)
    WHERE error IS NOT NULL"""
)
def audit_errors_nested(t: Tables) -> DataFrame:
    """Nested records: none has an output hash or a strip method."""
    return V.audit_errors(t.items, V.audit_columns(audits(t)))


@query("SELECT path, sha256, size_bytes FROM listing", "listing")
def read_transfer_manifest(t: Tables) -> DataFrame:
    """Transfer manifests as JSON with backslash paths, read back file by file."""
    folder = scratch_path(t.spark, "manifest")
    entry = F.struct(F.concat(F.lit("in\\"), F.col("path")).alias("path"), "sha256", "size_bytes")
    t.listing.select(F.lit("ingest").alias("operation"), F.array(entry).alias("files")).write.json(folder)
    files = sources.read_transfer_manifest(t.spark, folder, multi_line=False)
    return files.withColumn("path", F.regexp_extract("path", "^in/(.*)$", 1))


@query("SELECT stem, sha256 AS original_hash, 'in/' || stem AS source_path FROM items", "items")
def read_processed_manifest(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "manifest")
    entry = F.struct(F.col("sha256").alias("original_hash"), F.concat(F.lit("in\\"), F.col("stem")).alias("source_path"))
    t.items.select(F.create_map("stem", entry).alias("entries")).write.json(folder)
    rows = sources.read_processed_manifest(t.spark, folder, multi_line=False)
    return rows.select("stem", "original_hash", "source_path")


@query(
    f"""WITH {_AUDIT} SELECT count(*) AS verified_count, 0::BIGINT AS missing_count, 0::BIGINT AS mismatched_count, TRUE AS ok
    FROM audit WHERE final_decision = 'pass'"""
)
def export_clean(t: Tables) -> DataFrame:
    audit = audits(t)
    decided = audit.select("stem", F.col("qa.final_decision").alias("final_decision"))
    content = F.col("text").cast("binary")
    items = t.documents.select(
        F.col("doc_id").cast("string").alias("stem"), F.concat(F.lit("out/"), "doc_id").alias("path"),
        content.alias("content"), sha256_hex(content).alias("sha256"),
    )
    return sinks.export_clean(t.spark, items.join(decided, "stem"), audit, scratch_path(t.spark, "export"), NOW)


@query(
    """SELECT l_orderkey, l_linenumber, 1::BIGINT AS boxes, round(CAST(l_discount AS DOUBLE), 6) AS score, l_returnflag AS text,
    CAST(l_partkey AS DOUBLE) AS x FROM lineitem"""
)
def normalize_raw_boxes(t: Tables) -> DataFrame:
    """Raw detector output per line: one good entry, one without score, one that is not an entry."""
    polygon = F.format_string("[[%d,0],[%d,1]]", "l_partkey", "l_partkey")
    score, text = F.col("l_discount").cast("string"), F.col("l_returnflag")
    raw = F.concat(F.lit("[["), polygon, F.lit(',["'), text, F.lit('",'), score, F.lit(']],['), polygon, F.lit(',["n"]],"junk"]'))
    lines = t.texts("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag")
    boxes = lines.select("l_orderkey", "l_linenumber", normalize_boxes(raw).alias("b"))
    first = F.get("b", F.lit(0))
    return boxes.select(
        "l_orderkey", "l_linenumber", box_count(F.col("b")).alias("boxes"), max_score(F.col("b")).alias("score"),
        first.getField("text").alias("text"), first.getField("polygon")[0][0].cast("double").alias("x"),
    )


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'f/' || o_orderkey || '.png' WHEN 'O' THEN 'o' || o_orderkey || '.png' END AS path
    FROM orders"""
)
def check_log_paths(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ERROR : f/"), k, F.lit(".png: hash mismatch")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("o"), k, F.lit(".png differ")))
        .otherwise(F.concat(k, F.lit(" differences found")))
    )
    return t.orders.select("o_orderkey", parse_check_mismatch(line).alias("path"))


def _name_files(t: Tables, folder: str) -> None:
    """Supplier names as text files, one for each nation, in a folder of its own."""
    names = t.supplier.select("s_name", "s_nationkey").repartition("s_nationkey")
    names.write.partitionBy("s_nationkey").text(folder)


@query("SELECT '.txt' AS ext, count(DISTINCT s_nationkey) AS files, CAST(sum(length(s_name) + 1) AS BIGINT) AS bytes FROM supplier")
def written_files_profile(t: Tables) -> DataFrame:
    """Supplier names written as text files, and the folders profiled without reading contents."""
    folder = scratch_path(t.spark, "names")
    _name_files(t, folder)
    return sources.dataset_profile(sources.scan_files(t.spark, folder, recursive=True).filter("ext = '.txt'"))


@query(
    """SELECT 'nation' AS folder, s_nationkey AS nation, '.txt' AS ext, CAST(sum(length(s_name) + 1) AS BIGINT) AS bytes FROM supplier GROUP BY s_nationkey
    UNION ALL SELECT 'orders', NULL, '.json', CAST(sum(length('{"o_orderkey":' || o_orderkey || '}') + 1) AS BIGINT) FROM orders"""
)
def scan_items_written(t: Tables) -> DataFrame:
    """Files of three extensions in many folders, scanned folder by folder: only those directly inside and of the listed
    extensions count, checksum files beside them do not."""
    folder = scratch_path(t.spark, "files")
    _name_files(t, f"{folder}/names")
    t.orders.select("o_orderkey").write.json(f"{folder}/orders")
    t.orders.select("o_orderkey").write.json(f"{folder}/orders/deeper")
    t.nation.select("n_name").write.csv(f"{folder}/orders", mode="append")
    names = sources.scan_items(t.spark, f"{folder}/names/*", (".TXT",))
    nation = F.regexp_extract("path", "s_nationkey=([0-9]+)/", 1).cast("bigint")
    orders = sources.scan_items(t.spark, f"{folder}/orders", (".json", ".parquet"))
    total = F.sum("length").alias("bytes")
    first = names.groupBy(F.lit("nation").alias("folder"), nation.alias("nation"), "ext").agg(total)
    return first.unionByName(orders.groupBy(F.lit("orders").alias("folder"), F.lit(None).cast("bigint").alias("nation"), "ext").agg(total))


@query(
    """SELECT 'images_only' AS processing_mode, unnest(['pilot', 'full']) AS run_type, 32::BIGINT AS batch_size,
    unnest([(SELECT count(*) FROM orders), NULL])::BIGINT AS max_images, unnest([FALSE, TRUE]) AS dry_run"""
)
def run_scopes(t: Tables) -> DataFrame:
    """Two runs on record: a pilot of as many items as there are orders, and a dry run of everything."""
    folder, now = scratch_path(t.spark, "scope"), F.to_timestamp(F.lit(NOW))
    sinks.write_run_scope(t.spark, folder, now, max_items=t.orders.count())
    sinks.write_run_scope(t.spark, folder, now, dry_run=True)
    rows = t.spark.read.schema(RUN_SCOPE_DDL).json(folder)
    return rows.select("processing_mode", "run_type", "batch_size", "max_images", "dry_run")


@query(
    """SELECT c_nationkey AS nation, c_nationkey % 3 = 0 AS refused, CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE count(*) END AS customers
    FROM customer GROUP BY c_nationkey"""
)
def guarded_writes(t: Tables) -> DataFrame:
    """Customers of a third of the nations are aimed at the originals by a detour, those of the others at a folder whose
    name only begins like it: the first write is refused, the second is done."""
    root = scratch_path(t.spark, "guard")
    customers, refused = t.customer.select("c_nationkey", "c_custkey"), F.col("c_nationkey") % 3 == 0

    def write(rows: DataFrame, target: str) -> None:
        rows.write.mode("append").parquet(target)

    for rows, target in ((customers.filter(refused), f"{root}/out/../originals/x"), (customers.filter(~refused), f"{root}/originals-not")):
        try:
            sinks.guarded_write(rows, target, f"{root}/originals", write)
        except sinks.ProtectedPathError:
            sinks.guarded_write(rows.limit(0), f"{root}/originals-not", f"{root}/originals", write)
    found = t.spark.read.parquet(f"{root}/originals-not").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    every = customers.select("c_nationkey").distinct().join(found, "c_nationkey", "left")
    return every.select(F.col("c_nationkey").alias("nation"), refused.alias("refused"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query(
    """SELECT doc_id, CASE WHEN n_chars > 9000 OR coalesce(toxic, 0) = 1 THEN 'fail' ELSE 'pass' END AS final_decision,
    CASE WHEN n_chars > 9000 OR coalesce(toxic, 0) = 1 THEN concat_ws(' | ', CASE WHEN n_chars > 9000 THEN 'rule:too_long' END,
      CASE WHEN coalesce(toxic, 0) = 1 THEN 'rule:toxic' END) END AS failure_reason FROM documents LEFT JOIN labels USING (doc_id)"""
)
def decide_by_own_rules(t: Tables) -> DataFrame:
    """Rules of the caller decide next to the fixed checks; a rule that gives null does not fail."""
    judged = t.documents.join(t.labels, "doc_id", "left").withColumns({"detection_fail": F.lit(False), "integrity_fail": F.lit(False)})
    rules = {"too_long": F.col("n_chars") > 9000, "toxic": F.col("toxic") == 1}
    return decide(judged, rules).select("doc_id", "final_decision", "failure_reason")
