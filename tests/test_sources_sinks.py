import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from redactflow import sinks, sources
from redactflow.functions.names import sha256_hex
from redactflow.operators.route import master_row
from redactflow.operators.screen import image_dims, screen_items, verify_integrity
from redactflow.operators.verify import audit_columns, audit_errors
from redactflow.schemas import AUDIT_DDL, AUDIT_SCHEMA_NAME
from redactflow.sinks.tables import ProtectedPathError, batch_summary, is_under
from tests.helpers import by, flat, sign, write_bytes, write_png

def now():
    return F.to_timestamp(F.lit("2024-01-02 00:00:00"))



@pytest.fixture
def images(folder):
    for name, rgb in {"b.png": flat(300, 400), "a.PNG": flat(240, 320), "small.png": flat(60, 60), "sign.png": sign()}.items():
        write_png(f"{folder}/{name}", rgb)
    write_bytes(f"{folder}/corrupted.jpg", b"this is not a image")
    write_bytes(f"{folder}/empty.png", b"")
    write_bytes(f"{folder}/notes.txt", b"text")
    write_bytes(f"{folder}/deep/inner.png", b"x")
    return folder


def names(frame):
    return sorted(os.path.basename(r["path"]) for r in frame.select("path").collect())


def test_scan_items_not_recursive_any_case(spark, images):
    assert names(sources.scan_items(spark, images, include_empty=True)) == ["a.PNG", "b.png", "corrupted.jpg", "empty.png", "sign.png", "small.png"]
    assert names(sources.scan_items(spark, images, [".PNG"], include_empty=True)) == ["a.PNG", "b.png", "empty.png", "sign.png", "small.png"]
    write_bytes(f"{images}/odd name+1%.png", b"")
    assert "odd name+1%.png" in names(sources.scan_items(spark, images, include_empty=True))
    assert "inner.png" in names(sources.scan_files(spark, images, recursive=True))


def test_listing_does_not_read_contents(spark, images):
    profile = sources.dataset_profile(sources.scan_files(spark, images, recursive=True, include_empty=True))
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    got = by(profile.collect(), "ext")
    assert got[".png"]["files"] == 6 and got[".txt"]["bytes"] == 4


def test_decode_keeps_broken_files(spark, images):
    got = {os.path.basename(r["path"]): r for r in sources.decode_images(spark, images, include_empty=True).collect()}
    assert sorted(got) == ["a.PNG", "b.png", "corrupted.jpg", "empty.png", "sign.png", "small.png"]
    assert got["corrupted.jpg"]["data"] is None and got["empty.png"]["width"] is None
    assert (got["b.png"]["height"], got["b.png"]["width"], len(got["b.png"]["data"])) == (300, 400, 300 * 400 * 3)


def test_screening_by_header(spark, images):
    accepted, rejected = screen_items(image_dims(sources.scan_items(spark, images, include_empty=True)))
    assert names(accepted) == ["a.PNG", "b.png", "sign.png"]
    got = {os.path.basename(r["path"]): r["reject_reason"] for r in rejected.collect()}
    assert got == {
        "small.png": "resolution_too_low:3600<4096", "empty.png": "empty_file", "corrupted.jpg": "corrupted_or_unreadable",
    }


def test_verify_integrity(spark, images):
    items = sources.scan_items(spark, images, include_empty=True)
    decoded = sources.decode_images(spark, images, include_empty=True).select("path", (F.col("data").isNotNull()).alias("ok"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    joined = items.withColumn("path", plain).join(decoded.withColumn("path", plain), "path", "left")
    per_item, summary = verify_integrity(joined, F.col("ok"), limit=1)
    row = summary.first()
    assert (row["checked"], row["verified"], row["corrupt"], row["ok"], len(row["problems"])) == (6, 4, 2, False, 1)
    assert row["problems"][0]["path"].endswith("corrupted.jpg")
    assert per_item.filter("error is null").count() == 4


def test_read_audit_missing_and_unreadable(spark, folder):
    write_bytes(f"{folder}/a.json", json.dumps({"image": "a.jpg", "retry_count": 2, "qa": {"final_decision": "fail"}}).encode())
    write_bytes(f"{folder}/b.json", b"{broken")
    write_bytes(f"{folder}/c.json", b'{"qa": {"integrity": {"ssim": 0.5}}, "unknown_field": 1}')
    got = by(sources.read_audit(spark, folder).collect(), "stem")
    assert sorted(got) == ["a", "c"]
    assert got["a"]["qa"]["final_decision"] == "fail" and got["a"]["qa"]["integrity"] is None
    assert got["c"]["qa"]["integrity"]["ssim"] == 0.5 and got["c"]["retry_count"] is None


def test_read_events_drops_malformed(spark, folder):
    lines = ['{"ts": "2024-01-01T00:00:00Z", "type": "batch_complete", "images": 4}', "oops", "[1]", '{"type": "x", "ts": "bad"}', ""]
    write_bytes(f"{folder}/e.jsonl", "\n".join(lines).encode())
    rows = sources.read_events(spark, f"{folder}/e.jsonl").select("ts", "type", F.try_variant_get("payload", "$.images", "int").alias("n")).collect()
    assert [(r["type"], r["n"], r["ts"] is None) for r in rows] == [("batch_complete", 4, False), ("x", None, True)]


def test_read_manifests(spark, folder):
    transfer = {"operation": "ingest", "file_count": 1, "files": [{"path": "a\\b.png", "sha256": "ab", "size_bytes": 3}]}
    write_bytes(f"{folder}/t/m.json", json.dumps(transfer, indent=2).encode())
    assert [tuple(r) for r in sources.read_transfer_manifest(spark, f"{folder}/t").collect()] == [("a/b.png", "ab", 3)]
    assert sources.transfer_manifest_header(spark, f"{folder}/t").first()["operation"] == "ingest"
    entries = {"entries": {"img001": {"original_hash": "abc123", "source_path": "x\\img001.png", "processed_at": "2024-01-01T00:00:00Z"}}}
    write_bytes(f"{folder}/p/m.json", json.dumps(entries, indent=2).encode())
    row = sources.read_processed_manifest(spark, f"{folder}/p").first()
    assert (row["stem"], row["original_hash"], row["source_path"], row["output_hash"]) == ("img001", "abc123", "x/img001.png", None)


def audit_rows(spark, rows):
    return spark.createDataFrame(rows, "stem string, batch_id string, retry_count int, image string, updated_at timestamp")


def test_write_audit_defaults_and_replaces_batch(spark, folder):
    path = f"{folder}/audit"
    sinks.write_audit(audit_rows(spark, [("a", "b1", 0, None, None), ("b", "b2", 0, "b.png", None)]), path, now())
    sinks.write_audit(audit_rows(spark, [("a", "b1", 1, None, None), ("c", "b1", 0, None, None)]), path, now())
    sinks.write_audit(audit_rows(spark, [("a", "b1", 1, None, None), ("c", "b1", 0, None, None)]), path, now())
    got = by(sinks.audit_rows(spark, path).collect(), "stem")
    assert sorted(got) == ["a", "b", "c"] and got["a"]["retry_count"] == 1
    assert got["a"]["schema"] == AUDIT_SCHEMA_NAME and got["a"]["image"] == "a" and got["a"]["updated_at"].year == 2024


def test_upsert_audit_keeps_other_rows_of_the_batch(spark, folder):
    path = f"{folder}/audit"
    sinks.upsert_audit(spark, audit_rows(spark, [("a", "b1", 0, None, None), ("b", "b1", 0, None, None)]), path, now())
    sinks.upsert_audit(spark, audit_rows(spark, [("a", "b1", 2, None, None)]), path, now())
    assert {r["stem"]: r["retry_count"] for r in sinks.audit_rows(spark, path).collect()} == {"a": 2, "b": 0}


def test_master_audit_only_appends(spark, folder):
    path = f"{folder}/master"
    rows = spark.createDataFrame([("a.jpg", "pass", 0)], "image string, final_decision string, retry_count int")
    sinks.append_master_audit(rows, path)
    before = {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet")}
    sinks.append_master_audit(rows, path)
    assert all(os.path.getmtime(f"{path}/{f}") == t for f, t in before.items())
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path).columns == ["image", "decision", "retry_count"]


def test_batch_and_master_summaries(spark, folder):
    audit = spark.read.schema(" ".join(AUDIT_DDL.split())).json(
        spark.sparkContext.parallelize(
            [
                json.dumps({"image": "a.png", "batch_id": "batch_00001", "retry_count": 1,
                            "qa": {"final_decision": "fail", "final_route": "quarantine", "detection": {"max_det_score": 0.9, "ocr_lines": 2}},
                            "detections": {"text": {"count": 2}}, "success_metrics": {"text_regions_inpainted": 2}})
            ]
        )
    )
    sinks.write_batch_summary(batch_summary(audit), f"{folder}/summaries")
    row = spark.read.option("header", "true").csv(f"{folder}/summaries").first()
    assert row["batch_id"] == "batch_00001" and row["final_route"] == "quarantine" and row["max_ocr_score"] == "0.9"
    flat_row = master_row(audit).first()
    assert flat_row["text_regions_detected"] == 2 and flat_row["processing_status"] is None
    rows = spark.createDataFrame(
        [("a.png", 0, 0, "fail"), ("a.png", 1, 0, "pass"), ("b.png", 0, 1, "pass")],
        "image string, batch_index int, seq int, final_decision string",
    )
    sinks.write_master_summary(rows, f"{folder}/master")
    got = by(spark.read.option("header", "true").csv(f"{folder}/master").collect(), "image")
    assert got["a.png"]["final_decision"] == "pass" and len(got) == 2


def test_events_are_redacted_and_appended(spark, folder):
    path = f"{folder}/events"
    event = spark.createDataFrame([Row(type="transfer_start", note="password=hunter2", api_token="abc")])
    sinks.append_events(event, path)
    sinks.append_events(event, path, literals=["transfer_start"])
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert len(lines) == 2 and not any("hunter2" in line or "abc" in line for line in lines)
    assert sum("transfer_start" in line for line in lines) == 1


def test_run_scope(spark, folder):
    sinks.write_run_scope(spark, f"{folder}/scope", now(), max_items=10)
    sinks.write_run_scope(spark, f"{folder}/scope", now(), dry_run=True)
    rows = spark.read.json(f"{folder}/scope").collect()
    assert sorted(r["run_type"] for r in rows) == ["full", "pilot"]


def test_guarded_write(spark, folder):
    frame = spark.range(1)
    write = lambda df, target: df.write.parquet(target)
    for bad in (f"{folder}/raw", f"{folder}/raw/out", f"file:{folder}/raw/x", f"{folder}/ok/../raw/y"):
        with pytest.raises(ProtectedPathError):
            sinks.guarded_write(frame, bad, f"{folder}/raw", write)
    sinks.guarded_write(frame, f"{folder}/raw2/out", f"{folder}/raw", write)
    assert spark.read.parquet(f"{folder}/raw2/out").count() == 1
    assert is_under("s3://b/raw", "s3://b/raw/x") and not is_under("s3://b/raw", "s3://c/raw/x")


def exported(spark):
    items = spark.createDataFrame([(f"p/{s}.png", s, bytearray(s * 5, "ascii")) for s in "abcd"], "path string, stem string, content binary")
    audit = spark.createDataFrame(
        [("a", "pass"), ("b", "pass"), ("c", "fail"), ("d", "pass")], "stem string, d string"
    ).select("stem", F.lit("/tmp/secret").alias("decode_path"), F.struct(F.col("d").alias("final_decision")).alias("qa"))
    return items.withColumn("sha256", sha256_hex(F.col("content"))), audit


def test_export_only_passed_items(spark, folder):
    items, audit = exported(spark)
    summary = sinks.export_clean(spark, items, audit, folder, "2024-01-01").first()
    assert summary["ok"] and summary["verified_count"] == 3
    assert sorted(r["stem"] for r in sinks.read_export(spark, folder).collect()) == ["a", "b", "d"]
    at = sinks.current_export(spark, folder).folder
    assert "decode_path" not in spark.read.parquet(f"{at}/audit").columns
    header = spark.read.json(f"{at}/manifest").first()
    assert (header["file_count"], header["total_bytes"]) == (3, 15)
    files = spark.read.parquet(f"{at}/manifest_files")
    assert {r["path"] for r in files.collect()} == {"p/a.png", "p/b.png", "p/d.png"}


def _damage(stems):
    def write(df, path):
        bad = F.col("stem").isin(*stems(path))
        df.withColumn("content", F.when(bad, F.lit(b"x")).otherwise(F.col("content"))).write.mode("overwrite").parquet(path)

    return write


def test_export_repairs_mismatches_once(spark, folder):
    items, audit = exported(spark)
    writer = _damage(lambda path: ["a"] if path.endswith("attempt=0") else [""])
    assert sinks.export_clean(spark, items, audit, folder, "t", writer).first()["ok"]
    got = by(sinks.read_export(spark, folder).collect(), "stem")
    assert bytes(got["a"]["content"]) == b"aaaaa" and got["a"]["attempt"] == 1 and got["b"]["attempt"] == 0


def test_export_lists_persistent_failures(spark, folder):
    items, audit = exported(spark)
    summary = sinks.export_clean(spark, items, audit, folder, "t", _damage(lambda path: ["a"])).first()
    assert not summary["ok"] and summary["mismatched_count"] == 1 and summary["verified_count"] == 2
    assert [r["path"] for r in spark.read.json(f"{folder}/failures").collect()] == ["p/a.png"]


def test_readers_keep_their_version(spark, folder):
    items, audit = exported(spark)
    with pytest.raises(FileNotFoundError):
        sinks.read_export(spark, folder)
    sinks.export_clean(spark, items, audit, folder, "t1", _damage(lambda path: ["a"] if path.endswith("attempt=0") else [""]))
    opened, during = sinks.read_export(spark, folder), []

    def slow(df, path):
        df.write.parquet(path)
        during.append({bytes(r["content"]) for r in sinks.read_export(spark, folder).collect()})
        raise_now = len(during) == 1
        if raise_now:
            raise OSError("the writer died")

    changed = items.withColumn("content", F.concat("content", F.lit(b"!"))).withColumn("sha256", sha256_hex(F.col("content")))
    old, new = {b"aaaaa", b"bbbbb", b"ddddd"}, {b"aaaaa!", b"bbbbb!", b"ddddd!"}
    with pytest.raises(OSError, match="died"):
        sinks.export_clean(spark, changed, audit, folder, "t2", slow)
    assert during == [old] and len(sinks.exports(spark, folder)) == 1
    assert sinks.export_clean(spark, changed, audit, folder, "t3", slow).first()["ok"]
    assert during == [old, old] and {bytes(r["content"]) for r in opened.collect()} == old
    assert {bytes(r["content"]) for r in sinks.read_export(spark, folder).collect()} == new
    first, last = sinks.exports(spark, folder)
    assert (first.copies, last.copies) == (2, 1)
    assert {bytes(r["content"]) for r in sinks.read_export(spark, folder, first).collect()} == old
    sinks.forget_exports(spark, folder, keep=1)
    assert not os.path.exists(first.folder) and sinks.read_export(spark, folder).count() == 3


def test_items_run_once(spark, folder):
    items, audit = exported(spark)
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    judged = items.withColumn("final_decision", F.lit("pass"))
    assert sinks.export_clean(spark, judged.mapInArrow(count, judged.schema), audit, folder, "t").first()["ok"]
    assert runs.value == 4


def test_no_content_is_shuffled(spark, folder):
    items, audit = exported(spark)
    sinks.export_clean(spark, items, audit, folder, "t", _damage(lambda path: ["a"] if path.endswith("attempt=0") else [""]))
    plan = sinks.read_export(spark, folder)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert all("Broadcast" in line for line in shuffles) and "BroadcastHashJoin" in plan


def test_audit_from_sidecars_is_complete(spark, folder):
    record = {
        "integrity_hashes": {"source_sha256": "s", "output_sha256": "o"}, "retry_count": 0,
        "qa": {"final_decision": "pass"}, "actions": {"metadata_strip_method": "reencoded"},
    }
    write_bytes(f"{folder}/good.json", json.dumps(record).encode())
    outputs = spark.createDataFrame([("good", "o"), ("gone", "p")], "stem string, sha256 string")
    errors = audit_errors(outputs, audit_columns(sources.read_audit(spark, folder))).collect()
    assert [(r["stem"], r["error"]) for r in errors] == [("gone", "missing_audit")]
