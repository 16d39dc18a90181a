import pytest
from pyspark.sql import functions as F

from redactflow.operators import retention, verify
from tests.helpers import by


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


HASHES = "path string, sha256 string"


def test_verify_hashes(spark):
    expected = frame(spark, [("a\\x.png", "AB"), ("b", "cd"), ("c", "ef"), ("d", "11"), ("d", "22"), ("e", "55")], HASHES)
    actual = frame(spark, [("a/x.png", "ab"), ("b", "CE"), ("d", "11"), ("e", "55"), ("e", "56"), ("z", "99")], HASHES)
    got = by(verify.verify_hashes(expected, actual).collect(), "path")
    assert {p: r["status"] for p, r in got.items()} == {
        "a/x.png": "verified", "b": "mismatched", "c": "missing", "d": "mismatched", "e": "mismatched",
    }
    summary = verify.hash_summary(verify.verify_hashes(expected, actual)).first()
    assert (summary["verified_count"], summary["missing_count"], summary["mismatched_count"], summary["ok"]) == (1, 1, 3, False)


def test_verify_export_counts_both_sides(spark):
    source = frame(spark, [("a", "1"), ("b", "2")], HASHES)
    target = frame(spark, [("a", "1"), ("b", "2"), ("extra", "3")], HASHES)
    row = verify.verify_export(source, target).first()
    assert (row["source_count"], row["target_count"], row["ok"]) == (2, 3, True)


def test_verify_listing_shows_fifty(spark):
    manifest = frame(spark, [("keep",)], "path string")
    listing = spark.range(60).select(F.format_string("extra%02d", "id").alias("path")).union(manifest)
    row = verify.verify_listing(manifest, listing).first()
    assert row["ok"] and row["extra_count"] == 60 and row["extra_shown"] == [f"extra{i:02d}" for i in range(50)]
    assert not verify.verify_listing(manifest, listing.filter("path != 'keep'")).first()["ok"]


def test_source_changes(spark):
    before = frame(spark, [("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], HASHES)
    after = frame(spark, [("a", "1"), ("b", "9"), ("d", "4"), ("n", None)], HASHES)
    got = {p: r["status"] for p, r in by(verify.source_changes(before, after).collect(), "path").items()}
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added", "n": "unchanged"}
    assert verify.source_unchanged(before, before).first()["originals_untouched"] is True
    # a new file is reported but leaves the originals untouched
    assert verify.source_unchanged(before, before.union(frame(spark, [("x", "0")], HASHES))).first()["originals_untouched"] is True


def test_merge_manifest_keeps_untouched_fields(spark):
    schema = "stem string, original_hash string, source_path string, output_hash string"
    old = frame(spark, [("img001", "old", "img001.png", "out1"), ("img003", "h3", "img003.png", None)], schema)
    new = frame(
        spark, [("img001", "abc123", "img001.png"), ("img002", "def456", "img002.png")],
        "stem string, original_hash string, source_path string",
    )
    got = by(verify.merge_manifest(old, new).collect(), "stem")
    assert got["img001"]["original_hash"] == "abc123" and got["img001"]["output_hash"] == "out1"
    assert got["img002"]["output_hash"] is None and got["img003"]["original_hash"] == "h3"


def test_audit_errors(spark):
    outputs = frame(spark, [("a", "1"), ("b", "2"), ("c", "3")], "stem string, sha256 string")
    audit = frame(
        spark,
        [("a", "s", "1", "pass", 0, "chunks_dropped"), ("b", "s", "9", None, None, "none")],
        "stem string, source_sha256 string, output_sha256 string, final_decision string, retry_count int, strip_method string",
    )
    got = sorted((r["stem"], r["error"]) for r in verify.audit_errors(outputs, audit).collect())
    assert got == [
        ("b", "missing_final_decision"), ("b", "missing_retry_count"), ("b", "output_hash_mismatch"),
        ("b", "unexpected_strip_method"), ("c", "missing_audit"),
    ]


DETECTIONS = "stem string, kind string, polygon array<array<float>>, text string, score double"


@pytest.mark.parametrize("per_row", [4096, 50])
def test_attach_detections_keeps_all_boxes(spark, per_row):
    rows = [("hot", "text", [[float(i), 0.0]], f"t{i}", 0.5) for i in range(400)]
    rows += [("cool", "text", [[1.0, 1.0]], "one", 0.9)]
    items = frame(spark, [("hot",), ("cool",), ("bare",)], "stem string")
    got = verify.attach_detections(items, frame(spark, rows, DETECTIONS), per_row).collect()
    texts = sorted(b["text"] for r in got if r["stem"] == "hot" for b in r["boxes"])
    assert texts == sorted(f"t{i}" for i in range(400))
    assert [len(r["boxes"]) for r in got if r["stem"] == "cool"] == [1]
    assert [r["boxes"] for r in got if r["stem"] == "bare"] == [[]]
    hot = [r for r in got if r["stem"] == "hot"]
    assert len(hot) == hot[0]["parts"] == (1 if per_row == 4096 else 8)
    assert max(len(r["boxes"]) for r in hot) < (401 if per_row == 4096 else 100)


def test_new_and_failed_items(spark):
    before, after = frame(spark, [("a",), ("b",)], "path string"), frame(spark, [("b",), ("c",), ("c",)], "path string")
    assert [r["path"] for r in verify.new_items(before, after).collect()] == ["c"]
    assert [r["path"] for r in verify.failed_items(before, after).collect()] == ["a"]


RETENTION = [
    ("final_clean", ".gitkeep", False, False, "preserve:gitkeep"),
    ("final_clean", "Manifest.JSON", False, False, "preserve:production_manifest"),
    ("final_clean", "__pycache__", True, True, "junk_dir"),
    ("final_clean", "test_run", True, True, "test_dir_name"),
    ("final_clean", "2024", True, False, "preserve:directory"),
    ("final_clean", "Thumbs.db", False, True, "junk_file"),
    ("final_clean", "m.pyc", False, True, "junk_file"),
    ("final_clean", "PERF_001.jpg", False, True, "test_name_marker"),
    ("final_clean", "a/b/holiday.webp", False, False, "preserve:production_media"),
    ("final_clean", "holiday.json", False, False, "preserve:metadata_sidecar"),
    ("final_clean", "notes.md", False, False, "preserve:unknown_conservative"),
    ("logs/batch_summaries", "batch_00012.csv", False, False, "preserve:production_batch_summary"),
    ("logs/batch_summaries", "batch_00012_resume.csv", False, False, "preserve:production_batch_summary"),
    ("logs/batch_summaries", "my_debug.csv", False, True, "test_name_marker"),
    ("logs/batch_summaries", "latest.log", False, True, "test_log"),
    ("logs/batch_summaries", "x.log", False, False, "preserve:unknown_conservative"),
    ("temp_processed", "batch_00001", True, True, "temp_batch_dir"),
    ("temp_processed", "_work", True, True, "ephemeral_dir"),
    ("temp_processed", "batch_00001/inner", True, True, "inside_batch_dir"),
    ("temp_processed", "other", True, False, "preserve:directory"),
    ("temp_processed", "batch_00001/a.processing.lock", False, True, "batch_lock_file"),
    ("temp_processed", "a.processing.lock", False, False, "preserve:root_lock"),
    ("temp_processed", "batch_00001/x.jpg", False, True, "inside_batch_dir"),
    ("temp_processed", "cache/x.bin", False, True, "ephemeral_content"),
    ("temp_processed", "loose.bin", False, True, "temp_root_loose_file"),
    ("temp_processed", "other/x.bin", False, False, "preserve:unknown_conservative"),
    ("elsewhere", "test_x.jpg", False, False, "preserve:unknown_conservative"),
]


def test_retention_rules(spark):
    files = frame(spark, [(r, p, d, 10) for r, p, d, _, _ in RETENTION], "root string, rel_path string, is_dir boolean, size_bytes bigint")
    plan = retention.retention_plan(files)
    got = {(r["root"], r["rel_path"]): (r["delete"], r["reason"]) for r in plan.collect()}
    assert got == {(r, p): (x, why) for r, p, _, x, why in RETENTION}
    totals = {r["root"]: r for r in retention.retention_rollup(plan).collect()}
    doomed = [r for r in RETENTION if r[3]]
    assert totals[None]["files"] + totals[None]["dirs"] == len(doomed) and totals[None]["bytes"] == 10 * len(doomed)
    assert totals["logs/batch_summaries"]["files"] == 2


def test_drop_test_rows(spark):
    audit = frame(spark, [("gpu_rt_1.jpg",), ("real.jpg",), (None,), ("sample_9",)], "image string")
    kept, report = retention.drop_test_rows(audit)
    assert sorted(str(r["image"]) for r in kept.collect()) == ["None", "real.jpg"]
    assert tuple(report.first()) == (2, 2)
