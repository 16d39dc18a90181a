import pytest
from pyspark.sql import functions as F

from redactflow.config import Settings
from redactflow.operators import qa, queue, reports, route
from tests.helpers import by


def stems(frame):
    return sorted(r["stem"] for r in frame.collect())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pending_queue_rules(spark):
    raw = frame(spark, [(s, f"raw/{s}.jpg") for s in "abcdefgh"] + [("a", "raw/a.png")], "stem string, path string")
    held = frame(
        spark,
        [("a", "quarantine/a.jpg", 2), ("i", "quarantine/i.jpg", None), ("j", "quarantine/j.jpg", 3)],
        "stem string, path string, retry_count int",
    )
    clean_or_manual = frame(spark, [("b",), ("c",), ("c",)], "stem string")  # c: sent to manual review
    pending = queue.pending_queue(
        raw, held, clean_or_manual,
        locked=frame(spark, [("d",)], "stem string"),
        processed=frame(spark, [("e",)], "stem string"),
        rejected=frame(spark, [("f",)], "stem string"),
    )
    got = by(pending.collect(), "stem")
    # items in manual review and screened-out items never come back; exhausted ones have no retry left
    assert sorted(got) == ["a", "g", "h", "i"]
    assert got["a"]["path"] == "quarantine/a.jpg" and got["a"]["retry_count"] == 2  # retry before raw
    assert got["g"]["priority"] == 1


def test_skip_set_needs_same_hash(spark):
    manifest = frame(spark, [("a", "AA"), ("b", "bb"), ("c", "cc"), ("d", None)], "stem string, original_hash string")
    outputs = frame(spark, [("a",), ("b",), ("d",)], "stem string")
    current = frame(spark, [("a", "aa"), ("b", "changed"), ("c", "cc"), ("d", None)], "stem string, sha256 string")
    assert stems(queue.skip_set(manifest, outputs, current)) == ["a"]


LOCKS = [
    (1, ["a", "b"], "2024-01-01T01:30:00Z"),  # fresh
    (2, ["c"], "2024-01-01T00:00:00Z"),  # stale
    (3, ["d"], "2024-01-01T01:59:00Z"),  # completed
    (4, ["e"], "not a time"),  # unreadable start counts as stale
]


def test_locks_fresh_stale_completed_unreadable(spark):
    locks = frame(spark, LOCKS, "batch_index int, stems array<string>, started_at string")
    done = frame(spark, [(3,)], "batch_index int")
    now = F.to_timestamp(F.lit("2024-01-01 02:00:00"))
    assert stems(queue.active_locks(locks, done, now)) == ["a", "b"]
    resumable = queue.resumable_batches(locks, done, now)
    assert sorted(r["batch_index"] for r in resumable.collect()) == [2, 4]


def test_unfinished_items_and_lock_progress(spark):
    items = frame(spark, [(1, "a"), (1, "b"), (1, "c"), (2, "a")], "batch_index int, stem string")
    completed = frame(spark, [(1, "a")], "batch_index int, stem string")
    outputs = frame(spark, [(1, "b"), (1, "a")], "batch_index int, stem string")
    left = queue.unfinished_items(items, completed, outputs).collect()
    assert sorted((r["batch_index"], r["stem"]) for r in left) == [(1, "c"), (2, "a")]
    lock = frame(spark, [(1, ["a", "b", "c"], ["a"])], "batch_index int, stems array<string>, completed_stems array<string>")
    row = queue.lock_progress(lock, F.array(F.lit("b"))).first()
    assert row["completed_stems"] == ["a", "b"] and row["open_stems"] == ["c"]


def test_assign_batches_and_cap(spark):
    items = spark.range(100).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("stem"))
    rows = queue.assign_batches(items, [F.col("stem")], 32).orderBy("stem").collect()
    assert [r["batch_index"] for r in rows] == [i // 32 for i in range(100)]
    small = queue.pilot_cap(items, 5, [F.col("stem")])
    assert stems(small) == [f"s{i:03d}" for i in range(5)]
    assert stems(queue.within_cap(items, small)) == stems(small)


def test_large_cap_by_rank(spark, monkeypatch):
    monkeypatch.setattr(queue, "TOP_N_LIMIT", 3)
    items = spark.range(50).select(F.col("id").alias("stem"))
    assert stems(queue.pilot_cap(items, 10, [F.col("stem")])) == list(range(10))


def test_rank_limit_runs_before_the_shuffle(spark):
    hot = F.when(F.col("id") % 3 != 0, "s").otherwise(F.col("id").cast("string"))
    raw = spark.range(10).select(hot.alias("stem"), F.col("id").cast("string").alias("path"), (F.col("id") % 2).alias("priority"))
    plan = queue.first_per_stem(raw)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- routing -----------------------------------------------------------------------------------------------


def test_retry_two_then_fail_goes_to_manual_review(spark):
    rows = frame(spark, [("a", "fail", 2), ("b", "fail", 0), ("c", "pass", 2), ("d", "fail", None)], "stem string, final_decision string, retry_count int")
    got = by(route.route(rows).collect(), "stem")
    assert (got["a"]["route"], got["a"]["retry_count"]) == ("manual_review", 3)
    assert (got["b"]["route"], got["b"]["retry_count"]) == ("quarantine", 1)
    assert (got["c"]["route"], got["c"]["retry_count"], got["c"]["next_pass_overrides"]) == ("final_clean", 2, None)
    assert got["d"]["retry_count"] == 1
    assert got["a"]["next_pass_overrides"].asDict() == {
        "extra_mask_dilation": 12, "truncation_value": pytest.approx(0.15), "multi_modal_truncation": True, "ldm_steps": 35,
    }


def test_processing_errors_use_up_the_budget(spark):
    schema = "stem string, final_decision string, failure_reason string, retry_count int"
    errors = frame(spark, [("bad", 0, "decode_failed"), ("worse", 2, None)], "stem string, retry_count int, error string")
    got = by(route.route_errors(frame(spark, [("ok", "pass", None, 0)], schema), errors).collect(), "stem")
    assert got["ok"]["route"] == "final_clean"
    assert (got["bad"]["route"], got["bad"]["retry_count"]) == ("quarantine", 1)
    assert (got["worse"]["route"], got["worse"]["failure_reason"]) == ("manual_review", "processing_error:unknown")


def test_retry_state_settles_once(spark):
    log = {
        "pass_first": "PF", "two_fails_pass": "FFP", "exhausted": "FFFP", "open": "FF", "late": "FPFFF", "long": "F" * 20 + "P",
    }
    rows = [(s, i, "pass" if d == "P" else "fail") for s, text in log.items() for i, d in enumerate(text, 1)]
    got = by(route.retry_state(frame(spark, rows, "stem string, attempt int, decision string")).collect(), "stem")
    state = {s: (r["route"], r["retry_count"], r["settled_attempt"]) for s, r in got.items()}
    assert state == {
        "pass_first": ("final_clean", 0, 1),
        "two_fails_pass": ("final_clean", 2, 3),
        "exhausted": ("manual_review", 3, 3),
        "open": ("quarantine", 2, 2),
        "late": ("final_clean", 1, 2),
        "long": ("manual_review", 3, 3),
    }


def test_regions_inpainted_zero_when_redaction_failed(spark):
    rows = frame(spark, [(3, True), (3, False), (3, None), (None, True)], "n int, ok boolean")
    got = [r["x"] for r in rows.select(route.regions_inpainted(F.col("n"), F.col("ok")).alias("x")).collect()]
    assert got == [3, 0, 0, 0]


# --- QA ----------------------------------------------------------------------------------------------------


def test_integrity_missing_original(spark):
    rows = frame(spark, [(None, None, None), (0.9, 0.5, 0.05), (0.7, None, None), (None, 0.2, None), (None, None, 0.2)], "s double, d double, e double")
    cols = F.col("s"), F.col("d"), F.col("e")
    assert [r["x"] for r in rows.select(qa.integrity_fail(*cols).alias("x")).collect()] == [False, False, True, True, True]
    strict = qa.integrity_fail(*cols, on_missing="fail")
    assert [r["x"] for r in rows.select(strict.alias("x")).collect()][0] is True


def test_required_output_face(spark):
    rows = frame(spark, [(0, 2), (1, 2), (0, 0)], "out int, inp int")
    need = Settings(min_output_face=1)
    cond = qa.identity_fail(F.lit(None).cast("double"), F.col("out"), F.col("inp"), need)
    assert [r["x"] for r in rows.select(cond.alias("x")).collect()] == [True, False, False]
    assert not any(r["x"] for r in rows.select(qa.identity_fail(F.lit(None).cast("double"), F.col("out"), F.col("inp")).alias("x")).collect())


def test_decide_reasons_and_extra_rules(spark):
    rows = frame(spark, [(True, True, 1), (False, True, 1), (False, False, 9), (False, False, None)], "detection_fail boolean, integrity_fail boolean, n int")
    got = qa.decide(rows, {"too_many": F.col("n") > 5}).collect()
    assert [r["final_decision"] for r in got] == ["fail", "fail", "fail", "pass"]
    assert got[0]["failure_reason"] == (
        "detection_verification:readable_text_likely_remaining | identity_integrity:artifact_or_identity_risk"
    )
    assert got[2]["failure_reason"] == "rule:too_many" and got[3]["failure_reason"] is None


def test_calibration_empty_and_approximate(spark):
    none = frame(spark, [], "t double, s double, i double")
    row = qa.calibrate_thresholds(none, F.col("t"), F.col("s"), F.col("i")).first()
    assert (row["text_score_fail"], row["ssim_min"], row["identity_distance_min"], row["text_p95"]) == (0.85, 0.75, 0.35, 0.0)
    some = spark.range(1001).select((F.col("id") / 1000).alias("v"))
    exact = qa.calibrate_thresholds(some, F.col("v"), F.col("v"), F.col("v")).first()
    close = qa.calibrate_thresholds(some, F.col("v"), F.col("v"), F.col("v"), approximate=True).first()
    assert exact["text_p95"] == pytest.approx(0.95) and exact["ssim_min"] == 0.72 and exact["identity_distance_min"] == 0.05
    assert close["text_p95"] == pytest.approx(exact["text_p95"], abs=2e-3)


# --- reports -----------------------------------------------------------------------------------------------


def test_failures_count_once_in_rates(spark):
    rows = [(0, "final_clean")] * 8 + [(0, "quarantine")] + [(0, "manual_review")]
    counts = reports.route_counts(frame(spark, rows, "batch_index int, route string")).first()
    assert (counts["pass"], counts["fail"], counts["routed"]) == (8, 2, 10)
    timing = reports.route_counts(frame(spark, rows, "batch_index int, route string")).withColumn("elapsed_sec", F.lit(5.0))
    summary = reports.run_summary(timing).first()
    assert summary["pass_rate"] == 0.8 and summary["images_per_sec"] == 2.0


def test_empty_reports(spark):
    none = frame(spark, [], "final_decision string, text_regions_detected string, face_gan_applied boolean")
    row = reports.master_statistics(none).first()
    assert (row["images_in_master"], row["success_rate"], row["meets_target_success_rate"]) == (0, 0.0, False)
    assert row["sum_text_regions_detected"] == 0


def test_bottlenecks_flags_slow_mean(spark):
    rows = [("r", i, 6.0) for i in range(9)] + [("r", 9, 30.0), ("q", 0, 1.0)]
    got = reports.bottlenecks(frame(spark, rows, "run_id string, batch_index int, sec_per_image double")).collect()
    assert sorted((r["run_id"], r["batch_index"], r["reason"]) for r in got if r["batch_index"] is not None) == [("r", 9, "slow_batch_outlier")]
    assert [r["run_id"] for r in got if r["reason"] == "high_avg_latency"] == ["r"]


def test_running_progress_zero_speed(spark):
    rows = [("r", 0, 0, 1.0, 0, 0, 0), ("r", 1, 10, 4.0, 8, 2, 0)]
    timing = frame(spark, rows, "run_id string, batch_index int, images int, elapsed_sec double, pass int, quarantine int, manual_review int")
    got = by(reports.running_progress(timing, F.lit(30)).collect(), "batch_index")
    assert got[0]["eta_sec"] is None and got[0]["quarantine_rate_cumulative"] == 0.0
    assert got[1]["eta_sec"] == pytest.approx(10.0) and got[1]["quarantine_rate_cumulative"] == pytest.approx(0.2)


def test_residual_gate_uses_scores(spark):
    clean = frame(spark, [("a", 0, 0.2), ("b", 0, 0.84)], "stem string, face_count int, max_score double")
    assert reports.residual_gate(clean, F.lit(True)).first()["status"] == "PASS"
    assert reports.residual_gate(clean, F.lit(False)).first()["status"] == "FAIL"
    assert reports.residual_gate(clean.limit(0), F.lit(True)).first()["status"] == "FAIL"
    dirty = frame(spark, [("a", 1, 0.0), ("b", 0, 0.85), ("c", 0, 0.1)], "stem string, face_count int, max_score double")
    assert stems(reports.residual_hits(dirty)) == ["a", "b"]
    assert reports.residual_gate(dirty, F.lit(True)).first()["status"] == "FAIL"


def test_dry_run_plan_with_cap_and_integrity(spark):
    pending = spark.range(1500).select(F.col("id").cast("string").alias("stem"), F.format_string("raw/%04d.jpg", "id").alias("path"))
    check = frame(spark, [(3, 2, 1, False)], "checked bigint, verified bigint, corrupt bigint, ok boolean")
    row = reports.dry_run_plan(pending, 1200, check).first()
    assert (row["pending_count"], row["run_type"], row["batch_size"]) == (1200, "pilot", 48)
    assert row["first_names"] == [f"{i:04d}.jpg" for i in range(20)]
    assert row["integrity"]["corrupt"] == 1
    assert reports.dry_run_plan(pending).first()["run_type"] == "full"
