"""Queries over QA decisions, routing, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.functions.batching import adaptive_batch_size
from redactflow.functions.progress import format_eta, progress_pct, recommendations, total_batches
from redactflow.functions.vectors import cosine_distance, cosine_similarity, l2_normalize
from redactflow.operators import qa as A
from redactflow.operators import reports as R
from redactflow.operators import route as X
from redactflow.operators.order import exact_percentiles
from redactflow.plans.registry import query
from redactflow.plans.views import Tables


def _judged(t: Tables) -> DataFrame:
    none = F.lit(None).cast("double")
    return t.qa.withColumns(
        {
            "detection_fail": A.detection_fail(F.col("max_score"), F.col("count")),
            "integrity_fail": A.integrity_fail(F.col("ssim"), none, none),
        }
    )


def _routed(t: Tables) -> DataFrame:
    decided = A.decide(_judged(t)).withColumn("retry_count", F.length("source") - 4)
    return X.route(decided)


@query(
    """SELECT doc_id, detection_fail, CASE WHEN detection_fail THEN 'readable_text_likely_remaining'
    ELSE 'no_high_confidence_text_detections' END AS reason FROM judged""",
    "judged",
)
def detection_fail(t: Tables) -> DataFrame:
    return _judged(t).select("doc_id", "detection_fail", A.detection_reason(F.col("detection_fail")).alias("reason"))


@query(
    """SELECT vec_id, round(distance, 6) AS distance, coalesce(distance < 0.35, FALSE) AS integrity_fail,
    CASE WHEN distance < 0.35 THEN 'artifact_or_identity_risk' ELSE 'integrity_ok' END AS reason FROM distances""",
    "distances",
)
def integrity_fail(t: Tables) -> DataFrame:
    none = F.lit(None).cast("double")
    out = t.distances.withColumn("integrity_fail", A.integrity_fail(none, F.col("distance"), none))
    return out.select("vec_id", "distance", "integrity_fail", A.integrity_reason(F.col("integrity_fail")).alias("reason"))


@query("SELECT doc_id, final_decision, failure_reason FROM decided", "decided")
def decide(t: Tables) -> DataFrame:
    return A.decide(_judged(t)).select("doc_id", "final_decision", "failure_reason")


@query(
    """SELECT doc_id, 4 * r AS extra_mask_dilation, CAST(least(0.35, 0.05 * r) AS DOUBLE) AS truncation_value,
    r >= 2 AS multi_modal_truncation, 20 + least(40, 5 * r) AS ldm_steps
    FROM (SELECT doc_id, n_chars % 12 AS r FROM documents)"""
)
def recycle_overrides(t: Tables) -> DataFrame:
    retry = (F.col("n_chars") % 12).cast("int")
    return t.documents.select("doc_id", A.recycle_overrides(retry).alias("o")).select(
        "doc_id", "o.extra_mask_dilation", F.col("o.truncation_value").cast("double").alias("truncation_value"),
        "o.multi_modal_truncation", "o.ldm_steps",
    )


@query("SELECT doc_id, final_decision, route, retry_count FROM routed", "routed")
def route(t: Tables) -> DataFrame:
    return _routed(t).select("doc_id", "final_decision", "route", "retry_count")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS stem, route, retry_count, failure_reason FROM routed
    UNION ALL SELECT 'error-' || CAST(vec_id AS VARCHAR), CASE WHEN label % 4 + 1 >= 3 THEN 'manual_review' ELSE 'quarantine' END,
    label % 4 + 1, 'processing_error:decode_failed' FROM embeddings""",
    "routed",
)
def route_errors(t: Tables) -> DataFrame:
    decided = A.decide(_judged(t)).select(
        F.col("doc_id").cast("string").alias("stem"), (F.length("source") - 4).alias("retry_count"), "final_decision",
        "failure_reason",
    )
    errors = t.embeddings.select(
        F.concat(F.lit("error-"), F.col("vec_id")).alias("stem"), (F.col("label") % 4).alias("retry_count"),
        F.lit("decode_failed").alias("error"),
    )
    return X.route_errors(decided, errors).select("stem", "route", "retry_count", "failure_reason")


@query(
    """SELECT count(*) AS images_in_master, count(*) FILTER (final_decision = 'pass') AS passed,
    count(*) FILTER (final_decision = 'fail') AS failed,
    round(count(*) FILTER (final_decision = 'pass') / count(*)::DOUBLE, 6) AS success_rate,
    count(*) FILTER (final_decision = 'pass') / count(*)::DOUBLE + 1e-9 >= 0.99 AS meets_target_success_rate,
    0.99::DOUBLE AS target_success_rate, CAST(sum(coalesce(count, 0)) AS BIGINT) AS sum_text_regions_detected,
    count(*) FILTER (toxic_flag) AS sum_face_gan_applied_flags
    FROM (SELECT *, coalesce(count = 1, FALSE) AS toxic_flag FROM decided)""",
    "decided",
)
def master_statistics(t: Tables) -> DataFrame:
    rows = A.decide(_judged(t)).select(
        "final_decision",
        F.coalesce(F.col("count").cast("string"), F.lit("n/a")).alias("text_regions_detected"),
        (F.col("count") == 1).alias("face_gan_applied"),
    )
    return R.master_statistics(rows)


@query(
    """SELECT count(*) AS items, round(count(*) FILTER (route = 'final_clean') / count(*)::DOUBLE, 6) AS pass_rate,
    round(count(*) FILTER (route = 'quarantine') / count(*)::DOUBLE, 6) AS quarantine_rate,
    CASE WHEN count(*) FILTER (route = 'final_clean') / count(*)::DOUBLE >= 0.95 THEN 'GO' ELSE 'NO-GO' END AS verdict,
    CASE WHEN count(*) FILTER (route = 'final_clean') / count(*)::DOUBLE < 0.95 THEN
      'QA pass rate ' || printf('%.1f%%', 100.0 * count(*) FILTER (route = 'final_clean') / count(*)) || ' below 95% target' END AS blocker,
    count(*) FILTER (route = 'quarantine') / count(*)::DOUBLE > 0.08 AS review_thresholds FROM routed""",
    "routed",
)
def readiness_gate(t: Tables) -> DataFrame:
    return R.readiness_gate(_routed(t))


@query(
    """SELECT batch_index, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'quarantine') AS quarantine,
    count(*) FILTER (outcome = 'manual_review') AS manual_review, count(*) FILTER (outcome <> 'pass') AS fail,
    count(*) AS routed FROM outcomes GROUP BY batch_index""",
    "outcomes",
)
def route_counts(t: Tables) -> DataFrame:
    return R.route_counts(t.outcomes)


@query(
    """SELECT batch_index, images, round(elapsed_sec, 6) AS elapsed_sec, round(elapsed_sec / images, 6) AS sec_per_image,
    round(CASE WHEN elapsed_sec > 0 THEN images / elapsed_sec ELSE 0.0 END, 6) AS images_per_sec FROM batches""",
    "batches",
)
def batch_metrics(t: Tables) -> DataFrame:
    return R.batch_metrics(t.batches).select("batch_index", "images", "elapsed_sec", "sec_per_image", "images_per_sec")


@query(
    """, s AS (SELECT CAST(sum(pass) AS BIGINT) AS p, CAST(sum(quarantine) AS BIGINT) AS q,
      CAST(sum(manual_review) AS BIGINT) AS m, sum(elapsed_sec) AS e, max(elapsed_sec) AS k FROM batches)
    SELECT p AS pass_count, q AS quarantine_count, m AS manual_review_count, round(e, 6) AS total_elapsed_sec,
    round(k, 6) AS peak, p + q + m AS total_routed, round(p / (p + q + m)::DOUBLE, 6) AS pass_rate,
    round(q / (p + q + m)::DOUBLE, 6) AS quarantine_rate, round(m / (p + q + m)::DOUBLE, 6) AS manual_review_rate,
    round(e / (p + q + m), 6) AS avg_sec_per_image, round((p + q + m) / e, 6) AS images_per_sec FROM s""",
    "batches",
)
def run_summary(t: Tables) -> DataFrame:
    return R.run_summary(t.batches, F.col("elapsed_sec"))


@query(
    """SELECT l_orderkey, round(max(0.80 + l_discount), 6) AS max_score, count(*) AS box_count,
    max(0.80 + l_discount) >= 0.85 AS fail FROM lineitem GROUP BY l_orderkey"""
)
def max_score_and_count(t: Tables) -> DataFrame:
    boxes = t.lineitem.select("l_orderkey", (F.lit(0.80) + F.col("l_discount")).alias("score"))
    stats = boxes.groupBy("l_orderkey").agg(F.max("score").alias("max_score"), F.count("*").alias("box_count"))
    return stats.withColumn("fail", A.detection_fail(F.col("max_score"), F.col("box_count")))


@query(
    """SELECT metric, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.95), 6) AS p95 FROM (
      SELECT 'discount' AS metric, l_discount AS value FROM lineitem
      UNION ALL SELECT 'price', l_extendedprice FROM lineitem) GROUP BY metric"""
)
def exact_percentiles_lineitem(t: Tables) -> DataFrame:
    slim = t.lineitem.select("l_discount", "l_extendedprice")
    return exact_percentiles(
        slim, {"discount": F.col("l_discount"), "price": F.col("l_extendedprice")}, [0.05, 0.5, 0.95]
    )


@query(
    """, s AS (SELECT quantile_cont(0.80 + l_discount, 0.5) AS t50, quantile_cont(0.80 + l_discount, 0.95) AS t95,
      quantile_cont(1 - l_tax, 0.05) AS s5, quantile_cont(1 - l_tax, 0.5) AS s50 FROM lineitem),
    d AS (SELECT quantile_cont(distance, 0.05) AS i5, quantile_cont(distance, 0.5) AS i50 FROM distances)
    SELECT round(t50, 6) AS text_p50, round(t95, 6) AS text_p95, round(s5, 6) AS ssim_p5, round(s50, 6) AS ssim_p50,
    round(i5, 6) AS identity_p5, round(i50, 6) AS identity_p50,
    round(greatest(0.85, t95), 3) AS text_score_fail, round(least(0.80, greatest(0.72, s5)), 3) AS ssim_min,
    round(least(0.5, i5), 3) AS identity_distance_min FROM s, d""",
    "distances",
)
def calibrate_thresholds(t: Tables) -> DataFrame:
    none = F.lit(None).cast("double")
    line = t.lineitem.select(
        (F.lit(0.80) + F.col("l_discount")).alias("text"), (1 - F.col("l_tax")).alias("ssim"), none.alias("identity")
    )
    faces = t.distances.select(none.alias("text"), none.alias("ssim"), F.col("distance").alias("identity"))
    scores = line.unionByName(faces)
    return A.calibrate_thresholds(scores, F.col("text"), F.col("ssim"), F.col("identity"))


@query(
    """SELECT count(*) FILTER (event_type <> 'view') AS inference_calls, count(*) FILTER (event_type = 'view') AS cache_hits,
    round(count(*) FILTER (event_type = 'view') / count(*)::DOUBLE, 6) AS cache_hit_rate,
    count(*) FILTER (event_type = 'view') AS calls_avoided FROM events"""
)
def cache_hit_stats(t: Tables) -> DataFrame:
    return R.cache_hit_stats(t.events, F.col("event_type") == "view")


@query(
    """SELECT l_returnflag AS operation, l_suppkey AS "offset", CAST(sum(l_linenumber) AS BIGINT) AS files,
    round(sum(l_quantity), 6) AS elapsed_sec, count(*) FILTER (l_linestatus = 'F') AS failures,
    round(sum(l_linenumber) / sum(l_quantity), 6) AS files_per_sec FROM lineitem GROUP BY 1, 2"""
)
def transfer_throughput(t: Tables) -> DataFrame:
    transfers = t.lineitem.select(
        F.col("l_returnflag").alias("operation"), F.col("l_suppkey").alias("offset"),
        F.col("l_linenumber").alias("count"), F.col("l_quantity").alias("elapsed_sec"),
        (F.col("l_linestatus") == "F").alias("failed"),
    )
    return R.transfer_throughput(transfers)


_TYPE = """CASE event_type WHEN 'error' THEN 'security_violation' WHEN 'purchase' THEN 'transfer_done'
    WHEN 'signup' THEN 'b2_upload' WHEN 'click' THEN 'batch_complete' ELSE event_type END"""


def _typed(t: Tables) -> DataFrame:
    names = {"error": "security_violation", "purchase": "transfer_done", "signup": "b2_upload", "click": "batch_complete"}
    kind = F.col("event_type")
    renamed = kind
    for old, new in names.items():
        renamed = F.when(kind == old, F.lit(new)).otherwise(renamed)
    return t.events.withColumn("type", renamed)


@query(
    f"""SELECT count(*) FILTER (starts_with(type, 'security_')) AS security_event_count,
    count(*) FILTER (starts_with(type, 'transfer_') OR starts_with(type, 'b2_')) AS transfer_event_count,
    max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS peak FROM (SELECT *, {_TYPE} AS type FROM events)"""
)
def event_summary(t: Tables) -> DataFrame:
    return R.event_summary(_typed(t), F.get_json_object("props", "$.k"))


@query(
    f"""SELECT event_id, category, nth FROM (SELECT event_id, category,
      row_number() OVER (PARTITION BY category ORDER BY ts DESC, event_id DESC) AS nth FROM (
      SELECT event_id, ts, CASE WHEN starts_with(type, 'security_') THEN 'security'
        WHEN starts_with(type, 'transfer_') THEN 'transfer' WHEN type = 'batch_complete' THEN 'batch' END AS category
      FROM (SELECT *, {_TYPE} AS type FROM events)) WHERE category IS NOT NULL)
    WHERE nth <= CASE category WHEN 'security' THEN 15 ELSE 10 END"""
)
def latest_per_type(t: Tables) -> DataFrame:
    events = _typed(t).select("event_id", "ts", "type")
    out = R.latest_per_type(events, R.event_category(F.col("type")), [F.col("ts"), F.col("event_id")])
    return out.select("event_id", "category", "nth")


@query(
    """SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1"""
)
def last_per_image(t: Tables) -> DataFrame:
    last = R.last_per_image(t.conversations, "conv_id", ["turn"])
    return last.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


_PROGRESS = """, tot AS (SELECT run_id, count(*) AS total FROM outcomes GROUP BY run_id),
    prog AS (SELECT b.run_id, batch_index, images, elapsed_sec, total,
      CAST(sum(images) OVER w AS BIGINT) AS pc, CAST(sum(CAST(elapsed_sec AS DECIMAL(20, 4))) OVER w AS DOUBLE) AS ec,
      CAST(sum(quarantine) OVER w AS BIGINT) AS qc, CAST(sum(pass + quarantine + manual_review) OVER w AS BIGINT) AS rc
      FROM batches b JOIN tot USING (run_id)
      WINDOW w AS (PARTITION BY b.run_id ORDER BY batch_index ROWS UNBOUNDED PRECEDING))"""


def _progress(t: Tables) -> DataFrame:
    """Elapsed times as exact decimals, so that the order of addition does not show."""
    totals = t.outcomes.groupBy("run_id").agg(F.count("*").alias("total"))
    timings = t.batches.withColumn("elapsed_sec", F.col("elapsed_sec").cast("decimal(20,4)"))
    run = R.running_progress(timings.join(totals, "run_id"), F.col("total"))
    return run.withColumn("elapsed_cumulative", F.col("elapsed_cumulative").cast("double"))


@query(
    _PROGRESS
    + """ SELECT run_id, batch_index, pc AS processed_cumulative, round(ec, 6) AS elapsed_cumulative,
    qc AS quarantine_cumulative, rc AS routed_cumulative, round(qc / rc::DOUBLE, 6) AS quarantine_rate_cumulative,
    round(pc / ec, 6) AS images_per_sec_so_far, round((total - pc) / (pc / ec), 6) AS eta_sec FROM prog""",
    "batches",
)
def running_progress(t: Tables) -> DataFrame:
    return _progress(t).select(
        "run_id", "batch_index", "processed_cumulative", "elapsed_cumulative", "quarantine_cumulative",
        "routed_cumulative", "quarantine_rate_cumulative", "images_per_sec_so_far", "eta_sec",
    )


@query(
    _PROGRESS
    + """, f AS (SELECT *, CAST(floor((total - pc) / (pc / ec) * 37) AS BIGINT) AS s FROM prog)
    SELECT run_id, batch_index, round(100.0 * least(pc, total) / total, 2) AS progress_pct,
    greatest(1, CAST(ceil((total - pc) / 64.0) AS BIGINT)) AS batches_left,
    CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
      WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS eta FROM f""",
    "batches",
)
def progress_texts(t: Tables) -> DataFrame:
    done = F.col("processed_cumulative")
    return _progress(t).select(
        "run_id",
        "batch_index",
        progress_pct(done, F.col("total")).alias("progress_pct"),
        total_batches(F.col("total") - done, F.lit(64)).alias("batches_left"),
        format_eta(F.col("eta_sec") * 37).alias("eta"),
    )


@query(
    """, m AS (SELECT run_id, avg(sec_per_image) AS a FROM timed GROUP BY run_id)
    SELECT t.run_id, batch_index, round(sec_per_image, 6) AS sec_per_image, round(a, 6) AS avg_sec_per_image,
    'slow_batch_outlier' AS reason FROM timed t JOIN m USING (run_id) WHERE sec_per_image >= 1.75 * a AND a > 0
    UNION ALL SELECT run_id, NULL, NULL, round(a, 6), 'high_avg_latency' FROM m WHERE a > 5""",
    "timed",
)
def bottlenecks(t: Tables) -> DataFrame:
    return R.bottlenecks(R.batch_metrics(t.batches))


@query(
    """SELECT run_id, len(advice) AS advice_count, array_to_string(advice, ' / ') AS texts FROM (
    SELECT run_id, [x FOR x IN [
      CASE WHEN a > 3.0 THEN printf('Average %.2fs/item is high: add executors or raise batch_size (current max 64).', a) END,
      CASE WHEN a < 1.0 AND NOT a > 3.0 THEN 'Throughput headroom: batch size can grow on large queues.' END,
      CASE WHEN q > 0.05 THEN printf('Quarantine rate %.1f%% exceeds 5%%: calibrate thresholds and review ssim_min (typical range 0.72-0.80).', 100 * q) END,
      CASE WHEN p < 0.95 THEN printf('Pass rate %.1f%% below 95%%: review QA thresholds and screening rejects.', 100 * p) END,
      'Detection cache hit rate 60%: repeated scans avoided.'] IF x IS NOT NULL] AS advice
    FROM (SELECT run_id, sum(elapsed_sec) / sum(images) AS a, sum(quarantine) / sum(images)::DOUBLE AS q,
      sum(pass) / sum(images)::DOUBLE AS p FROM batches GROUP BY run_id))""",
    "batches",
)
def recommendations_per_run(t: Tables) -> DataFrame:
    run = t.batches.groupBy("run_id").agg(
        (F.sum("elapsed_sec") / F.sum("images")).alias("a"),
        (F.sum("quarantine") / F.sum("images")).alias("q"),
        (F.sum("pass") / F.sum("images")).alias("p"),
    )
    texts = recommendations(F.col("a"), F.col("q"), F.col("p"), F.lit(0.6))
    return run.select("run_id", texts.alias("texts")).select(
        "run_id", F.size("texts").alias("advice_count"), F.array_join("texts", " / ").alias("texts")
    )


@query("SELECT stem, attempt, decision, event_id FROM attempts", "attempts")
def number_attempts(t: Tables) -> DataFrame:
    return t.attempts.select("stem", "attempt", "decision", "event_id")


_RETRY_STATE = """SELECT stem, CAST(max(fails) AS BIGINT) AS retry_count, arg_max(route, attempt) AS route,
    max(attempt) AS settled_attempt FROM settling GROUP BY stem"""


@query(_RETRY_STATE, "settling")
def retry_state(t: Tables) -> DataFrame:
    return X.retry_state(t.hard_attempts)


@query(
    """SELECT stem, attempt, decision FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY attempt DESC) AS n
    FROM attempts) WHERE n = 1""",
    "attempts",
)
def latest_attempt(t: Tables) -> DataFrame:
    return X.latest_attempt(t.attempts).select("stem", "attempt", "decision")


@query(
    """SELECT o_orderpriority, count(*) AS pending, CASE WHEN count(*) >= 5000 THEN 64 WHEN count(*) >= 1000 THEN 48
    ELSE 32 END AS batch_size FROM orders GROUP BY o_orderpriority"""
)
def adaptive_batch_sizes(t: Tables) -> DataFrame:
    queues = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("pending"))
    return queues.withColumn("batch_size", adaptive_batch_size(F.col("pending")))


@query("SELECT vec_id, round(1.0 - distance, 6) AS similarity, round(distance, 6) AS distance FROM distances", "distances")
def cosine_distances(t: Tables) -> DataFrame:
    return t.pairs.select(
        "vec_id",
        cosine_similarity(F.col("a"), F.col("b")).alias("similarity"),
        cosine_distance(F.col("a"), F.col("b")).alias("distance"),
    )


@query(
    """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / (n + 1e-8), 6) AS first_value, round(n2, 6) AS squared_length FROM (
    SELECT *, list_sum([(CAST(x AS DOUBLE) / (n + 1e-8)) * (CAST(x AS DOUBLE) / (n + 1e-8)) for x in embedding]) AS n2
    FROM (SELECT *, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])) AS n FROM embeddings))"""
)
def l2_normalized(t: Tables) -> DataFrame:
    unit = t.embeddings.select("vec_id", l2_normalize(F.col("embedding")).alias("u"))
    squared = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x)
    return unit.select("vec_id", F.get("u", F.lit(0)).alias("first_value"), squared.alias("squared_length"))
