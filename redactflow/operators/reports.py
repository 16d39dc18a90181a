"""Metrics and reports: global and per-batch aggregates, running progress, outliers, recent events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.functions.batching import adaptive_batch_size
from redactflow.functions.names import basename, fixed
from redactflow.operators.joins import join_small
from redactflow.operators.order import running_by_index
from redactflow.operators.queue import pilot_cap
from redactflow.session import cut_lineage

ROUTES = {"pass": "final_clean", "quarantine": "quarantine", "manual_review": "manual_review"}


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _int_sum(column: Column) -> Column:
    number = F.coalesce(column.cast("string").try_cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(number), F.lit(0.0)).cast("bigint")


def master_statistics(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Totals over the master report; text that is not a number counts as 0."""
    n = F.count("*")
    passed = F.count_if(F.col("final_decision") == "pass")
    rate = _rate(passed, n)
    sums = {
        f"sum_{c}": _int_sum(F.col(c))
        for c in ("text_regions_inpainted", "text_regions_detected", "original_face_count")
        if c in rows.columns
    }
    if "face_gan_applied" in rows.columns:
        sums["sum_face_gan_applied_flags"] = F.count_if(F.col("face_gan_applied").cast("boolean"))
    return rows.agg(
        n.alias("images_in_master"),
        passed.alias("passed"),
        F.count_if(F.col("final_decision") == "fail").alias("failed"),
        F.round(rate, 6).alias("success_rate"),
        ((n > 0) & (rate + 1e-9 >= settings.min_success_rate)).alias("meets_target_success_rate"),
        F.lit(settings.min_success_rate).alias("target_success_rate"),
        *[c.alias(name) for name, c in sums.items()],
    )


def route_counts(routed: DataFrame, batch: str = "batch_index") -> DataFrame:
    """Per batch: pass, quarantine, manual_review; ``fail`` is derived and ``routed`` never counts an item twice."""
    out = routed.groupBy(batch).agg(
        *[F.count_if(F.col("route") == folder).alias(name) for name, folder in ROUTES.items()]
    )
    return out.withColumns(
        {
            "fail": F.col("quarantine") + F.col("manual_review"),
            "routed": F.col("pass") + F.col("quarantine") + F.col("manual_review"),
        }
    )


def batch_metrics(timings: DataFrame) -> DataFrame:
    """Seconds per item and items per second of each batch."""
    per_item = F.col("elapsed_sec") / F.greatest(F.lit(1), F.col("images"))
    out = timings.withColumn("sec_per_image", per_item)
    return out.withColumn(
        "images_per_sec", F.when(F.col("sec_per_image") > 0, 1.0 / F.col("sec_per_image")).otherwise(0.0)
    )


def run_summary(timings: DataFrame, peak: Column | None = None) -> DataFrame:
    """One row over all batches."""
    sums = timings.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{c}_count") for c in ROUTES],
        F.coalesce(F.sum("elapsed_sec"), F.lit(0.0)).alias("total_elapsed_sec"),
        F.coalesce(F.max(peak if peak is not None else F.lit(0.0)), F.lit(0.0)).alias("peak"),
    ).withColumn("total_routed", F.col("pass_count") + F.col("quarantine_count") + F.col("manual_review_count"))
    routed = F.col("total_routed")
    return sums.withColumns(
        {
            "pass_rate": _rate(F.col("pass_count"), routed),
            "quarantine_rate": _rate(F.col("quarantine_count"), routed),
            "manual_review_rate": _rate(F.col("manual_review_count"), routed),
            "avg_sec_per_image": _rate(F.col("total_elapsed_sec"), routed),
            "images_per_sec": _rate(routed, F.col("total_elapsed_sec")),
        }
    )


def cache_hit_stats(audit: DataFrame, hit: Column) -> DataFrame:
    """Detector calls, calls avoided by reusing cached detections, and the hit rate."""
    hits, calls = F.count_if(hit), F.count_if(~hit)
    return audit.agg(
        calls.alias("inference_calls"),
        hits.alias("cache_hits"),
        _rate(hits, hits + calls).alias("cache_hit_rate"),
        hits.alias("calls_avoided"),
    )


def manifest_totals(files: DataFrame) -> DataFrame:
    """Header of a transfer manifest. The file list itself stays a table (``manifest_files``)."""
    return files.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes")
    )


def manifest_files(files: DataFrame) -> DataFrame:
    """File list in path order; written range-partitioned, so consecutive part files are in order."""
    return files.select("path", "sha256", "size_bytes").orderBy("path")


def location_counts(items: DataFrame, location: str = "location") -> DataFrame:
    return items.groupBy(location).agg(F.count("*").alias("items"))


def readiness_gate(decisions: DataFrame, min_pass: float = 0.95, max_quarantine: float = 0.08) -> DataFrame:
    """GO when enough items pass; advice when too many are quarantined."""
    n = F.count("*")
    passed, held = F.count_if(F.col("route") == "final_clean"), F.count_if(F.col("route") == "quarantine")
    out = decisions.agg(
        n.alias("items"), _rate(passed, n).alias("pass_rate"), _rate(held, n).alias("quarantine_rate")
    )
    go = F.col("pass_rate") >= min_pass
    low = F.concat(
        F.lit("QA pass rate "), fixed(F.col("pass_rate") * 100, 1), F.lit(f"% below {min_pass:.0%} target")
    )
    return out.withColumns(
        {
            "verdict": F.when(go, F.lit("GO")).otherwise(F.lit("NO-GO")),
            "blocker": F.when(~go, low),
            "review_thresholds": F.col("quarantine_rate") > max_quarantine,
        }
    )


def residual_hits(outputs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Passed outputs that still show a face or confident text. Needs ``face_count`` and ``max_score``."""
    face = F.coalesce(F.col("face_count") > 0, F.lit(False))
    text = F.coalesce(F.col("max_score") >= settings.text_score_fail, F.lit(False))
    return outputs.filter(face | text).withColumns({"face_hit": face, "text_hit": text})


def residual_gate(outputs: DataFrame, originals_untouched: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """PASS when no passed output shows anything, the originals are unchanged and there is at least one output."""
    face = F.coalesce(F.col("face_count") > 0, F.lit(False))
    text = F.coalesce(F.col("max_score") >= settings.text_score_fail, F.lit(False))
    out = outputs.agg(
        F.count("*").alias("output_count"), F.count_if(face).alias("face_hits"), F.count_if(text).alias("text_hits")
    ).withColumn("originals_untouched", originals_untouched)
    good = (
        (F.col("face_hits") == 0) & (F.col("text_hits") == 0) & (F.col("output_count") > 0) & F.col("originals_untouched")
    )
    return out.withColumn("status", F.when(good, F.lit("PASS")).otherwise(F.lit("FAIL")))


def transfer_throughput(transfers: DataFrame, batch: Sequence[str] = ("operation", "offset")) -> DataFrame:
    """Files per second and failures of each transfer batch."""
    out = transfers.groupBy(*batch).agg(
        F.sum("count").cast("bigint").alias("files"),
        F.sum("elapsed_sec").alias("elapsed_sec"),
        F.count_if("failed").alias("failures"),
    )
    return out.withColumn("files_per_sec", _rate(F.col("files"), F.col("elapsed_sec")))


def manifest_summary(manifest: DataFrame, updated: str = "processed_at") -> DataFrame:
    return manifest.agg(F.count("*").alias("entries"), F.max(updated).alias("updated_at")).withColumn(
        "exists", F.col("entries") > 0
    )


def event_summary(events: DataFrame, peak_field: Column) -> DataFrame:
    """Security and transfer event counts and the peak of a numeric payload field."""
    kind = F.col("type")
    return events.agg(
        F.count_if(kind.startswith("security_")).alias("security_event_count"),
        F.count_if(kind.startswith("transfer_") | kind.startswith("b2_")).alias("transfer_event_count"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(peak_field.try_cast("double")), F.lit(0.0))).alias("peak"),
    )


def dry_run_plan(
    pending: DataFrame,
    max_items: int | None = None,
    integrity: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    shown: int = 20,
) -> DataFrame:
    """What a run would do, as one row; nothing is written. ``integrity`` is an optional one-row summary."""
    order = [F.col("path"), F.col("stem")]
    queue = pending if max_items is None else pilot_cap(pending, max_items, order)
    first = queue.orderBy(*order).limit(shown).agg(
        F.sort_array(F.collect_list(basename(F.col("path")))).alias("names")
    )
    plan = queue.agg(F.count("*").alias("pending_count"))
    out = plan.withColumns(
        {
            "run_type": F.lit("pilot" if max_items is not None else "full"),
            "batch_size": adaptive_batch_size(F.col("pending_count"), settings),
            "first_names": first.scalar(),
        }
    )
    if integrity is not None:
        fields = ("checked", "verified", "corrupt", "ok")
        out = out.withColumn("integrity", integrity.select(F.struct(*fields).alias("integrity")).scalar())
    return out


# --- windows ---------------------------------------------------------------------------------------------------


def last_per_image(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last report row per image; ``order`` must be unique per image."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def running_progress(timings: DataFrame, total: Column, chunk: int = 8192) -> DataFrame:
    """Per run and batch: cumulative counts, quarantine rate, speed so far and time to go (null when speed is 0)."""
    timed = timings.withColumn("_routed", F.col("pass") + F.col("quarantine") + F.col("manual_review"))
    sums = {
        "processed_cumulative": "images",
        "elapsed_cumulative": "elapsed_sec",
        "quarantine_cumulative": "quarantine",
        "routed_cumulative": "_routed",
    }
    run = running_by_index(timed.withColumn("_total", total), ["run_id"], "batch_index", sums, chunk).drop("_routed")
    elapsed = F.greatest(F.col("elapsed_cumulative").cast("double"), F.lit(1e-6))
    rate = _rate(F.col("processed_cumulative"), elapsed)
    left = F.greatest(F.lit(0), F.col("_total") - F.col("processed_cumulative"))
    return (
        run.withColumn("quarantine_rate_cumulative", _rate(F.col("quarantine_cumulative"), F.col("routed_cumulative")))
        .withColumn("images_per_sec_so_far", rate)
        .withColumn("eta_sec", F.when(F.col("images_per_sec_so_far") > 0, left / F.col("images_per_sec_so_far")))
        .drop("_total")
    )


def bottlenecks(metrics: DataFrame, factor: float = 1.75, slow_mean: float = 5.0) -> DataFrame:
    """Batches much slower than their run's mean, and runs whose mean is high. Needs ``sec_per_image``.

    The mean is one row per run, joined back; batches without a run are a run of their own.
    """
    means = cut_lineage(metrics.groupBy("run_id").agg(F.avg("sec_per_image").alias("avg_sec_per_image")))
    slow = join_small(metrics, means, ["run_id"], written=True, null_safe=True).filter(
        (F.col("avg_sec_per_image") > 0) & (F.col("sec_per_image") >= F.col("avg_sec_per_image") * factor)
    )
    rows = slow.select(
        "run_id", F.col("batch_index").cast("bigint").alias("batch_index"), "sec_per_image", "avg_sec_per_image",
        F.lit("slow_batch_outlier").alias("reason"),
    )
    high = means.filter(F.col("avg_sec_per_image") > slow_mean).select(
        "run_id", F.lit(None).cast("bigint").alias("batch_index"), F.lit(None).cast("double").alias("sec_per_image"),
        "avg_sec_per_image", F.lit("high_avg_latency").alias("reason"),
    )
    return rows.unionByName(high)


LATEST = {"security": 15, "transfer": 10, "batch": 10}


def event_category(kind: Column) -> Column:
    return (
        F.when(kind.startswith("security_"), F.lit("security"))
        .when(kind.startswith("transfer_"), F.lit("transfer"))
        .when(kind == "batch_complete", F.lit("batch"))
    )


def latest_per_type(
    events: DataFrame, category: Column, order: Sequence[Column], limits: Mapping[str, int] = LATEST
) -> DataFrame:
    """Newest events of each category. A plain rank limit comes first, so tasks keep only the newest few before
    the shuffle; the per-category limit follows."""
    w = Window.partitionBy("category").orderBy(*[c.desc() for c in order])
    kept = events.withColumn("category", category).filter(F.col("category").isin(*limits))
    ranked = kept.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= max(limits.values()))
    allowed = F.lit(False)
    for name, n in limits.items():
        allowed = allowed | ((F.col("category") == name) & (F.col("nth") <= n))
    return ranked.filter(allowed)
