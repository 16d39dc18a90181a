"""QA gates as column expressions: detection, integrity, decision, retry overrides, calibration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.operators.order import exact_percentiles

TEXT_REMAINS = "readable_text_likely_remaining"
TEXT_CLEAR = "no_high_confidence_text_detections"
INTEGRITY_RISK = "artifact_or_identity_risk"
INTEGRITY_OK = "integrity_ok"


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def detection_fail(score: Column, count: Column, settings: Settings = DEFAULTS) -> Column:
    return _true((score >= settings.text_score_fail) & (count > 0))


def detection_reason(failed: Column) -> Column:
    return F.when(failed, F.lit(TEXT_REMAINS)).otherwise(F.lit(TEXT_CLEAR))


def face_count_warn(faces: Column, settings: Settings = DEFAULTS) -> Column:
    return _true(faces > settings.max_output_faces_warn)


def identity_fail(
    distance: Column,
    output_faces: Column | None = None,
    input_faces: Column | None = None,
    settings: Settings = DEFAULTS,
) -> Column:
    """Too similar to the original. A missing output face fails only when a face is required and one was there."""
    failed = _true(distance < settings.identity_distance_min)
    if settings.min_output_face == 1 and output_faces is not None and input_faces is not None:
        failed = failed | _true((output_faces == 0) & (input_faces > 0))
    return failed


def integrity_fail(
    ssim: Column,
    distance: Column,
    edge_ratio: Column,
    output_faces: Column | None = None,
    input_faces: Column | None = None,
    original_found: Column | None = None,
    on_missing: str = "pass",
    settings: Settings = DEFAULTS,
) -> Column:
    """Any of the three image checks; a null measure passes unless ``on_missing='fail'`` and the original is absent."""
    failed = (
        _true(ssim < settings.ssim_min)
        | identity_fail(distance, output_faces, input_faces, settings)
        | _true(edge_ratio > settings.edge_ratio_max)
    )
    if on_missing == "fail":
        failed = failed | (~_true(original_found) if original_found is not None else ssim.isNull())
    return failed


def integrity_reason(failed: Column) -> Column:
    return F.when(failed, F.lit(INTEGRITY_RISK)).otherwise(F.lit(INTEGRITY_OK))


def decide(df: DataFrame, qa_rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds ``final_decision`` and ``failure_reason`` from boolean ``detection_fail`` and ``integrity_fail`` columns.

    ``qa_rules`` adds named boolean rules of the caller; any of them fails the item too.
    """
    parts = {
        f"detection_verification:{TEXT_REMAINS}": _true(F.col("detection_fail")),
        f"identity_integrity:{INTEGRITY_RISK}": _true(F.col("integrity_fail")),
    }
    for name, cond in (qa_rules or {}).items():
        parts[f"rule:{name}"] = _true(cond)
    failed = F.lit(False)
    for cond in parts.values():
        failed = failed | cond
    reason = F.concat_ws(" | ", *[F.when(cond, F.lit(text)) for text, cond in parts.items()])
    return df.withColumns(
        {
            "final_decision": F.when(failed, F.lit("fail")).otherwise(F.lit("pass")),
            "failure_reason": F.when(failed, reason),
        }
    )


def recycle_overrides(retry: Column) -> Column:
    """Stronger parameters for the next attempt."""
    return F.struct(
        (retry * 4).cast("int").alias("extra_mask_dilation"),
        F.least(F.lit(0.35), F.lit(0.05) * retry).alias("truncation_value"),
        (retry >= 2).alias("multi_modal_truncation"),
        (F.lit(20) + F.least(F.lit(40), retry * 5)).cast("int").alias("ldm_steps"),
    )


def calibrate_thresholds(
    scores: DataFrame,
    text_score: Column,
    ssim: Column,
    identity: Column,
    passed: Column | None = None,
    approximate: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row: percentiles of the three measures and the clamped thresholds they suggest."""
    measures = {"text": text_score, "ssim": ssim, "identity": identity}
    points = [0.05, 0.5, 0.95]
    if approximate:
        row = scores.agg(
            *[
                F.percentile_approx(c.cast("double"), points, 10_000).alias(k)
                for k, c in measures.items()
            ]
        )
        value = {
            (k, p): F.get(F.col(k), F.lit(i)) for k in measures for i, p in enumerate(points)
        }
    else:
        per_metric = exact_percentiles(scores, measures, points)
        names = {0.05: "p5", 0.5: "p50", 0.95: "p95"}
        row = per_metric.agg(
            *[
                F.max(F.when(F.col("metric") == k, F.col(names[p]))).alias(f"{k}_{names[p]}")
                for k in measures
                for p in points
            ]
        )
        value = {(k, p): F.col(f"{k}_{names[p]}") for k in measures for p in points}

    def or_zero(key: str, p: float) -> Column:
        return F.coalesce(value[(key, p)], F.lit(0.0))

    return row.select(
        or_zero("text", 0.5).alias("text_p50"),
        or_zero("text", 0.95).alias("text_p95"),
        or_zero("ssim", 0.05).alias("ssim_p5"),
        or_zero("ssim", 0.5).alias("ssim_p50"),
        or_zero("identity", 0.05).alias("identity_p5"),
        or_zero("identity", 0.5).alias("identity_p50"),
        F.round(F.greatest(F.lit(settings.text_score_fail), or_zero("text", 0.95)), 3).alias("text_score_fail"),
        F.round(
            F.least(F.lit(0.80), F.greatest(F.lit(0.72), F.coalesce(value[("ssim", 0.05)], F.lit(settings.ssim_min)))), 3
        ).alias("ssim_min"),
        F.round(
            F.least(F.lit(0.5), F.coalesce(value[("identity", 0.05)], F.lit(settings.identity_distance_min))), 3
        ).alias("identity_distance_min"),
    )


def pair_original_output(outputs: DataFrame, originals: DataFrame, key: str = "stem") -> DataFrame:
    """Each output with its original; ``original_*`` columns are null when the original is missing."""
    renamed = originals.select(
        F.col(key), *[F.col(c).alias(f"original_{c}") for c in originals.columns if c != key]
    ).withColumn("original_found", F.lit(True))
    return outputs.join(renamed, key, "left").withColumn("original_found", F.coalesce("original_found", F.lit(False)))
