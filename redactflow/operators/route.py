"""Routing with a bounded retry budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.operators.order import group_ordinal
from redactflow.operators.qa import recycle_overrides

CLEAN, QUARANTINE, MANUAL = "final_clean", "quarantine", "manual_review"


def route_of(decision: Column, next_retry: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(decision == "pass", F.lit(CLEAN))
        .when(next_retry >= settings.max_retries, F.lit(MANUAL))
        .otherwise(F.lit(QUARANTINE))
    )


def route(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """From ``final_decision`` and the previous ``retry_count``: route, new retry count, next-pass overrides."""
    prev = F.coalesce(F.col("retry_count"), F.lit(0))
    failed = F.col("final_decision") != "pass"
    after = F.when(failed, prev + 1).otherwise(prev).cast("int")
    counted = df.withColumn("retry_count", after)
    return counted.withColumns(
        {
            "route": route_of(F.col("final_decision"), F.col("retry_count"), settings),
            "next_pass_overrides": F.when(
                F.col("final_decision") != "pass", recycle_overrides(F.col("retry_count"))
            ),
        }
    )


def route_errors(decided: DataFrame, errors: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Items that failed while being processed are failed attempts like any other: same budget, same routes.

    ``errors`` carries ``stem, retry_count, error``; the originals stay where they are.
    """
    failed = errors.select(
        "stem",
        F.col("retry_count"),
        F.lit("fail").alias("final_decision"),
        F.concat(F.lit("processing_error:"), F.coalesce("error", F.lit("unknown"))).alias("failure_reason"),
    )
    return route(decided.unionByName(failed, allowMissingColumns=True), settings)


def number_attempts(log: DataFrame, key: str, order: list[Column], name: str = "attempt") -> DataFrame:
    """1-based attempt number per key, spread over partitions even when one key holds much of the log."""
    return group_ordinal(log, [key], order, name)


def retry_state(attempts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Where each stem stands after its attempts: retries used, route, number of the attempt that settled it.

    An item settles at its first pass or at the failure that uses up the budget, whichever comes first;
    attempts after that are ignored. Only each stem's first ``max_retries`` failures and first pass can
    matter, and the rank limit drops the rest before the shuffle.
    """
    cap = settings.max_retries
    w = Window.partitionBy("stem", "decision").orderBy("attempt")
    early = attempts.select("stem", "attempt", "decision").withColumn("_nth", F.row_number().over(w))
    early = early.filter(F.col("_nth") <= cap)
    is_pass, is_fail = F.col("decision") == "pass", F.col("decision") != "pass"
    per_stem = early.groupBy("stem").agg(
        F.min(F.when(is_pass, F.col("attempt"))).alias("first_pass"),
        F.min(F.when(is_fail & (F.col("_nth") == cap), F.col("attempt"))).alias("budget_fail"),
        F.sort_array(F.collect_list(F.when(is_fail, F.col("attempt")))).alias("fails"),  # at most ``cap`` entries
    )
    passed = F.col("first_pass").isNotNull() & (
        F.col("budget_fail").isNull() | (F.col("first_pass") < F.col("budget_fail"))
    )
    before_pass = F.size(F.filter("fails", lambda a: a < F.col("first_pass")))
    return per_stem.select(
        "stem",
        F.when(passed, before_pass).otherwise(F.size("fails")).cast("int").alias("retry_count"),
        F.when(passed, F.lit(CLEAN)).when(F.col("budget_fail").isNotNull(), F.lit(MANUAL)).otherwise(F.lit(QUARANTINE)).alias(
            "route"
        ),
        F.when(passed, F.col("first_pass"))
        .when(F.col("budget_fail").isNotNull(), F.col("budget_fail"))
        .otherwise(F.array_max("fails"))
        .alias("settled_attempt"),
    )


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """The most recent attempt per stem; the sort key is unique per stem."""
    w = Window.partitionBy("stem").orderBy(F.col("attempt").desc())
    return attempts.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def master_row(audit: DataFrame) -> DataFrame:
    """Flat report row from the nested audit record."""
    return audit.select(
        "image",
        F.col("qa.final_decision").alias("final_decision"),
        F.col("qa.final_route").alias("route"),
        "retry_count",
        F.col("detections.text.count").alias("text_regions_detected"),
        F.col("success_metrics.text_regions_inpainted").alias("text_regions_inpainted"),
        F.col("qa_probes.original_face_count").alias("original_face_count"),
        F.col("success_metrics.face_gan_applied").alias("face_gan_applied"),
        F.col("success_metrics.processing_status").alias("processing_status"),
    )


def regions_inpainted(detected: Column, inpaint_success: Column) -> Column:
    """Regions really redacted: none when the redaction step failed."""
    return F.when(F.coalesce(inpaint_success, F.lit(False)), F.coalesce(detected, F.lit(0))).otherwise(F.lit(0))
