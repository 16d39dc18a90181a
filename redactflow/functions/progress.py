"""Progress numbers and advice texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.functions.names import fixed


def progress_pct(processed: Column, target: Column) -> Column:
    return (
        F.when(target > 0, F.round(F.lit(100.0) * F.least(processed, target) / target, 2))
        .when(processed > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def total_batches(pending: Column, batch_size: Column) -> Column:
    size = F.greatest(F.lit(1), batch_size)
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), pending) / size)).cast("bigint")


def format_eta(seconds: Column) -> Column:
    """``1h 2m``, ``2m 3s`` or ``3s``; a dash when unknown or not finite."""
    value = seconds.cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    s = F.floor(F.greatest(F.lit(0.0), value)).cast("bigint")
    h = F.floor(s / 3600)
    m = F.floor((s % 3600) / 60)
    sec = s % 60
    return (
        F.when(~finite, F.lit("—"))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), sec.cast("string"), F.lit("s")))
        .otherwise(F.concat(sec.cast("string"), F.lit("s")))
    )


def _percent(rate: Column, digits: int) -> Column:
    return F.concat(fixed(rate * 100, digits), F.lit("%"))


def recommendations(
    avg_sec: Column,
    quarantine_rate: Column,
    pass_rate: Column,
    cache_hit_rate: Column | None = None,
    settings: Settings = DEFAULTS,
) -> Column:
    """Tuning advice as an array of texts; one neutral text when no threshold is crossed."""
    slow = F.concat(
        F.lit("Average "), fixed(avg_sec, 2), F.lit("s/item is high: "),
        F.lit(f"add executors or raise batch_size (current max {settings.max_batch_size})."),
    )
    notes = [F.when(avg_sec > 3.0, slow)]
    if settings.batch_size < settings.max_batch_size:
        notes.append(F.when(avg_sec < 1.0, F.lit("Throughput headroom: batch size can grow on large queues.")))
    notes.append(
        F.when(
            quarantine_rate > 0.05,
            F.concat(
                F.lit("Quarantine rate "), _percent(quarantine_rate, 1),
                F.lit(" exceeds 5%: calibrate thresholds and review ssim_min (typical range 0.72-0.80)."),
            ),
        )
    )
    notes.append(
        F.when(
            pass_rate < 0.95,
            F.concat(
                F.lit("Pass rate "), _percent(pass_rate, 1), F.lit(" below 95%: review QA thresholds and screening rejects.")
            ),
        )
    )
    if cache_hit_rate is not None:
        notes.append(
            F.when(cache_hit_rate < 0.5, F.lit("Detection cache hit rate low: reuse output detections in QA.")).when(
                cache_hit_rate >= 0.5,
                F.concat(
                    F.lit("Detection cache hit rate "), _percent(cache_hit_rate, 0), F.lit(": repeated scans avoided.")
                ),
            )
        )
    found = F.array_compact(F.array(*notes))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Metrics within expected bounds.")))
