"""Batch size from queue depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings


def adaptive_batch_size(pending: Column, settings: Settings = DEFAULTS, base: int | None = None) -> Column:
    b = max(1, settings.batch_size if base is None else base)
    cap = settings.max_batch_size
    return (
        F.when(pending >= settings.large_queue, F.lit(min(cap, max(b, b * 2))))
        .when(pending >= settings.medium_queue, F.lit(min(cap, max(b, int(b * 1.5)))))
        .otherwise(F.lit(b))
        .cast("int")
    )
