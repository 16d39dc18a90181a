"""Timestamps as text: parse leniently, compute ages against an explicit ``now``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso_ts(text: Column) -> Column:
    """ISO-8601 text to timestamp; null when it cannot be read."""
    return F.try_to_timestamp(text)


def age_seconds(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", ts, now)


def is_stale(started_at: Column, now: Column, stale_sec: int) -> Column:
    """A lock whose start is unreadable counts as stale."""
    age = (F.unix_micros(now) - F.unix_micros(parse_iso_ts(started_at))) / F.lit(1e6)
    return F.coalesce(age > F.lit(float(stale_sec)), F.lit(True))
