"""Classify error messages and checker log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message classes in order of precedence.
ERROR_CLASSES = (
    ("rate_limit", "429|too many requests|rate limit|slow down"),
    ("service_unavailable", "503|service unavailable"),
    ("gateway_error", "502|504|500 internal"),
    ("connection", "connection reset|connection refused|connection lost|broken pipe"),
    ("timeout", "timeout|timed out|i/o timeout"),
    ("b2_upload", "upload failed|b2.*error"),
)
# Messages worth another attempt.
TRANSIENT = (
    "timeout|timed out|connection reset|connection refused|connection lost|temporary|too many requests|"
    "429|503|502|504|500 internal|rate limit|i/o timeout|broken pipe|service unavailable|slow down|"
    "exceeded maximum|upload failed|download failed|server closed"
)
# Markers of accelerator trouble.
COMPUTE_MARKERS = (
    "cuda", "cudnn", "cublas", "out of memory", "oom", "gpu", "dll", "onnxruntime", "cudart",
    "device-side assert", "no kernel image", "c10::", "nvidia", "could not load", "failed to load",
    "cudaexecutionprovider",
)


def error_class(message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    label, pattern = ERROR_CLASSES[0]
    out = F.when(text.rlike(f"(?i){pattern}"), F.lit(label))
    for label, pattern in ERROR_CLASSES[1:]:
        out = out.when(text.rlike(f"(?i){pattern}"), F.lit(label))
    return out.otherwise(F.lit("unknown"))


def is_transient(message: Column) -> Column:
    return F.coalesce(message, F.lit("")).rlike(f"(?i){TRANSIENT}")


def is_compute_error(message: Column) -> Column:
    return F.coalesce(F.lower(message), F.lit("")).rlike("|".join(COMPUTE_MARKERS))


def parse_check_mismatch(line: Column) -> Column:
    """Relative path named by one checker log line as differing, or null."""
    text = F.trim(line)
    low = F.lower(text)
    summary = low.contains("differences found") | low.contains("0 differences")
    noise = low.startswith("failed to check") | low.contains("couldn't")
    # ``ERROR : path: reason`` (the level may be repeated); the path ends at the next colon
    after_level = F.trim(F.regexp_replace(text, r"(?i)^error[^:]*:", ""))
    payload = F.trim(F.regexp_replace(after_level, r"(?i)^error[^:]*:", ""))
    error_path = F.trim(F.substring_index(payload, ":", 1))
    first_word = F.regexp_extract(text, r"^([^ \t]+)", 1)
    says_differs = (low.contains(" differ") | low.contains("hash mismatch")) & ~low.startswith("0 ")
    found = (
        F.when(summary | noise, F.lit(None).cast("string"))
        .when(low.startswith("error"), error_path)
        .when(says_differs, first_word)
    )
    return F.when((found != "") & ~found.rlike("^[0-9]+$"), found)
