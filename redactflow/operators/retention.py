"""Retention plan: which listed files may be deleted, and why. Produces tables; deletes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.functions.names import basename, extension, glob_match, globs_regex, stem

# Names and markers the rules look for.
KEEP_NAMES = (".gitkeep", ".gitignore")
MANIFEST_NAMES = (
    "manifest.json", "manifest.csv", "master_manifest.json", "dataset_manifest.json", "inventory.json",
    "inventory.csv", "processed_manifest.json", "anonymization_audit.json", "master_summary.csv", "master_summary.pdf",
)
TEST_MARKERS = (
    "test_", "_test", "_test_", "temp_", "_tmp", "_tmp_", "debug_", "_debug", "sample_", "_sample", "checkpoint",
    "_processed_tmp", "_chunk_", "_backup", "prod_test_", "prod_val_", "final_val_", "gpu_rt_", "perf_", "scale_",
    "roundtrip_",
)
TEST_GLOBS = (
    "gpu_rt_*", "perf_*", "prod_test_*", "prod_val_*", "final_val_*", "scale_*", "roundtrip_*", "sample_*", "test_*",
    "*_test.*", "*_test_*", "temp_*", "*_tmp.*", "debug_*", "*_debug.*", "*checkpoint*", "*_processed_tmp*",
    "*_chunk_*", "*_backup*",
)
TEST_IMAGE_GLOBS = (
    "gpu_rt_*", "perf_*", "prod_test_*", "prod_val_*", "final_val_*", "scale_*", "roundtrip_*", "sample_*",
)
JUNK_NAMES = (".ds_store", "thumbs.db", "desktop.ini")
JUNK_EXTENSIONS = (".pyc", ".pyo")
JUNK_DIRS = ("__pycache__", ".pytest_cache", ".mypy_cache")
EPHEMERAL_DIRS = ("_source_copies", "_work", "_scratch", ".cache", "cache")
MEDIA_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif")
BATCH_DIR = "(?i)^batch_[0-9]{5}$"
BATCH_SUMMARY = "(?i)^batch_[0-9]{5}(_resume)?[.]csv$"

Rule = tuple[Column, bool, str]


def test_marked(name: Column) -> Column:
    """Marker substrings ignore case; globs apply to the name and to the name without its extension."""
    return (
        F.lower(name).rlike("|".join(TEST_MARKERS))
        | glob_match(name, TEST_GLOBS)
        | glob_match(stem(name), TEST_GLOBS)
    )


def _first_match(rules: Sequence[Rule]) -> Column:
    def outcome(delete: bool, reason: str) -> Column:
        return F.struct(F.lit(delete).alias("delete"), F.lit(reason).alias("reason"))

    out = F.when(rules[0][0], outcome(*rules[0][1:]))
    for cond, delete, reason in rules[1:]:
        out = out.when(cond, outcome(delete, reason))
    return out.otherwise(outcome(False, "preserve:unknown_conservative"))


def retention_plan(files: DataFrame) -> DataFrame:
    """Adds ``delete`` and ``reason`` to ``root, rel_path, is_dir, size_bytes``; anything unknown is preserved."""
    rel, is_dir = F.col("rel_path"), F.col("is_dir")
    named = files.withColumns({"_name": basename(rel), "_parts": F.split(rel, "/")})
    name = F.col("_name")
    named = named.withColumns({"_ext": extension(name), "_test": test_marked(name)})
    low, ext, marked = F.lower(name), F.col("_ext"), F.col("_test")
    is_file = ~is_dir
    depth, top = F.size("_parts"), F.get("_parts", F.lit(0))
    in_batch = top.rlike(BATCH_DIR)

    keep: Rule = (name.isin(*KEEP_NAMES), False, "preserve:gitkeep")
    junk_dir: Rule = (is_dir & low.isin(*JUNK_DIRS), True, "junk_dir")
    test_dir: Rule = (is_dir & marked, True, "test_dir_name")
    other_dir: Rule = (is_dir, False, "preserve:directory")
    junk_file: Rule = (is_file & (low.isin(*JUNK_NAMES) | ext.isin(*JUNK_EXTENSIONS)), True, "junk_file")
    test_file: Rule = (is_file & marked, True, "test_name_marker")

    clean = [
        keep,
        (low.isin(*MANIFEST_NAMES), False, "preserve:production_manifest"),
        junk_dir, test_dir, other_dir, junk_file, test_file,
        (ext.isin(*MEDIA_EXTENSIONS), False, "preserve:production_media"),
        (ext == ".json", False, "preserve:metadata_sidecar"),
    ]
    summaries = [
        keep, junk_dir, test_dir, other_dir, junk_file,
        (name.rlike(BATCH_SUMMARY), False, "preserve:production_batch_summary"),
        test_file,
        (name.endswith(".log") & (low.contains("test") | low.contains("debug")), True, "test_log"),
    ]
    temp = [
        keep, junk_dir,
        (is_dir & name.rlike(BATCH_DIR), True, "temp_batch_dir"),
        (is_dir & name.isin(*EPHEMERAL_DIRS), True, "ephemeral_dir"),
        test_dir,
        (is_dir & (depth >= 2) & in_batch, True, "inside_batch_dir"),
        other_dir, junk_file,
        (name.endswith(".processing.lock") & in_batch, True, "batch_lock_file"),
        (name.endswith(".processing.lock"), False, "preserve:root_lock"),
        test_file,
        (in_batch, True, "inside_batch_dir"),
        ((depth >= 2) & top.isin(*EPHEMERAL_DIRS), True, "ephemeral_content"),
        (depth == 1, True, "temp_root_loose_file"),
    ]
    verdict = (
        F.when(F.col("root") == "final_clean", _first_match(clean))
        .when(F.col("root") == "logs/batch_summaries", _first_match(summaries))
        .when(F.col("root") == "temp_processed", _first_match(temp))
        .otherwise(_first_match([keep]))
    )
    return named.withColumn("_v", verdict).select(
        *[F.col(c) for c in files.columns], F.col("_v.delete").alias("delete"), F.col("_v.reason").alias("reason")
    )


def retention_rollup(plan: DataFrame) -> DataFrame:
    """Files, directories and bytes to delete per root, and over all roots (``root`` null)."""
    doomed = plan.filter("delete")
    return doomed.rollup("root").agg(
        F.count_if(~F.col("is_dir")).alias("files"),
        F.count_if("is_dir").alias("dirs"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("bytes"),
    )


def is_test_image(image: Column, globs: Sequence[str] = TEST_IMAGE_GLOBS) -> Column:
    return glob_match(image, globs) | glob_match(stem(image), globs)


def drop_test_rows(audit: DataFrame, image: str = "image", globs: Sequence[str] = TEST_IMAGE_GLOBS) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, one-row report of removed and kept)``."""
    test = F.coalesce(is_test_image(F.col(image), globs), F.lit(False))
    report = audit.agg(F.count_if(test).alias("removed"), F.count_if(~test).alias("kept"))
    return audit.filter(~test), report
