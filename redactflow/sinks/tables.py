"""Writers. Keyed ones can be repeated without effect; append-only ones never rewrite what is there."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.functions.secrets import redact_struct
from redactflow.operators.reports import last_per_image
from redactflow.operators.verify import last_entry_per_stem
from redactflow.schemas import AUDIT_SCHEMA_NAME, RUN_SCOPE_DDL
from redactflow.sinks.keyed import KeyedTable


class ProtectedPathError(PermissionError):
    """A write was aimed at the read-only originals."""


def _normal(path: str) -> tuple[str, str, str]:
    parts = urlsplit(path)
    return parts.scheme or "file", parts.netloc, posixpath.normpath("/" + parts.path.lstrip("/"))


def is_under(root: str, path: str) -> bool:
    (rs, rn, rp), (ps, pn, pp) = _normal(root), _normal(path)
    return (rs, rn) == (ps, pn) and (pp == rp or pp.startswith(rp.rstrip("/") + "/"))


def guarded_write(df: DataFrame, target: str, source_root: str, write: Callable[[DataFrame, str], None]) -> None:
    """Run ``write(df, target)`` unless ``target`` lies under the read-only source folder."""
    if is_under(source_root, target):
        raise ProtectedPathError(f"refusing to write inside read-only source {source_root}: {target}")
    write(df, target)


def _with_defaults(audit: DataFrame, now: Column) -> DataFrame:
    have = set(audit.columns)

    def col(name: str, dtype: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(dtype)

    filled = {
        "schema": F.coalesce(col("schema", "string"), F.lit(AUDIT_SCHEMA_NAME)),
        "updated_at": F.coalesce(col("updated_at", "timestamp"), now),
        "image": F.coalesce(col("image", "string"), col("source_path", "string"), F.col("stem")),
        "batch_id": F.coalesce(col("batch_id", "string"), F.lit("unbatched")),
    }
    return audit.withColumns(filled)


def _audit_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "stem", "batch_id")


def _one_each(audit: DataFrame, now: Column) -> DataFrame:
    return last_entry_per_stem(_with_defaults(audit, now), [F.col("updated_at"), F.xxhash64("image", "batch_id")])


def write_audit(audit: DataFrame, path: str, now: Column) -> None:
    """One row per item; writing a batch again replaces exactly that batch. Rows of the items elsewhere are superseded."""
    _audit_table(audit.sparkSession, path).upsert(_one_each(audit, now), replace_groups=True)


def upsert_audit(spark: SparkSession, audit: DataFrame, path: str, now: Column) -> None:
    """Replace the rows of the given items wherever they are. Reads nothing of what is there."""
    _audit_table(spark, path).upsert(_one_each(audit, now))


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_audit`` and ``upsert_audit`` have written: one row per item, the newest."""
    rows = _audit_table(spark, path).read()
    return spark.createDataFrame([], "stem string, batch_id string") if rows is None else rows


def compact_audit(spark: SparkSession, path: str) -> None:
    """Merge all versions into one, so that reads need not."""
    _audit_table(spark, path).compact()


def append_master_audit(decided: DataFrame, path: str) -> None:
    """Append ``image, decision, retry_count``; earlier rows are never read."""
    columns = ["image", F.col("final_decision").alias("decision"), F.col("retry_count").cast("int").alias("retry_count")]
    decided.select(*columns).write.mode("append").parquet(path)


SUMMARY_COLUMNS = (
    "image", "final_decision", "final_route", "max_ocr_score", "ocr_lines_qa", "output_face_count_qa", "ssim",
    "identity_cosine_distance",
)


def batch_summary(audit: DataFrame) -> DataFrame:
    """QA columns of the per-batch report."""
    return audit.select(
        "batch_id",
        "image",
        F.col("qa.final_decision").alias("final_decision"),
        F.col("qa.final_route").alias("final_route"),
        F.col("qa.detection.max_det_score").alias("max_ocr_score"),
        F.col("qa.detection.ocr_lines").alias("ocr_lines_qa"),
        F.col("detections.faces.post_face_count").alias("output_face_count_qa"),
        F.col("qa.integrity.ssim").alias("ssim"),
        F.col("qa.integrity.identity_distance").alias("identity_cosine_distance"),
    )


def write_batch_summary(rows: DataFrame, path: str) -> None:
    """CSV files in one folder per batch; repeating a batch replaces it."""
    out = rows.select("batch_id", *[c for c in SUMMARY_COLUMNS if c in rows.columns])
    spread_out = out.hint("rebalance", "batch_id")
    writer = spread_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", "true")
    writer.partitionBy("batch_id").csv(path)


def write_master_summary(rows: DataFrame, path: str, key: str = "image", order: Sequence[str] = ("batch_index", "seq")) -> None:
    """CSV with the last row of each image."""
    last_per_image(rows, key, order).write.mode("overwrite").option("header", "true").csv(path)


def append_events(events: DataFrame, path: str, literals: Sequence[str] = ()) -> None:
    """Append redacted JSON lines."""
    redact_struct(events, literals).write.mode("append").json(path)


def write_run_scope(
    spark: SparkSession, path: str, now: Column, max_items: int | None = None, dry_run: bool = False,
    settings: Settings = DEFAULTS,
) -> None:
    """Append one row that says what this run is."""
    run_type = "pilot" if max_items is not None else "full"
    row = spark.range(1).select(
        F.lit("images_only").alias("processing_mode"),
        F.lit(run_type).alias("run_type"),
        F.lit(settings.batch_size).cast("int").alias("batch_size"),
        F.lit(max_items).cast("int").alias("max_images"),
        F.lit(dry_run).alias("dry_run"),
        now.cast("timestamp").alias("recorded_at"),
    )
    assert [f.split()[0] for f in RUN_SCOPE_DDL.split(", ")] == row.columns
    row.write.mode("append").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Merged manifest, replaced as a whole. Pass a frame that does not read ``path``, or cut its lineage first."""
    manifest.write.mode("overwrite").parquet(path)
