"""Audit records, event logs and manifests. A missing field is null; an unreadable record is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from redactflow.functions.names import normalize_path, stem
from redactflow.schemas import AUDIT_DDL, PROCESSED_MANIFEST_DDL, TRANSFER_MANIFEST_DDL


def _ddl(text: str) -> str:
    return " ".join(text.split())


def _json(spark: SparkSession, schema: str, multi_line: bool) -> DataFrameReader:
    return spark.read.schema(_ddl(schema)).option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE")


def read_audit(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON sidecars, one per item, as the audit table; the stem is the file's own when the record has none.

    ``multi_line=False`` reads many records per file, one per line, as a large run keeps them.
    """
    reader = _json(spark, AUDIT_DDL, multi_line)
    records = reader.json(path)
    readable = F.to_json(F.struct(*records.columns)) != "{}"
    own = stem(F.col("_metadata.file_name"))
    return records.withColumn("_own", own).filter(readable).withColumn("stem", F.coalesce("stem", "_own")).drop("_own")


def events_from_text(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to ``ts, type, payload``; lines that are not JSON objects are dropped."""
    parsed = lines.select(F.try_parse_json(F.col(value)).alias("payload"))
    objects = parsed.filter(F.col("payload").isNotNull() & F.schema_of_variant("payload").startswith("OBJECT"))
    return objects.select(
        F.try_to_timestamp(F.try_variant_get("payload", "$.ts", "string")).alias("ts"),
        F.try_variant_get("payload", "$.type", "string").alias("type"),
        "payload",
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return events_from_text(spark.read.text(path))


def transfer_manifest_header(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _json(spark, TRANSFER_MANIFEST_DDL, multi_line).json(path).drop("files")


def read_transfer_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per file of the manifest: ``path, sha256, size_bytes``."""
    files = _json(spark, TRANSFER_MANIFEST_DDL, multi_line).json(path).select(F.explode("files").alias("f"))
    return files.select(
        normalize_path(F.col("f.path")).alias("path"), F.col("f.sha256").alias("sha256"), F.col("f.size_bytes").alias("size_bytes")
    )


def read_processed_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per stem of the processed manifest."""
    entries = _json(spark, PROCESSED_MANIFEST_DDL, multi_line).json(path).select(F.explode("entries").alias("stem", "e"))
    return entries.select(
        "stem",
        F.col("e.original_hash").alias("original_hash"),
        F.try_to_timestamp("e.ingest_timestamp").alias("ingest_timestamp"),
        normalize_path(F.col("e.source_path")).alias("source_path"),
        F.col("e.output_hash").alias("output_hash"),
        F.try_to_timestamp("e.processed_at").alias("processed_at"),
    )
