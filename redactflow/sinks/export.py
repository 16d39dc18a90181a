"""Publish passed items as a version of its own, read it back, verify, repair once, commit.

Each export writes a new folder and becomes visible by one commit file. A reader takes the folder the last commit names
and keeps it, whatever is exported meanwhile; an export that dies is never seen, and nothing of an earlier one (second
copies, check results) can be taken for a part of a later one.

Contents are computed once and stay where they are: the manifest comes from what was written (or staged, for a writer of
the caller), and verification, repair and reading join names and hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.functions.names import sha256_hex
from redactflow.functions.secrets import sanitize_for_export
from redactflow.operators.joins import join_small
from redactflow.operators.reports import manifest_totals
from redactflow.operators.verify import hash_summary, verify_hashes
from redactflow.schemas import TRANSFER_MANIFEST_SCHEMA_NAME
from redactflow.session import cut_lineage
from redactflow.sinks.log import CommitLog

Writer = Callable[[DataFrame, str], None]


@dataclass(frozen=True)
class Published:
    """One export: its number, its folder, and how often items were copied (1, or 2 if some had to be repaired)."""

    version: int
    folder: str
    copies: int


def exports(spark: SparkSession, target: str) -> list[Published]:
    """All exports that were completed, oldest first."""
    found = CommitLog(spark, target).commits()
    return [Published(c.version, f"{target}/{c.facts['folder']}", c.facts["copies"]) for c in found]


def current_export(spark: SparkSession, target: str) -> Published | None:
    last = CommitLog(spark, target).last()
    return None if last is None else Published(last.version, f"{target}/{last.facts['folder']}", last.facts["copies"])


def forget_exports(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Delete the folders of all but the newest ``keep`` exports; readers of those must be done."""
    log = CommitLog(spark, target)
    for old in exports(spark, target)[: -max(1, keep)]:
        log.delete(old.folder)


def read_export(spark: SparkSession, target: str, published: Published | None = None) -> DataFrame:
    """Published items of the last export, or of ``published``; where an item was copied again, the later copy counts."""
    seen = published or current_export(spark, target)
    if seen is None:
        raise FileNotFoundError(f"nothing was exported to {target}")
    first = spark.read.parquet(f"{seen.folder}/items/attempt=0").withColumn("attempt", F.lit(0))
    if seen.copies == 1:
        return first
    second = spark.read.parquet(f"{seen.folder}/items/attempt=1").withColumn("attempt", F.lit(1))
    again = cut_lineage(second.select("path"), "again")
    return first.join(again, "path", "left_anti").unionByName(second)


def _actual(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("path", sha256_hex(F.col("content")).alias("sha256"))


def export_clean(
    spark: SparkSession, items: DataFrame, audit: DataFrame, target: str, now: str, write: Writer | None = None
) -> DataFrame:
    """Copy passed items and their audit rows under ``target``; returns the one-row verification summary.

    ``items``: path, stem, content, sha256 (hash taken before routing), and best also ``final_decision``, as judged
    rows have it: passed ones are then a filter, and no content is shuffled. Without it they are found by join.
    ``audit``: needs ``stem`` and ``qa.final_decision``. ``write`` copies a frame to a folder in place of Spark's own
    writer; as nothing is known of it, items are then staged first. Only items that fail verification are copied a second
    time.
    """
    passed = audit.filter(F.col("qa.final_decision") == "pass")
    size = F.col("length") if "length" in items.columns else F.octet_length("content")
    if "final_decision" in items.columns:
        allowed = items.filter(F.col("final_decision") == "pass")
    else:
        allowed = join_small(items, passed.select("stem").distinct(), ["stem"])
    chosen = allowed.select("path", "stem", "content", "sha256", size.cast("bigint").alias("size_bytes"))

    name = f"exports/{uuid.uuid4().hex}"
    folder = f"{target}/{name}"
    first, second = f"{folder}/items/attempt=0", f"{folder}/items/attempt=1"
    if write is None:
        chosen.write.parquet(first)
        held = spark.read.schema(chosen.schema).parquet(first)
    else:
        held = cut_lineage(chosen, "staged")
        write(held, first)
    held.select("path", "sha256", "size_bytes").write.parquet(f"{folder}/manifest_files")
    files = spark.read.parquet(f"{folder}/manifest_files")
    expected = files.select("path", "sha256")

    sanitize_for_export(passed).write.parquet(f"{folder}/audit")
    verify_hashes(expected, _actual(spark, first)).write.parquet(f"{folder}/checks/attempt=0")
    checked = spark.read.parquet(f"{folder}/checks/attempt=0")
    bad = checked.filter(F.col("status") != "verified").select("path")

    copies = 1
    if not bad.isEmpty():
        copies = 2
        source = chosen if write is None else held
        again = join_small(source, bad, ["path"], written=True)
        if write is None:
            again.write.parquet(second)
        else:
            write(again, second)
        verify_hashes(expected.join(bad, "path", "left_semi"), _actual(spark, second)).write.parquet(f"{folder}/checks/attempt=1")
        repaired = spark.read.parquet(f"{folder}/checks/attempt=1")
        checked = checked.join(bad, "path", "left_anti").unionByName(repaired)
        failures = repaired.filter(F.col("status") != "verified").select(
            F.lit("export").alias("operation"), "path", "status", F.lit(now).alias("timestamp")
        )
        failures.write.mode("append").json(f"{target}/failures")

    header = manifest_totals(files).select(
        F.lit(TRANSFER_MANIFEST_SCHEMA_NAME).alias("schema"),
        F.lit("export").alias("operation"),
        F.lit(target).alias("remote_uri"),
        F.lit(now).alias("timestamp"),
        "file_count",
        "total_bytes",
    )
    header.write.json(f"{folder}/manifest")
    CommitLog(spark, target).commit({"folder": name, "copies": copies, "timestamp": now})
    return hash_summary(checked)
