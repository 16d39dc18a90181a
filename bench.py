"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from redactflow.plans.catalog import REGISTRY  # noqa: E402
from redactflow.session import clear_scratch, local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "anonymize_text_totals",
    "anonymize_text_documents",
    "detect_entities_documents",
    "pseudonymize_documents",
    "redact_secrets_documents",
    "pending_queue",
    "verify_hashes",
    "verify_listing",
    "attach_detections",
    "assign_batches",
    "running_progress",
    "calibrate_thresholds",
    "route",
    "retry_state",
    "latest_per_type",
    "unfinished_items",
    "anonymize_images",
    "stream_anonymize_documents",
    "stream_retry_budget",
)


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    frame: DataFrame = REGISTRY[name](spark, FOLDER)
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    checkpoint = os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = local_session(CPUS, "bench", **{"spark.checkpoint.dir": checkpoint})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("sum(length(text))").collect()
    run(spark, "master_statistics")  # warm the JVM
    times, images = {}, None
    for name in sys.argv[1:] or HEADLINE:
        times[name] = round(run(spark, name), 3)
    if times.get("anonymize_images"):
        n = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
        images = round(n / times["anonymize_images"], 1)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "images_per_sec": images,
        "documents_per_sec": round(documents / times["anonymize_text_documents"], 1)
        if times.get("anonymize_text_documents")
        else None,
    }
    clear_scratch(spark)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
