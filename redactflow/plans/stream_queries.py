"""Queries run as streams over the given tables: drained to a table in the shared folder, then read back."""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS
from redactflow.image.ops import to_rgb
from redactflow.image.png import encode_png, insert_text_chunk, upright, with_orientation
from redactflow.operators.route import retry_state
from redactflow.plans.image_queries import FACE_LEVEL, TEXT_LEVEL, at_level, level_detector, rasters
from redactflow.plans.registry import query
from redactflow.plans.text_queries import AUDIT_COLUMNS, audited_select
from redactflow.plans.views import Tables
from redactflow.session import cut_lineage, scratch_path
from redactflow.sources.files import open_image_stream
from redactflow.streaming import (
    drain,
    live_metrics,
    open_stream,
    open_table_stream,
    read_batches,
    read_latest,
    retry_budget,
    rocksdb_state,
    stale_leases,
    stream_anonymize,
    stream_images,
    windowed_metrics,
    write_batches,
)

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(t: Tables) -> DataFrame:
    raw = open_table_stream(t.spark, f"{t.folder}/events.parquet", EVENTS)
    kind = F.col("event_type")
    outcome = F.when(kind == "signup", "quarantine").when(kind == "error", "manual_review").otherwise("pass")
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        (F.col("value") / 100).alias("seconds"),
        F.concat(F.lit("run-"), (F.expr("event_id div 500") % 2).cast("string")).alias("run_id"),
        outcome.alias("outcome"),
    )


@query(audited_select("documents", "doc_id", "text"))
def stream_anonymize_documents(t: Tables) -> DataFrame:
    target, checkpoint = scratch_path(t.spark, "clean"), scratch_path(t.spark, "progress")
    source = open_table_stream(t.spark, f"{t.folder}/documents.parquet", DOCUMENTS, max_files=64)
    drain(stream_anonymize(source.select("doc_id", "text"), "text", target, checkpoint))
    return read_batches(t.spark, target).select("doc_id", *AUDIT_COLUMNS)


_FACELESS = replace(DEFAULTS, ssim_min=-1.0, edge_ratio_max=float("inf"))


def _has_face() -> Callable[[np.ndarray], list[float]]:
    """Who is on a picture: someone, or no one."""

    def embed(rgb: np.ndarray) -> list[float]:
        seen = bool(at_level(rgb, FACE_LEVEL).any())
        return [float(seen), float(not seen)]

    return embed


def _turned_files(t: Tables, folder: str) -> DataFrame:
    """One PNG file in the folder for each raster, turned so that its EXIF orientation, 1 to 8, sets it upright. It carries
    its id as a text, so that files of equal rasters have different hashes. Gives vec_id and source_sha256 of each."""
    here = _made_folder(t, folder)

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for vec_id, height, width, data in rows.itertuples(index=False):
                to = 1 + vec_id % 8
                raw = upright(to_rgb(height, width, data), {6: 8, 8: 6}.get(to, to))
                out.append(insert_text_chunk(with_orientation(encode_png(raw), to), "id", str(vec_id)))
            yield pd.DataFrame({"vec_id": rows["vec_id"], "content": out})

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, times = TaskContext.get(), Counter()
        for rows in turn(batches):
            rows["source_sha256"] = [hashlib.sha256(content).hexdigest() for content in rows["content"]]
            for content, sha in rows[["content", "source_sha256"]].itertuples(index=False):
                name = sha[:16]  # short, as the driver holds the names of all files
                times[name] += 1
                # whatever attempt of the task comes last puts the same bytes under the same name
                name = f"{name}-{task.partitionId()}-{times[name]}.png"
                with open(f"{here}/.{name}-{task.taskAttemptId()}", "wb") as out:
                    out.write(content)
                os.replace(out.name, f"{here}/{name}")
            yield rows[["vec_id", "source_sha256"]]

    made = rasters(t).select("vec_id", "height", "width", "data")
    if here is not None:
        return cut_lineage(made.mapInPandas(put, "vec_id bigint, source_sha256 string"), "known")
    files = cut_lineage(made.mapInPandas(turn, "vec_id bigint, content binary"), "files")
    # Spark's text writer writes a string's bytes as they are and ends the line: a file for each row
    writer = files.select(F.col("content").cast("string").alias("value")).write.mode("append").option("maxRecordsPerFile", 1)
    # the tasks put their files in place themselves: the driver would move all of them, one by one
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
    return files.select("vec_id", F.sha2(F.concat("content", F.lit(b"\n")), 256).alias("source_sha256"))


def _made_folder(t: Tables, folder: str) -> str | None:
    """Makes the folder; its path for plain file calls if it is in a file system that is mounted, else None. Spark's writer
    starts two processes for each file there (``chmod``, for it and its checksum), which takes most of the time."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


@query(
    """SELECT vec_id, 1::BIGINT AS input_face_count, 0::BIGINT AS post_face_count, (label % 8) * 8::DOUBLE AS x0, (label // 8) * 8::DOUBLE AS y0,
    1.0::DOUBLE AS identity_distance, 'final_clean' AS route, TRUE AS hashed FROM embeddings"""
)
def stream_images_turned(t: Tables) -> DataFrame:
    """Image files that lie on their sides or are mirrored, drained from a folder: text is found where it is upright, the
    identity gate sees the face go, and the recorded hash is that of the file."""
    folder, target = scratch_path(t.spark, "photos"), scratch_path(t.spark, "clean")
    known = _turned_files(t, folder).distinct()
    source = open_image_stream(t.spark, folder, 16_384, (".png", ".txt"))
    make = level_detector(FACE_LEVEL, 4), level_detector(TEXT_LEVEL)
    writer = stream_images(source, *make, target, scratch_path(t.spark, "progress"), settings=_FACELESS, make_embedder=_has_face)
    drain(writer, small_files=True)
    corner = F.get("text_boxes", F.lit(0)).getField("polygon")[0]
    done = read_batches(t.spark, target).select(
        "source_sha256", "input_face_count", "post_face_count", corner[0].cast("double").alias("x0"), corner[1].cast("double").alias("y0"),
        "identity_distance", "route", (F.col("output_sha256") == F.sha2(F.col("content"), 256)).alias("hashed"),
    )
    return known.join(done, "source_sha256").drop("source_sha256")


@query("SELECT stem, attempt, route, CAST(fails AS BIGINT) AS retry_count FROM settling", "settling")
def stream_retry_budget(t: Tables) -> DataFrame:
    log, target = scratch_path(t.spark, "attempts"), scratch_path(t.spark, "routes")
    t.hard_attempts.select("stem", "attempt", "decision").write.parquet(log)
    source = open_stream(t.spark, log, "stem string, attempt bigint, decision string")
    with rocksdb_state(t.spark):
        drain(write_batches(retry_budget(source), target, scratch_path(t.spark, "progress")))
    return read_batches(t.spark, target).select("stem", "attempt", "route", "retry_count")


@query("SELECT stem, attempt, route, CAST(fails AS BIGINT) AS retry_count FROM settling WHERE attempt > 2", "settling")
def stream_retry_budget_resumed(t: Tables) -> DataFrame:
    """The first two attempts of each stem are history in a batch log; the stream takes up where they left off, and what
    is settled is forgotten after a day."""
    log, target = scratch_path(t.spark, "attempts"), scratch_path(t.spark, "routes")
    attempts = cut_lineage(t.hard_attempts.select("stem", "attempt", "decision"), "attempts")
    attempts.filter("attempt > 2").write.parquet(log)
    before = retry_state(attempts.filter("attempt <= 2"))
    source = open_stream(t.spark, log, "stem string, attempt bigint, decision string")
    with rocksdb_state(t.spark, expiring=True):
        routed = retry_budget(source, before=before, keep_settled_sec=86_400)
        drain(write_batches(routed, target, scratch_path(t.spark, "progress")))
    return read_batches(t.spark, target).select("stem", "attempt", "route", "retry_count")


_METRICS = """count(*) AS processed, count(*) FILTER (outcome = 'pass') AS passed,
    count(*) FILTER (outcome = 'quarantine') AS quarantined, count(*) FILTER (outcome = 'manual_review') AS manual_review,
    round(sum(value / 100), 6) AS elapsed_sec, round(count(*) FILTER (outcome = 'pass') / count(*)::DOUBLE, 6) AS success_rate,
    round(count(*) FILTER (outcome = 'quarantine') / count(*)::DOUBLE, 6) AS quarantine_rate,
    round(count(*) / sum(value / 100), 6) AS images_per_sec"""


@query(f"SELECT run_id, {_METRICS} FROM outcomes GROUP BY run_id", "outcomes")
def stream_live_metrics(t: Tables) -> DataFrame:
    target = scratch_path(t.spark, "metrics")
    metrics = live_metrics(_events(t), F.col("outcome"), F.col("seconds"))
    drain(write_batches(metrics, target, scratch_path(t.spark, "progress"), "update"))
    return read_latest(t.spark, target, "run_id")


@query(
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, {_METRICS} FROM outcomes
    GROUP BY date_trunc('hour', ts)""",
    "outcomes",
)
def stream_windowed_metrics(t: Tables) -> DataFrame:
    target = scratch_path(t.spark, "windows")
    metrics = windowed_metrics(_events(t), F.col("outcome"), F.col("seconds"))
    # update mode: windows that are still open when the input ends are written too
    drain(write_batches(metrics, target, scratch_path(t.spark, "progress"), "update"))
    out = read_latest(t.spark, target, "window_start")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    """SELECT CAST(user_id AS VARCHAR) AS lease, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS last_seen,
    strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS released_at FROM (
      SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later, max(ts) OVER () AS latest FROM events)
    WHERE later - ts > INTERVAL 1 HOUR OR (later IS NULL AND ts + INTERVAL 1 HOUR < latest)"""
)
def stream_stale_leases(t: Tables) -> DataFrame:
    target = scratch_path(t.spark, "releases")
    renewals = _events(t).select(F.col("user_id").cast("string").alias("lease"), "ts")
    with rocksdb_state(t.spark):
        drain(write_batches(stale_leases(renewals), target, scratch_path(t.spark, "progress")))
    shown = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return read_batches(t.spark, target).select(
        "lease", F.date_format("last_seen", shown).alias("last_seen"), F.date_format("released_at", shown).alias("released_at")
    )
