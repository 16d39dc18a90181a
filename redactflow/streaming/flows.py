"""Streaming versions of the flows: drain new items in bounded batches, keep live metrics.

``foreachBatch`` may repeat a batch after a failure, so every write is keyed by batch id and replaces itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from redactflow.config import DEFAULTS, Settings
from redactflow.image.ops import UNOPENED, Detector, judge_images, process_images
from redactflow.image.raster import Fill
from redactflow.operators.text import PATTERNS, anonymize_text
from redactflow.session import spread
from redactflow.sources.files import Decoders, content_reader, decode_batch, unopened_files

Step = Callable[[DataFrame], DataFrame]


def open_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """File stream over a folder; ``max_files`` bounds each micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def open_table_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of files. Its path must hold no signs of a pattern."""
    if re.search(r"[\\{}\[\]*?]", path):
        raise ValueError(f"a stream's table can't have pattern signs in its path: {path}")
    folder, name = path.rsplit("/", 1)
    # a plain path would have to be a folder; a pattern may match either
    return open_stream(spark, f"{folder}/[{name[0]}]{name[1:]}", schema, max_files=max_files)


def _replace_batch(target: str, prepare: Step | None = None) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        _put_batch(prepare(batch) if prepare else batch, batch_id, target, "overwrite")

    return write


def _put_batch(rows: DataFrame, batch_id: int, target: str, mode: str) -> None:
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id").parquet(target)


def write_batches(
    stream: DataFrame, target: str, checkpoint: str, mode: str = "append", prepare: Step | None = None
) -> DataStreamWriter:
    """Sink that writes each micro-batch, after ``prepare``, under its own ``batch_id`` partition."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_replace_batch(target, prepare))
    )


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: What opening a file counts for, in bytes, when files are dealt out to tasks, and how many tasks there are at least.
_OPEN_COST, _LEAST_TASKS, _SMALL = "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", 64 << 10


@contextmanager
def few_tasks(spark: SparkSession, small_files: bool = False) -> Iterator[None]:
    """Streams look up the files of a micro-batch in a few tasks for each core, as long as they are started and run inside,
    and with ``small_files`` read them so too. Spark would otherwise start a task for each file, each time it looks them up,
    and one for every 32 small files that it reads. Afterwards the session is as it was."""
    few = str(4 * spark.sparkContext.defaultParallelism)
    wanted = {_LISTING_TASKS: few} | ({_OPEN_COST: str(_SMALL), _LEAST_TASKS: few} if small_files else {})
    was = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in was.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drain(writer: DataStreamWriter, small_files: bool = False) -> StreamingQuery:
    """Process everything there is now, in bounded micro-batches, then stop. ``small_files``: the source has many files that
    are far smaller than a task's share of bytes."""
    with few_tasks(SparkSession.active(), small_files):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def read_latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Last written row per key, for sinks in update mode."""
    w = Window.partitionBy(key).orderBy(F.col("batch_id").desc())
    rows = spark.read.parquet(target).withColumn("_nth", F.row_number().over(w))
    return rows.filter(F.col("_nth") == 1).drop("_nth", "batch_id")


def stream_anonymize(
    items: DataFrame,
    column: str,
    target: str,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    patterns: Mapping[str, str] = PATTERNS,
    salt: str | None = None,
) -> DataStreamWriter:
    """Detect, mask, verify and route a text stream. A restart from the same checkpoint neither repeats nor loses items."""

    def prepare(batch: DataFrame) -> DataFrame:
        return anonymize_text(spread(batch), column, settings, patterns, salt)

    return write_batches(items, target, checkpoint, prepare=prepare)


def stream_images(
    items: DataFrame,
    make_face_detector: Callable[[], Detector],
    make_text_detector: Callable[[], Detector],
    target: str,
    checkpoint: str,
    mode: str | Fill = "boundary_mean",
    settings: Settings = DEFAULTS,
    make_embedder: Callable[[], Callable[[np.ndarray], Sequence[float]]] | None = None,
    decoders: Decoders | None = None,
) -> DataStreamWriter:
    """Image twin of ``stream_anonymize`` over ``open_image_stream``: rasters are made inside each micro-batch and go with
    their file's orientation and hash, so what is judged and recorded is what the batch flow judges and records. Files are
    read and processed in one pass; those that only the JVM can open follow in a second write of the same batch. No raster
    is processed twice."""
    read = content_reader(decoders)
    how = make_face_detector, make_text_detector, mode, settings, make_embedder
    unopened = F.col("error").eqNullSafe(UNOPENED)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        tried = process_images(spread(batch), *how, read)
        tried = tried.observe(seen, F.count("*").alias("files"), F.count_if(unopened).alias("left"))
        _put_batch(judge_images(tried.filter(~unopened), settings), batch_id, target, "overwrite")
        files, left = seen.get["files"], seen.get["left"]
        if left:
            rest = process_images(spread(decode_batch(unopened_files(batch, read))), *how)
            # a first write without rows has replaced nothing
            _put_batch(judge_images(rest, settings), batch_id, target, "append" if left < files else "overwrite")

    return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def _metrics(outcome: Column, seconds: Column) -> list[Column]:
    return [
        F.count("*").alias("processed"),
        F.count_if(outcome == "pass").alias("passed"),
        F.count_if(outcome == "quarantine").alias("quarantined"),
        F.count_if(outcome == "manual_review").alias("manual_review"),
        F.sum(seconds).alias("elapsed_sec"),
    ]


def _rates(counted: DataFrame) -> DataFrame:
    return counted.withColumns(
        {
            "success_rate": F.coalesce(F.try_divide("passed", "processed"), F.lit(0.0)),
            "quarantine_rate": F.coalesce(F.try_divide("quarantined", "processed"), F.lit(0.0)),
            "images_per_sec": F.coalesce(F.try_divide("processed", "elapsed_sec"), F.lit(0.0)),
        }
    )


def live_metrics(events: DataFrame, outcome: Column, seconds: Column, run: str = "run_id") -> DataFrame:
    """Running totals and rates per run; write in update mode. Partial sums are made before the shuffle."""
    return _rates(events.groupBy(run).agg(*_metrics(outcome, seconds)))


def windowed_metrics(
    events: DataFrame, outcome: Column, seconds: Column, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """The same per event-time window; windows close once the watermark passes them."""
    timed = events.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(*_metrics(outcome, seconds))
    return _rates(timed).withColumn("window_start", F.col("window.start")).drop("window")
