"""The work queue: what is pending, what to skip, how it is cut into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.functions.times import is_stale
from redactflow.operators.order import global_rank

TOP_N_LIMIT = 100_000  # above this a cap is taken by rank instead of by a one-task top-n


def first_per_stem(candidates: DataFrame) -> DataFrame:
    """One candidate per stem by ``priority`` then ``path``. The rank limit keeps one row per stem and task
    before the shuffle, so a stem with very many candidates stays cheap."""
    w = Window.partitionBy("stem").orderBy("priority", "path")
    return candidates.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def pending_queue(
    raw: DataFrame,
    quarantine: DataFrame,
    terminal: DataFrame,
    locked: DataFrame | None = None,
    processed: DataFrame | None = None,
    rejected: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Items to work on: quarantined ones with retries left, then raw ones, one per stem.

    ``terminal`` holds the stems in final_clean and manual_review. All exclusions are de-duplicated into one
    list of stems and removed by one anti-join that uses the partitioning the per-stem step already made.
    """
    retries = quarantine.filter(F.coalesce("retry_count", F.lit(0)) < settings.max_retries).select(
        "stem", "path", F.coalesce("retry_count", F.lit(0)).cast("int").alias("retry_count"), F.lit(0).alias("priority")
    )
    fresh = raw.select("stem", "path", F.lit(0).cast("int").alias("retry_count"), F.lit(1).alias("priority"))
    excluded = terminal.select("stem")
    for other in (locked, processed, rejected):
        if other is not None:
            excluded = excluded.unionByName(other.select("stem"))
    return first_per_stem(retries.unionByName(fresh)).join(excluded.distinct(), "stem", "left_anti")


def skip_set(manifest: DataFrame, outputs: DataFrame, current: DataFrame) -> DataFrame:
    """Stems already done: an output exists and every source of the stem still has the recorded hash.

    The three tables are stacked and grouped once, so each is shuffled once and repeated stems collapse before that.
    """
    nothing = F.lit(None).cast("string")
    stacked = (
        manifest.select("stem", F.lower("original_hash").alias("_known"), nothing.alias("_now"), F.lit(False).alias("_out"))
        .unionByName(current.select("stem", nothing.alias("_known"), F.lower("sha256").alias("_now"), F.lit(False).alias("_out")))
        .unionByName(outputs.select("stem", nothing.alias("_known"), nothing.alias("_now"), F.lit(True).alias("_out")))
    )
    per_stem = stacked.groupBy("stem").agg(
        F.min("_known").alias("known"), F.max("_known").alias("known_max"),
        F.min("_now").alias("now"), F.max("_now").alias("now_max"),
        F.bool_or("_out").alias("published"),
    )
    same = (F.col("known") == F.col("now")) & (F.col("known_max") == F.col("known")) & (F.col("now_max") == F.col("now"))
    return per_stem.filter(F.col("published") & same).select("stem")


def _open_locks(locks: DataFrame, completions: DataFrame) -> DataFrame:
    return locks.join(completions.select("batch_index").distinct(), "batch_index", "left_anti")


def active_locks(locks: DataFrame, completions: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Stems being worked on: lock not stale at ``now`` and batch not completed."""
    live = _open_locks(locks, completions).filter(~is_stale(F.col("started_at"), now, settings.lock_stale_sec))
    return live.select(F.explode("stems").alias("stem")).distinct()


def resumable_batches(locks: DataFrame, completions: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Incomplete batches whose lock went stale."""
    return _open_locks(locks, completions).filter(is_stale(F.col("started_at"), now, settings.lock_stale_sec))


def merge_completed(completed: DataFrame, finished: DataFrame) -> DataFrame:
    """Union of finished stems, one row per (batch_index, stem)."""
    return completed.select("batch_index", "stem").unionByName(finished.select("batch_index", "stem")).distinct()


def unfinished_items(items: DataFrame, completed: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items of a batch that are neither marked completed nor have an output in that batch."""
    done = merge_completed(completed, outputs)
    return items.join(done, ["batch_index", "stem"], "left_anti")


def lock_progress(locks: DataFrame, finished: Column) -> DataFrame:
    """Lock rows with ``finished`` (array of stems) merged in, and the stems still open."""
    merged = F.array_sort(F.array_union(F.coalesce("completed_stems", F.array().cast("array<string>")), finished))
    out = locks.withColumn("completed_stems", merged)
    return out.withColumn("open_stems", F.array_except("stems", "completed_stems"))


def assign_batches(queue: DataFrame, order: list[Column], size: int, partitions: int | None = None) -> DataFrame:
    """Consecutive batches of ``size`` over the ordered queue: adds ``rank`` (from 1) and ``batch_index`` (from 0)."""
    ranked = global_rank(queue, order, "rank", partitions)
    return ranked.withColumn("batch_index", F.expr(f"(rank - 1) div {int(size)}"))


def pilot_cap(queue: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` items in order. A small cap is a top-n; a large one is taken by distributed rank."""
    if n <= TOP_N_LIMIT:
        return queue.orderBy(*order).limit(n)
    return global_rank(queue, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def within_cap(queue: DataFrame, capped: DataFrame) -> DataFrame:
    """Later waves stay inside the set fixed at the start of the run."""
    return queue.join(capped.select("stem").distinct(), "stem", "left_semi")


def sample_problems(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Top ``n`` problem rows for a report."""
    return rows.orderBy(*order).limit(n)
