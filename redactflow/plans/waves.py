"""The run as a whole: process what is pending, route it, and go again until nothing is pending.

State is one append-only table of attempts, written once per wave. Where an item stands follows from its latest
attempt, so a run that was stopped continues from the table, and running again after the end does nothing.
Retries start from the original with the overrides of the next pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.operators import queue as Q
from redactflow.operators.joins import BROADCAST_ROWS
from redactflow.operators.qa import recycle_overrides
from redactflow.operators.route import CLEAN, MANUAL, QUARANTINE, latest_attempt
from redactflow.session import NO_TABLE, cut_lineage

Process = Callable[[DataFrame], DataFrame]


def read_attempts(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/attempts")
    except AnalysisException as exc:
        if exc.getCondition() not in NO_TABLE:
            raise
        return None


def current_state(attempts: DataFrame) -> DataFrame:
    """Latest attempt of each stem: every item is in exactly one place."""
    return latest_attempt(attempts.withColumn("attempt", F.col("wave")))


def settled_rows(attempts: DataFrame) -> DataFrame:
    """``current_state`` of a written table, outputs and all. Only names are compared; rows that a later wave has
    superseded, which are those of failures, are taken out where they are."""
    last = attempts.groupBy("stem").agg(F.min("wave").alias("_first"), F.max("wave").alias("_last"))
    again = cut_lineage(last.filter(F.col("_first") < F.col("_last")).select(F.col("stem").alias("_stem"), "_last"), "again")
    past = (F.col("stem") == F.col("_stem")) & (F.col("wave") < F.col("_last"))
    return attempts.join(again, past, "left_anti").select("stem", "wave", *[c for c in attempts.columns if c not in ("stem", "wave")])


def pick(items: DataFrame, pending: DataFrame, wanted: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Items named in ``pending`` (stem, path, retry_count; ``wanted`` rows), contents not shuffled if avoidable.

    A short pending list is broadcast. With a long one of new items, the names that are *not* pending are usually
    few (duplicate stems, rejects) and are broadcast instead. Otherwise a plain join.
    """
    if wanted <= limit:
        return items.join(F.broadcast(pending), ["stem", "path"])
    if pending.filter(F.col("retry_count") > 0).isEmpty():
        others = cut_lineage(items.select("stem", "path").join(pending, ["stem", "path"], "left_anti"))
        if others.count() <= limit:
            return items.join(F.broadcast(others), ["stem", "path"], "left_anti").withColumn("retry_count", F.lit(0))
    return items.join(pending, ["stem", "path"])


def run_waves(
    spark: SparkSession,
    items: DataFrame,
    process: Process,
    folder: str,
    rejected: DataFrame | None = None,
    locked: DataFrame | None = None,
    max_items: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Run to the end and return where each item stands.

    ``items``: stem, path and what ``process`` needs. ``process`` maps them, with ``retry_count`` and
    ``extra_mask_dilation`` added, to judged rows (``final_decision, failure_reason, route, retry_count,
    next_pass_overrides``, and any outputs, which stay in the attempts table). ``max_items`` fixes a pilot set. Items,
    ``rejected`` and ``locked`` are read when the run starts: its later waves hold what its first one left pending.
    """
    names = items.select("stem", "path")
    if max_items is not None:
        first = Q.first_per_stem(names.withColumn("priority", F.lit(1)))
        capped = cut_lineage(Q.pilot_cap(first.select("stem", "path"), max_items, [F.col("path"), F.col("stem")]))
        names = Q.within_cap(names, capped)
    pending = None
    for turn in range(settings.max_waves + 1):
        if pending is not None:
            pending = _still_pending(pending, attempts.filter(F.col("wave") == wave), settings)
        if pending is None:
            pending = cut_lineage(_pending(spark, names, read_attempts(spark, folder), rejected, locked, settings))
        wanted = pending.count()
        if wanted == 0:
            break
        if turn == settings.max_waves:
            raise RuntimeError(f"{wanted} items are still pending after {turn} waves")
        if turn == 0:
            before = read_attempts(spark, folder)
            wave = 0 if before is None else before.agg(F.max("wave")).first()[0] + 1
        else:
            wave += 1
        chosen = pick(items, pending, wanted)
        # what the failures so far ask for, counted from the original
        widened = recycle_overrides(F.col("retry_count")).getField("extra_mask_dilation")
        judged = process(chosen.withColumn("extra_mask_dilation", widened))
        # a wave that a crash left half written is written anew
        judged.write.mode("overwrite").parquet(f"{folder}/attempts/wave={wave}")
        attempts = read_attempts(spark, folder)
    done = read_attempts(spark, folder)
    if done is None:
        raise ValueError("nothing to process: no item is pending and no attempt was made before")
    return settled_rows(done)


def _still_pending(pending: DataFrame, judged: DataFrame, settings: Settings) -> DataFrame | None:
    """What a wave leaves pending of what was pending before it. Within a run nothing else changes, so that items that
    are settled are not ranked again. None where that can't be told from the wave's own rows: it has an item that was not
    pending, or a route that neither settles an item nor leaves it budget."""
    latest = latest_attempt(judged.select("stem", "path", "route", "retry_count", F.col("wave").alias("attempt")))
    tries = F.coalesce(F.col("_tries"), F.lit(0)).cast("int")
    held = F.coalesce((F.col("route") == QUARANTINE) & (tries < settings.max_retries), F.lit(False))
    settled = F.coalesce(F.col("route").isin(CLEAN, MANUAL), F.lit(False))
    known = pending.select("stem", F.col("path").alias("_was"), "retry_count", F.lit(True).alias("_asked"))
    found = latest.select("stem", "path", "route", F.col("retry_count").alias("_tries"), F.lit(True).alias("_judged"))
    both = known.join(found, "stem", "full").filter(~settled | F.col("_asked").isNull())
    left = both.select(
        "stem",
        F.when(F.col("_judged"), F.col("path")).otherwise(F.col("_was")).alias("path"),
        F.when(F.col("_judged"), tries).otherwise(F.col("retry_count")).alias("retry_count"),
        (F.col("_asked").isNull() | (F.col("_judged").isNotNull() & ~held)).alias("_odd"),
    )
    left = cut_lineage(left, "pending")
    return left.drop("_odd") if left.filter("_odd").isEmpty() else None


def _pending(
    spark: SparkSession,
    names: DataFrame,
    attempts: DataFrame | None,
    rejected: DataFrame | None,
    locked: DataFrame | None,
    settings: Settings,
) -> DataFrame:
    if attempts is None:
        held = spark.createDataFrame([], "stem string, path string, retry_count int")
        terminal = held.select("stem")
    else:
        # the original's path, never the failed output
        state = current_state(attempts.select("stem", "path", "route", "retry_count", "wave"))
        held = state.filter(F.col("route") == QUARANTINE)
        terminal = state.filter(F.col("route").isin(CLEAN, MANUAL)).select("stem")
    queue = Q.pending_queue(names, held, terminal, locked=locked, rejected=rejected, settings=settings)
    return queue.select("stem", "path", "retry_count")
