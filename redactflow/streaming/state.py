"""Keyed state on streams: retry budgets and leases.

Before each keyed shuffle a stateless pass reduces every Arrow batch to the rows that can still matter, so a key
that fills much of a micro-batch reaches its state as a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from redactflow.config import DEFAULTS, Settings
from redactflow.operators.route import CLEAN, MANUAL, QUARANTINE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state in Python needs the RocksDB store. This holds for all streams the session starts from now on."""
    spark.conf.set(_PROVIDER, ROCKSDB)


@contextmanager
def rocksdb_state(spark: SparkSession, expiring: bool = False) -> Iterator[None]:
    """The RocksDB store for streams started inside; afterwards the session is as it was. ``expiring`` is for state with
    a time to live: Spark would otherwise follow each batch by empty ones for as long as the stream runs, so that draining
    never ends."""
    wanted = {_PROVIDER: ROCKSDB} | ({_EMPTY_BATCHES: "false"} if expiring else {})
    was = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _first_attempts(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The first ``budget`` failures and the first pass of each stem; nothing else can settle it."""
    ordered = rows.sort_values("attempt", kind="stable")
    nth = ordered.groupby(["stem", ordered["decision"] == "pass"], sort=False).cumcount()
    return ordered[nth < (ordered["decision"] == "pass").map({True: 1, False: budget})]


class _RetryBudget(StatefulProcessor):
    """Per stem either ``open``, the failures so far, or ``settled``, which may expire: only stems that still have budget
    are kept for as long as it takes."""

    def __init__(self, budget: int, keep_settled_ms: int | None):
        self.budget, self.keep_settled_ms = budget, keep_settled_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "retries int")
        self.settled = handle.getValueState("settled", "route string", self.keep_settled_ms)

    def _settle(self, route: str, was_open: bool) -> None:
        if was_open:
            self.open.clear()
        self.settled.update((route,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        if row["route"] == QUARANTINE:
            self.open.update((int(row["retry_count"]),))
        else:
            self._settle(row["route"], was_open=False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.settled.exists():
            return
        # each look at state is a call to the JVM
        held = self.open.get()
        retries = held[0] if held else 0
        fails, passes = [], []
        for part in rows:
            passed = (part["decision"] == "pass").to_numpy()
            attempt = part["attempt"].to_numpy()
            fails = sorted([*fails, *attempt[~passed].tolist()])[: self.budget]
            passes = sorted([*passes, *attempt[passed].tolist()])[:1]
        out = []
        for attempt, is_fail in sorted([(a, True) for a in fails] + [(a, False) for a in passes]):
            retries += is_fail
            route = CLEAN if not is_fail else MANUAL if retries >= self.budget else QUARANTINE
            out.append((key[0], attempt, route, retries))
            if route != QUARANTINE:
                self._settle(route, was_open=held is not None)
                break
        else:
            self.open.update((retries,))
        yield pd.DataFrame(out, columns=["stem", "attempt", "route", "retry_count"]).astype(
            {"stem": object, "attempt": "int64", "route": object, "retry_count": "int32"}
        )

    def close(self) -> None:
        pass


def retry_budget(
    attempts: DataFrame, settings: Settings = DEFAULTS, before: DataFrame | None = None, keep_settled_sec: int | None = None
) -> DataFrame:
    """Route of every attempt up to the one that settles its stem: quarantine until the budget is used up, then
    manual_review once; final_clean at the first pass. Attempts arrive in order across micro-batches.

    ``before`` is where stems stand when the stream starts (``retry_state`` of the log so far: stem, route, retry_count).
    With ``keep_settled_sec`` the note that a stem is settled expires after so long, so state is bounded by the stems that
    are open and those settled lately; choose it longer than a repeated attempt can be on its way, and start the stream
    inside ``rocksdb_state(spark, expiring=True)``.
    """
    budget = settings.max_retries

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield _first_attempts(rows, budget).astype({"stem": object, "decision": object})

    slim = attempts.select("stem", F.col("attempt").cast("bigint").alias("attempt"), "decision")
    schema = "stem string, attempt bigint, decision string"
    reduced = slim.mapInPandas(reduce, schema)
    known = None if before is None else before.select("stem", "route", F.col("retry_count").cast("int").alias("retry_count"))
    return reduced.groupBy("stem").transformWithStateInPandas(
        statefulProcessor=_RetryBudget(budget, None if keep_settled_sec is None else keep_settled_sec * 1000),
        outputStructType=StructType.fromDDL("stem string, attempt bigint, route string, retry_count int"),
        outputMode="Append",
        timeMode="None" if keep_settled_sec is None else "ProcessingTime",
        initialState=None if known is None else known.groupBy("stem"),
    )


def _merge(spans: list[tuple[int, int]], stale_us: int) -> list[tuple[int, int]]:
    """Spans of renewals in order, joined where no gap is longer than ``stale_us``."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first - out[-1][1] <= stale_us:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _runs(rows: pd.DataFrame, stale_us: int) -> pd.DataFrame:
    """Renewals of each lease in one batch as runs without a longer gap."""
    ordered = rows.sort_values(["lease", "at_us"], kind="stable")
    gap = ordered.groupby("lease", sort=False)["at_us"].diff()
    run = (gap.isna() | (gap > stale_us)).cumsum()
    spans = ordered.groupby(run, sort=False).agg(
        lease=("lease", "first"), first_us=("at_us", "min"), last_us=("at_us", "max")
    )
    return spans[["lease", "first_us", "last_us"]]


class _Leases(StatefulProcessor):
    """Times are microseconds since the epoch, so the session time zone plays no part."""

    def __init__(self, stale_us: int):
        self.stale_us = stale_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_us", "last_us bigint")

    def _due_ms(self, last_us: int) -> int:
        return -(-(last_us + self.stale_us) // 1000)

    def _frame(self, key, lasts: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"lease": [key[0]] * len(lasts), "last_us": lasts}).astype({"lease": object, "last_us": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs: list[tuple[int, int]] = []
        for part in rows:
            runs = _merge([*runs, *zip(part["first_us"].tolist(), part["last_us"].tolist())], self.stale_us)
        held = self.last.get()
        last = held[0] if held else None
        if last is not None:
            self.handle.deleteTimer(self._due_ms(last))
        released = []
        for first, end in runs:
            if last is not None and first - last > self.stale_us:
                released.append(last)
            last = end if last is None else max(last, end)
        self.last.update((last,))
        self.handle.registerTimer(self._due_ms(last))
        if released:
            yield self._frame(key, released)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        if held is None:
            return
        self.last.clear()
        yield self._frame(key, [held[0]])

    def close(self) -> None:
        pass


def stale_leases(renewals: DataFrame, settings: Settings = DEFAULTS, late: str = "0 seconds") -> DataFrame:
    """Releases of leases not renewed in time: ``lease, last_seen, released_at``.

    ``renewals``: lease string, ts timestamp. A release is emitted when a later renewal shows the gap, or by
    event-time timer once the watermark has passed it.
    """
    stale_us = settings.lock_stale_sec * 1_000_000

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield _runs(rows, stale_us).astype({"lease": object})

    slim = renewals.select("lease", F.unix_micros("ts").alias("at_us"))
    reduced = slim.mapInPandas(reduce, "lease string, first_us bigint, last_us bigint")
    released = (
        reduced.withColumn("seen", F.timestamp_micros("last_us"))
        .withWatermark("seen", late)
        .groupBy("lease")
        .transformWithStateInPandas(
            statefulProcessor=_Leases(stale_us),
            outputStructType=StructType.fromDDL("lease string, last_us bigint"),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return released.select(
        "lease",
        F.timestamp_micros("last_us").alias("last_seen"),
        F.timestamp_micros(F.col("last_us") + stale_us).alias("released_at"),
    )
