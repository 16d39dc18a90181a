import hashlib
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from redactflow import streaming as S
from redactflow.operators.route import retry_state
from redactflow.operators.text import anonymize_text
from redactflow.sources.files import FILE_DDL
from tests.helpers import by, write_bytes

SCHEMA = "id bigint, text string"


def put(spark, folder, rows, schema):
    """One more input file, with a later modification time than the ones before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


@pytest.fixture
def inbox(spark, folder):
    for n in range(4):
        put(spark, f"{folder}/in", [(n * 10 + i, f"row {n} {i} mail a{i}@b.co and more words here") for i in range(5)], SCHEMA)
    return folder


def rows_of(frame):
    return sorted((r["id"], r["masked"], r["route"]) for r in frame.select("id", "masked", "route").collect())


def run_anonymize(spark, base, stop_after=None):
    source = S.open_stream(spark, f"{base}/in", SCHEMA, max_files=1)
    writer = S.stream_anonymize(source, "text", f"{base}/out", f"{base}/ck")
    if stop_after is None:
        return S.drain(writer)
    query = writer.trigger(processingTime="0 seconds").start()
    while query.lastProgress is None or query.lastProgress["batchId"] < stop_after:
        time.sleep(0.05)
    query.stop()
    return query


def test_stream_equals_batch_in_bounded_batches(spark, inbox):
    run_anonymize(spark, inbox)
    got = S.read_batches(spark, f"{inbox}/out")
    assert rows_of(got) == rows_of(anonymize_text(spark.read.parquet(f"{inbox}/in"), "text"))
    assert got.select("batch_id").distinct().count() == 4


def test_restart_neither_repeats_nor_loses(spark, inbox):
    run_anonymize(spark, inbox, stop_after=1)
    put(spark, f"{inbox}/in", [(99, "late a@b.co row with some more words")], SCHEMA)
    run_anonymize(spark, inbox)
    want = rows_of(anonymize_text(spark.read.parquet(f"{inbox}/in"), "text"))
    assert rows_of(S.read_batches(spark, f"{inbox}/out")) == want
    files = sorted(os.listdir(f"{inbox}/out"))
    run_anonymize(spark, inbox)  # nothing new: nothing happens
    assert rows_of(S.read_batches(spark, f"{inbox}/out")) == want and sorted(os.listdir(f"{inbox}/out")) == files


def test_files_of_a_batch_are_listed_in_few_tasks(spark, inbox):
    key, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    before = spark.conf.get(key, None)

    def prepare(batch):
        # the source reads the session's own setting, the batch that of the stream's copy
        seen.append((spark.conf.get(key), batch.sparkSession.conf.get(key)))
        return batch

    source = S.open_stream(spark, f"{inbox}/in", SCHEMA, max_files=1)
    S.drain(S.write_batches(source, f"{inbox}/out", f"{inbox}/ck", prepare=prepare))
    few = str(4 * spark.sparkContext.defaultParallelism)
    assert seen == [(few, few)] * 4 and spark.conf.get(key, None) == before


def test_equal_pictures_are_told_apart(spark, folder):
    from redactflow.plans.stream_queries import stream_images_turned
    from redactflow.plans.views import Tables

    some = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 4")
    # the same pictures under other ids, turned the same way, and one row twice
    again = some.withColumn("vec_id", F.col("vec_id") + 800)
    some.unionByName(again).unionByName(some.filter("vec_id = 2")).write.parquet(f"{folder}/embeddings.parquet")
    got = stream_images_turned(Tables(spark, folder)).collect()
    assert sorted(r["vec_id"] for r in got) == [0, 1, 2, 2, 3, 800, 801, 802, 803]
    assert all(r["hashed"] and r["route"] == "final_clean" for r in got)


def test_small_files_are_read_in_few_tasks(spark, folder):
    for i in range(200):
        write_bytes(f"{folder}/in/{i}.bin", b"x")
    source, tasks = spark.readStream.format("binaryFile").schema(FILE_DDL).load(f"{folder}/in"), []

    def prepare(batch):
        tasks.append(batch.rdd.getNumPartitions())
        return batch.select("path")

    keys = "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
    before, most = [spark.conf.get(k, None) for k in keys], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")  # a task for every two files otherwise
        S.drain(S.write_batches(source, f"{folder}/out", f"{folder}/ck", prepare=prepare), small_files=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    few = 4 * spark.sparkContext.defaultParallelism
    assert len(tasks) == 1 and tasks[0] <= few + 1 and [spark.conf.get(k, None) for k in keys] == before
    assert S.read_batches(spark, f"{folder}/out").count() == 200


def test_a_picture_of_each_row_is_written_without_a_process_of_its_own(spark, folder):
    from redactflow.plans.stream_queries import _turned_files
    from redactflow.plans.views import Tables

    some = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 40")
    some.unionByName(some.filter("vec_id = 2")).write.parquet(f"{folder}/embeddings.parquet")
    known = _turned_files(Tables(spark, folder), f"{folder}/a folder").collect()
    names = os.listdir(f"{folder}/a folder")
    # Spark's writer leaves a checksum beside each file and starts a process for either
    assert len(names) == 41 and all(n.endswith(".png") for n in names)
    found = []
    for name in names:
        with open(f"{folder}/a folder/{name}", "rb") as file:
            found.append(hashlib.sha256(file.read()).hexdigest())
    assert sorted(found) == sorted(r["source_sha256"] for r in known)
    assert sorted(r["vec_id"] for r in known) == sorted([*range(40), 2])


def test_pictures_of_a_store_that_only_spark_reaches(spark, folder, monkeypatch):
    from redactflow.plans import stream_queries
    from redactflow.plans.views import Tables

    made = stream_queries._made_folder
    monkeypatch.setattr(stream_queries, "_made_folder", lambda t, path: made(t, path) and None)
    some = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 9")
    some.write.parquet(f"{folder}/embeddings.parquet")
    got = stream_queries.stream_images_turned(Tables(spark, folder)).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(9)) and all(r["hashed"] and r["x0"] is not None for r in got)


def test_repeated_batch_replaces_itself(spark, folder):
    from redactflow.streaming.flows import _replace_batch

    write = _replace_batch(f"{folder}/out")
    batch = spark.range(3)
    write(batch, 0)
    write(batch, 1)
    write(batch, 1)
    assert spark.read.parquet(f"{folder}/out").count() == 6


ATTEMPTS = "stem string, attempt bigint, decision string"
LOG = {"a": "FFFFP", "b": "PFF", "c": "FFP", "d": "F", "e": "F" * 30}


def test_retry_budget_across_batches(spark, folder):
    S.use_rocksdb(spark)
    rows = [(s, i, "pass" if c == "P" else "fail") for s, text in LOG.items() for i, c in enumerate(text, 1)]
    for low, high in ((1, 1), (2, 2), (3, 4), (5, 99)):
        put(spark, f"{folder}/in", [r for r in rows if low <= r[1] <= high], ATTEMPTS)
    source = S.open_stream(spark, f"{folder}/in", ATTEMPTS, max_files=1)
    S.drain(S.write_batches(S.retry_budget(source), f"{folder}/out", f"{folder}/ck"))
    out = spark.read.parquet(f"{folder}/out").orderBy("stem", "attempt").collect()
    routes = {}
    for r in out:
        routes.setdefault(r["stem"], []).append(r["route"])
    assert routes == {
        "a": ["quarantine", "quarantine", "manual_review"],
        "b": ["final_clean"],
        "c": ["quarantine", "quarantine", "final_clean"],
        "d": ["quarantine"],
        "e": ["quarantine", "quarantine", "manual_review"],  # emitted once, however many failures follow
    }
    batch = by(retry_state(spark.createDataFrame(rows, ATTEMPTS)).collect(), "stem")
    assert {s: r[-1] for s, r in routes.items()} == {s: r["route"] for s, r in batch.items()}


def test_retry_budget_goes_on_from_a_batch_log(spark, folder):
    rows = [(s, i, "pass" if c == "P" else "fail") for s, text in LOG.items() for i, c in enumerate(text, 1)]
    before = retry_state(spark.createDataFrame([r for r in rows if r[1] <= 2], ATTEMPTS))
    put(spark, f"{folder}/in", [r for r in rows if r[1] > 2] + [("new", 1, "fail")], ATTEMPTS)
    with S.rocksdb_state(spark):
        source = S.open_stream(spark, f"{folder}/in", ATTEMPTS)
        S.drain(S.write_batches(S.retry_budget(source, before=before), f"{folder}/out", f"{folder}/ck"))
    got = {(r["stem"], r["attempt"], r["route"], r["retry_count"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {("a", 3, "manual_review", 3), ("c", 3, "final_clean", 2), ("e", 3, "manual_review", 3), ("new", 1, "quarantine", 1)}


def test_settled_stems_expire_and_open_ones_stay(spark, folder):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)

    def feed(rows):
        put(spark, f"{folder}/in", rows, ATTEMPTS)
        source = S.open_stream(spark, f"{folder}/in", ATTEMPTS)
        S.drain(S.write_batches(S.retry_budget(source, keep_settled_sec=1), f"{folder}/out", f"{folder}/ck"))

    def held(name):
        state = spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/ck")
        return sorted(r["key"]["stem"] for r in state.collect())

    with S.rocksdb_state(spark, expiring=True):
        feed([(f"s{i}", 1, "pass") for i in range(50)] + [("open", 1, "fail")])
        assert held("open") == ["open"] and len(held("settled")) == 50
        time.sleep(2)
        feed([("late", 1, "fail")])
        feed([("later", 1, "fail"), ("open", 2, "fail"), ("open", 3, "fail")])
        assert held("open") == ["late", "later"] and held("settled") == ["open"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == was


def test_reduction_before_the_shuffle_keeps_what_matters():
    from redactflow.streaming.state import _first_attempts

    rows = pd.DataFrame(
        [("e", i, "fail") for i in range(50, 0, -1)] + [("e", 60, "pass"), ("e", 61, "pass"), ("f", 1, "pass")],
        columns=["stem", "attempt", "decision"],
    )
    kept = _first_attempts(rows, 3)
    assert sorted(zip(kept["stem"], kept["attempt"])) == [("e", 1), ("e", 2), ("e", 3), ("e", 60), ("f", 1)]


RENEWALS = "lease string, ts timestamp"


def at(text):
    return pd.Timestamp(text).to_pydatetime()


def test_stale_leases(spark, folder):
    S.use_rocksdb(spark)
    put(spark, f"{folder}/in", [("a", at("2024-01-01 00:00")), ("a", at("2024-01-01 00:40")), ("b", at("2024-01-01 00:10"))], RENEWALS)
    put(spark, f"{folder}/in", [("a", at("2024-01-01 01:30")), ("c", at("2024-01-01 01:05"))], RENEWALS)
    put(spark, f"{folder}/in", [("b", at("2024-01-01 05:00")), ("c", at("2024-01-01 02:04"))], RENEWALS)
    source = S.open_stream(spark, f"{folder}/in", RENEWALS, max_files=1)
    S.drain(S.write_batches(S.stale_leases(source), f"{folder}/out", f"{folder}/ck"))
    got = sorted((r["lease"], str(r["last_seen"])[11:16], str(r["released_at"])[11:16]) for r in spark.read.parquet(f"{folder}/out").collect())
    # a was renewed within the hour until 01:30; b went silent at 00:10; c was renewed after 59 minutes
    assert got == [("a", "01:30", "02:30"), ("b", "00:10", "01:10"), ("c", "02:04", "03:04")]


EVENTS = "run_id string, ts timestamp, outcome string, seconds double"


def test_live_metrics_update_mode(spark, folder):
    put(spark, f"{folder}/in", [("r", at("2024-01-01 00:00"), "pass", 1.0), ("q", at("2024-01-01 00:00"), "pass", 1.0)], EVENTS)
    put(spark, f"{folder}/in", [("r", at("2024-01-01 00:05"), "quarantine", 3.0)], EVENTS)
    source = S.open_stream(spark, f"{folder}/in", EVENTS, max_files=1)
    metrics = S.live_metrics(source, F.col("outcome"), F.col("seconds"))
    S.drain(S.write_batches(metrics, f"{folder}/out", f"{folder}/ck", "update"))
    got = by(S.read_latest(spark, f"{folder}/out", "run_id").collect(), "run_id")
    assert (got["r"]["processed"], got["r"]["quarantine_rate"], got["r"]["images_per_sec"]) == (2, 0.5, 0.5)
    assert got["q"]["processed"] == 1
    assert spark.read.parquet(f"{folder}/out").filter("run_id = 'q'").count() == 1  # unchanged runs are not written again


def test_windowed_metrics_drop_late_rows(spark, folder):
    put(spark, f"{folder}/in", [("r", at("2024-01-01 00:10"), "pass", 1.0), ("r", at("2024-01-01 02:30"), "pass", 1.0)], EVENTS)
    put(spark, f"{folder}/in", [("r", at("2024-01-01 04:30"), "pass", 1.0)], EVENTS)
    put(spark, f"{folder}/in", [("r", at("2024-01-01 00:20"), "pass", 1.0), ("r", at("2024-01-01 06:30"), "pass", 1.0)], EVENTS)
    source = S.open_stream(spark, f"{folder}/in", EVENTS, max_files=1)
    metrics = S.windowed_metrics(source, F.col("outcome"), F.col("seconds"))
    S.drain(S.write_batches(metrics, f"{folder}/out", f"{folder}/ck"))
    got = sorted((r["window_start"].hour, r["processed"]) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(0, 1), (2, 1), (4, 1)]


def test_table_that_is_a_folder_of_files(spark, folder):
    """A table is one file or a folder of files."""
    rows = [(i, f"row {i} mail a{i}@b.co") for i in range(20)]
    table = f"{folder}/in put/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(table)
    one = f"{folder}/in put/one.parquet"
    pd.DataFrame(rows, columns=["id", "text"]).to_parquet(one)
    for n, path in enumerate((table, one)):
        target = f"{folder}/out{n}"
        S.drain(S.stream_anonymize(S.open_table_stream(spark, path, SCHEMA), "text", target, f"{folder}/ck{n}"))
        assert sorted(r["id"] for r in S.read_batches(spark, target).collect()) == list(range(20))


class _CountedState:
    """A value state that notes each call, as each is a round trip to the JVM."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_a_budget_is_asked_once():
    from redactflow.streaming.state import _RetryBudget

    def attempts(*decisions):
        return iter([pd.DataFrame({"attempt": range(len(decisions)), "decision": decisions})])

    calls = []
    budget = _RetryBudget(3, None)
    budget.open, budget.settled = _CountedState(calls), _CountedState(calls)
    list(budget.handleInputRows(("a",), attempts("fail"), None))
    assert calls == ["exists", "get", "update"] and budget.open.value == (1,)
    calls.clear()
    (out,) = budget.handleInputRows(("a",), attempts("fail", "pass"), None)
    assert out["route"].tolist() == ["quarantine", "final_clean"] and out["retry_count"].tolist() == [2, 2]
    assert calls == ["exists", "get", "clear", "update"] and budget.open.value is None
    calls.clear()
    budget.settled.value = None
    budget.handleInitialState(("b",), pd.DataFrame({"route": ["manual_review"], "retry_count": [3]}), None)
    assert calls == ["update"]


def test_a_lease_is_asked_once():
    from redactflow.streaming.state import _Leases

    calls, leases, timers = [], _Leases(10), set()
    leases.last = _CountedState(calls)
    leases.handle = type("Timers", (), {"registerTimer": lambda self, at: timers.add(at), "deleteTimer": lambda self, at: timers.discard(at)})()
    assert list(leases.handleInputRows(("a",), iter([pd.DataFrame({"first_us": [1], "last_us": [5]})]), None)) == []
    assert calls == ["get", "update"] and timers == {1}
    calls.clear()
    (out,) = leases.handleExpiredTimer(("a",), None, None)
    assert calls == ["get", "clear"] and out["last_us"].tolist() == [5]
