"""The keyed log: newest wins, replaced groups go, torn commits do not count, old data is not read."""

import glob
import json
import os
import shutil

import pytest

from redactflow.sinks.keyed import KeyedTable
from redactflow.sinks.log import CommitLog

DDL = "k string, g string, n int"


def rows(spark, data, ddl=DDL):
    return spark.createDataFrame(data, ddl)


def got(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


@pytest.fixture
def table(spark, folder):
    return KeyedTable(spark, f"{folder}/t", "k", "g")


def test_nothing_written(table):
    assert table.read() is None and table.compact() is None


def test_newest_wins(spark, table):
    table.upsert(rows(spark, [("a", "007", 0), ("b", "1e3", 0), (None, None, 0)]))
    table.upsert(rows(spark, [("a", "7", 1), ("c", "2024-01-01", 1)]))
    table.upsert(rows(spark, [(None, "007", 2), ("a", "007", 2)]))
    want = [("a", "007", 2), ("b", "1e3", 0), ("c", "2024-01-01", 1), (None, "007", 2)]
    assert got(table) == sorted(want, key=str)
    table.compact()
    assert got(table) == sorted(want, key=str) and len(table.log.commits(since_last="base")) == 1
    table.upsert(rows(spark, [("b", "1e3", 9)]))
    assert ("b", "1e3", 9) in got(table) and len(got(table)) == 4


def test_replaced_groups(spark, table):
    table.upsert(rows(spark, [("a", "x", 0), ("b", "x", 0), ("c", "y", 0), ("d", None, 0), ("e", None, 0)]), replace_groups=True)
    table.upsert(rows(spark, [("a", "x", 1), ("d", None, 1)]), replace_groups=True)
    assert got(table) == sorted([("a", "x", 1), ("c", "y", 0), ("d", None, 1)], key=str)
    # an item that moved away and whose new group is replaced without it does not come back
    table.upsert(rows(spark, [("c", "x", 2)]))
    table.upsert(rows(spark, [("a", "x", 3)]), replace_groups=True)
    assert got(table) == sorted([("a", "x", 3), ("d", None, 1)], key=str)


def test_an_upsert_reads_nothing_old(spark, table):
    table.upsert(rows(spark, [("a", "x", 0)]))
    shutil.rmtree(glob.glob(f"{table.path}/data/*")[0])
    table.upsert(rows(spark, [("b", "x", 1)]))
    assert [c.version for c in table.log.commits()] == [0, 1]


def test_columns_may_come_and_go(spark, table):
    table.upsert(rows(spark, [("a", "x", 0)]))
    table.upsert(rows(spark, [("b", "x", "new")], "k string, g string, extra string"))
    assert {r["k"]: (r["n"], r["extra"]) for r in table.read().collect()} == {"a": (0, None), "b": (None, "new")}


def test_cut_off_writers_leave_no_trace(spark, table):
    table.upsert(rows(spark, [("a", "x", 0)]))
    rows(spark, [("a", "x", 1)]).write.parquet(f"{table.path}/data/orphan")
    with open(f"{table.path}/_log/{1:020d}.json", "w") as out:
        out.write('{"rows": "data/orp')
    assert got(table) == [("a", "x", 0)]
    assert table.upsert(rows(spark, [("a", "x", 2)])) == 2 and got(table) == [("a", "x", 2)]


def test_two_writers_get_two_numbers(spark, folder):
    a, b = CommitLog(spark, folder), CommitLog(spark, folder)
    assert [a.commit({"by": 1}), b.commit({"by": 2}), a.commit({"by": 3})] == [0, 1, 2]
    # a number taken between looking and writing
    listed = a._files
    a._files = lambda: {0: None}
    assert a.commit({"by": 4}) == 3
    a._files = listed
    assert [c.facts["by"] for c in a.commits()] == [1, 2, 3, 4]
    assert json.load(open(f"{folder}/_log/{3:020d}.json"))["by"] == 4 and len(os.listdir(f"{folder}/_log")) >= 4


def test_compaction_gives_way_to_a_writer(spark, table):
    table.upsert(rows(spark, [("a", "x", 0)]))
    table.upsert(rows(spark, [("b", "x", 0)]))
    read = table.read

    def read_and_write():
        out = read()
        table.upsert(rows(spark, [("a", "x", 5)]))
        return out

    table.read = read_and_write
    with pytest.raises(RuntimeError, match="compact it again"):
        table.compact()
    table.read = read
    assert got(table) == [("a", "x", 5), ("b", "x", 0)]


def test_old_rows_stay_where_they_are(spark, table):
    """Merging shuffles names of the later versions and no row of the first."""
    table.upsert(rows(spark, [(f"k{i}", "x", i) for i in range(200)]))
    table.upsert(rows(spark, [(f"k{i}", "x", -i) for i in range(20)]))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
