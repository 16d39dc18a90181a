from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactflow.operators import joins
from redactflow.operators.order import exact_percentiles, global_rank, group_ordinal, prefix_sums, running_by_index


def test_global_rank_matches_sort(spark):
    frame = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = {r["id"]: r["rank"] for r in global_rank(frame, [F.col("v"), F.col("id")], partitions=7).collect()}
    rows = sorted((r["v"], r["id"]) for r in frame.collect())
    assert got == {i: n for n, (_, i) in enumerate(rows, 1)}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_group_ordinal_with_hot_key(spark, partitions):
    # key 0 holds most rows and spans several partitions; others are small
    frame = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 40).alias("k"), F.xxhash64("id").alias("o")
    )
    got = {r["id"]: r["ordinal"] for r in group_ordinal(frame, ["k"], [F.col("o"), F.col("id")], partitions=partitions).collect()}
    want, seen = {}, {}
    for r in sorted(frame.collect(), key=lambda r: (r["k"], r["o"], r["id"])):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        want[r["id"]] = seen[r["k"]]
    assert got == want


def test_group_ordinal_null_key_and_empty(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, o int")
    rows = {(r["k"], r["o"]): r["ordinal"] for r in group_ordinal(frame, ["k"], [F.col("o")]).collect()}
    assert rows == {(None, 1): 1, (None, 2): 2, ("a", 1): 1}
    assert group_ordinal(frame.limit(0), ["k"], [F.col("o")]).count() == 0


def test_prefix_sums(spark):
    frame = spark.range(500).withColumn("w", F.col("id") % 7)
    rows = prefix_sums(frame, [F.col("id")], {"upto": "w"}, partitions=6).orderBy("id").collect()
    assert [r["upto"] for r in rows] == list(np.cumsum(np.arange(500) % 7))


def test_running_by_index_across_chunks(spark):
    frame = spark.range(300).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).alias("i"), F.col("id").alias("v"))
    rows = running_by_index(frame, ["run"], "i", {"s": "v"}, chunk=16).collect()
    for run in (0, 1):
        mine = sorted((r["i"], r["v"], r["s"]) for r in rows if r["run"] == run)
        assert [m[2] for m in mine] == list(np.cumsum([m[1] for m in mine]))


def test_exact_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=501).tolist(), "b": rng.integers(0, 5, 501).astype(float).tolist()}
    frame = spark.createDataFrame(list(zip(data["a"], data["b"])), "a double, b double").union(
        spark.createDataFrame([(None, None)], "a double, b double")
    )
    rows = exact_percentiles(frame, {"a": F.col("a"), "b": F.col("b")}, [0.05, 0.5, 0.95]).collect()
    for r in rows:
        assert r["n"] == 501
        for p, name in ((5, "p5"), (50, "p50"), (95, "p95")):
            assert r[name] == pytest.approx(np.percentile(data[r["metric"]], p))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_join_small(spark, how, null_safe):
    key = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 3 != 0, 1).otherwise(F.col("id") % 9)
    left = spark.range(200).select("id", key.alias("k"))
    right = spark.createDataFrame([(1, "one"), (3, "three"), (None, "none")], "k bigint, name string")
    rows = joins.join_small(left, right, ["k"], how, null_safe=null_safe).collect()
    names = {1: "one", 3: "three"} | ({None: "none"} if null_safe else {})
    want = [(r["id"], names.get(r["k"])) for r in left.collect() if how == "left" or r["k"] in names]
    assert sorted((r["id"], r["name"]) for r in rows) == sorted(want)


def test_prefix_sums_of_decimals_are_exact(spark):
    rows = [(i, Decimal(f"{i}.0{i % 10}")) for i in range(1, 200)]
    data = spark.createDataFrame(rows, "i long, d decimal(20,2)")
    got = {r["i"]: r["s"] for r in prefix_sums(data, [F.col("i")], {"s": "d"}).collect()}
    total = Decimal(0)
    for i, d in rows:
        total += d
        assert got[i] == total
