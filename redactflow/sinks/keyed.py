"""A keyed table as a log of versions, merged on read: one row per key, the newest.

An upsert writes its own rows as a new version and reads nothing else, so it costs what it brings. A version may also
replace groups (all rows of a batch, say): rows of older versions in these groups are gone. On read, keys and versions
alone decide which rows count; they travel as a table of names whose size Spark knows, while the rows stay where
they are. ``compact`` writes what counts as one version from which later reads start.

Every version is read by the schema it was written with, so no value is taken for a number or a date because it looks
like one, and later versions may have other columns. A null key is a key.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactflow.operators.joins import join_small
from redactflow.session import cut_lineage
from redactflow.sinks.log import Commit, CommitLog

_VERSION = "_version"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, group: str | None = None) -> None:
        self.spark, self.path, self.key, self.group = spark, path.rstrip("/"), key, group
        self.log = CommitLog(spark, self.path)

    def upsert(self, rows: DataFrame, replace_groups: bool = False, base: bool = False) -> int:
        """Publish ``rows``, whose keys must be unique, as the newest version; returns its number."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance").sortWithinPartitions(self.key).write.parquet(f"{self.path}/{folder}")
        facts = {"rows": folder, "schema": json.loads(rows.schema.json()), "base": base}
        if replace_groups:
            facts["groups"] = f"groups/{uuid.uuid4().hex}"
            written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
            written.select(self.group).distinct().write.parquet(f"{self.path}/{facts['groups']}")
        return self.log.commit(facts)

    def _rows(self, commit: Commit) -> DataFrame:
        schema = T.StructType.fromJson(commit.facts["schema"])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{commit.facts['rows']}")
        return rows.withColumn(_VERSION, F.lit(commit.version).cast("bigint"))

    def _replaced(self, commits: list[Commit]) -> DataFrame | None:
        """The newest version that replaces each group."""
        parts = []
        for c in commits:
            if c.facts.get("groups"):
                schema = T.StructType([T.StructType.fromJson(c.facts["schema"])[self.group]])
                groups = self.spark.read.schema(schema).parquet(f"{self.path}/{c.facts['groups']}")
                parts.append(groups.select(self.group, F.lit(c.version).cast("bigint").alias("_replaced")))
        if not parts:
            return None
        return reduce(DataFrame.unionByName, parts).groupBy(self.group).agg(F.max("_replaced").alias("_replaced"))

    def read(self) -> DataFrame | None:
        """One row per key; None if nothing was ever written."""
        commits = self.log.commits(since_last="base")
        if not commits:
            return None
        if len(commits) == 1:
            return self._rows(commits[0]).drop(_VERSION)
        oldest, later = self._rows(commits[0]), [self._rows(c) for c in commits[1:]]

        def union(frames: list[DataFrame]) -> DataFrame:
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

        newest = cut_lineage(union([d.select(self.key, _VERSION) for d in later]).groupBy(self.key).agg(F.max(_VERSION).alias("_newest")), "newest")
        # the first version, which may be nearly all there is, only loses rows
        kept = oldest.join(newest.withColumnRenamed(self.key, "_k"), _same(self.key, "_k"), "left_anti")
        fresh = join_small(union(later), newest, [self.key], written=True, null_safe=True).filter(F.col(_VERSION) == F.col("_newest")).drop("_newest")
        rows = union([kept, fresh])
        replaced = self._replaced(commits)
        if replaced is not None:
            rows = join_small(rows, replaced, [self.group], "left", null_safe=True)
            rows = rows.filter(F.coalesce(F.col("_replaced") <= F.col(_VERSION), F.lit(True))).drop("_replaced")
        return rows.drop(_VERSION)

    def compact(self) -> int | None:
        """Write what counts as one version. Versions committed meanwhile stay newer than what was merged."""
        seen = self.log.last()
        rows = self.read()
        if rows is None or seen.facts.get("base"):
            return None
        folder = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance").sortWithinPartitions(self.key).write.parquet(f"{self.path}/{folder}")
        if self.log.last().version != seen.version:
            self.log.delete(f"{self.path}/{folder}")
            raise RuntimeError("the table was written to while it was compacted; compact it again")
        return self.log.commit({"rows": folder, "schema": json.loads(rows.schema.json()), "base": True})


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
