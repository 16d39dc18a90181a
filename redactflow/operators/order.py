"""Global order without a single-partition window: ranks, running sums, exact percentiles.

All of them range-partition once on a unique order, cut lineage there so that later passes see the very same
partitions, and then need only one number per partition on the driver (as many as there are partitions, never
as many as there are rows).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from redactflow.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number in the partition below


def _partitions(df: DataFrame, wanted: int | None) -> int:
    return wanted or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _in_order(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """Adds ``_part`` and ``_pos``: partition number in key order, row number inside it (from 0)."""
    spread = (
        df.repartitionByRange(_partitions(df, partitions), *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", _ROW_BITS).cast("int")
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return cut_lineage(spread).withColumns({"_part": part, "_pos": pos}).drop("_mid")


def _per_part(values: Sequence[float], dtype: str) -> Column:
    """The value of a row's own partition, from one constant list."""
    listed = F.split(F.lit(",".join(str(v) if isinstance(v, Decimal) else repr(v) for v in values)), ",").cast(f"array<{dtype}>")
    return F.element_at(listed, F.col("_part") + 1)


def _offsets(per_part: Mapping[int, float], count: int, zero: float) -> list[float]:
    return [zero, *accumulate(per_part.get(i, zero) for i in range(count))][:count]


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (end it with a unique key). One range shuffle, no window."""
    n = _partitions(df, partitions)
    placed = _in_order(df, order, n)
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    rank = _per_part(_offsets(counts, n, 0), "bigint") + F.col("_pos") + 1
    return placed.withColumn(name, rank).drop("_part", "_pos")


def group_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal", partitions: int | None = None
) -> DataFrame:
    """1-based position inside each key group, for groups of any size.

    Rows are range-partitioned by key and order, so a key holding a third of all rows covers many partitions.
    A group that runs over a partition edge is continued through one start position per partition.
    """
    n = _partitions(df, partitions)
    placed = _in_order(df, [*[F.col(k) for k in keys], *order], n)
    groups = placed.groupBy("_part", *keys).agg(F.min("_pos").alias("_start"), F.count("*").alias("_n"))
    key = F.struct(*keys)
    edges = groups.groupBy("_part").agg(
        F.sum("_n").alias("n"),
        F.max("_start").alias("last_start"),
        F.min_by(key, "_start").alias("first_key"),
        F.max_by(key, "_start").alias("last_key"),
    )
    offsets, starts = _group_starts({r["_part"]: r for r in edges.collect()}, n)

    before, first = _per_part(offsets, "bigint"), _per_part(starts, "bigint")
    local = F.min("_pos").over(Window.partitionBy("_part", *keys))
    start = F.when(F.col("_local") == 0, first).otherwise(before + F.col("_local"))
    ordinal = before + F.col("_pos") - start + 1
    return placed.withColumn("_local", local).withColumn(name, ordinal).drop("_part", "_pos", "_local")


def _group_starts(edges: Mapping[int, Row], count: int) -> tuple[list[int], list[int]]:
    """Per partition: rows before it, and the global start of the group its first row belongs to."""
    offsets, starts = [], []
    seen, open_key, open_start = 0, None, 0
    for part in range(count):
        edge = edges.get(part)
        offsets.append(seen)
        if edge is None:
            starts.append(seen)
            continue
        first_start = open_start if edge["first_key"] == open_key else seen
        starts.append(first_start)
        open_key = edge["last_key"]
        open_start = seen + edge["last_start"] if edge["last_start"] > 0 else first_start
        seen += edge["n"]
    return offsets, starts


def prefix_sums(
    df: DataFrame, order: Sequence[Column], sums: Mapping[str, str], partitions: int | None = None
) -> DataFrame:
    """Running totals over the whole order. ``sums`` maps new column to summed column; ``order`` must be unique."""
    n = _partitions(df, partitions)
    placed = _in_order(df, order, n)
    totals = placed.groupBy("_part").agg(*[F.sum(src).alias(out) for out, src in sums.items()]).collect()
    in_part = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed
    for name, src in sums.items():
        per_part = {r["_part"]: r[name] for r in totals if r[name] is not None}
        dtype = placed.select(F.sum(src).alias("t")).schema["t"].dataType.simpleString()
        zero = Decimal(0) if dtype.startswith("decimal") else 0 if dtype == "bigint" else 0.0
        base = _per_part(_offsets(per_part, n, zero), dtype)
        out = out.withColumn(name, base + F.sum(src).over(in_part))
    return out.drop("_part", "_pos")


def exact_percentiles(
    df: DataFrame, columns: Mapping[str, Column], points: Sequence[float], partitions: int | None = None
) -> DataFrame:
    """Exact linear-interpolated percentiles: one row per metric with ``n`` and ``p{point}`` columns.

    Values are counted before the shuffle, so the ordered step handles distinct values, not rows.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value")) for k, c in columns.items()])
    freq = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.metric", "p.value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("metric", "value")
        .agg(F.count("*").alias("cnt"))
    )
    cum = prefix_sums(freq, [F.col("metric"), F.col("value")], {"upto": "cnt"}, partitions)
    # as many rows as metrics asked for: safe to broadcast
    base = cum.groupBy("metric").agg(F.min(F.col("upto") - F.col("cnt")).alias("base"), F.sum("cnt").alias("n"))
    local = cum.join(F.broadcast(base), "metric").withColumn("upto", F.col("upto") - F.col("base"))
    aggs = []
    for p in points:
        at = F.lit(p) * (F.col("n") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(at), F.col("value")))
        high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("value")))
        share = F.first(at - F.floor(at))
        aggs.append((low + (high - low) * share).alias(point_name(p)))
    return local.groupBy("metric").agg(F.first("n").alias("n"), *aggs)


def point_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def running_by_index(
    df: DataFrame, keys: Sequence[str], index: str, sums: Mapping[str, str], chunk: int = 8192
) -> DataFrame:
    """Running totals per key along a dense integer index, in two levels.

    Rows are totalled per chunk of the index, chunk totals are accumulated per key, and each chunk then runs its
    own window. No window partition ever holds more than ``chunk`` rows of a key (or its chunk totals), so a run
    holding most of the batches is still spread out.
    """
    keyed = df.withColumn("_chunk", F.col(index) - F.pmod(F.col(index), F.lit(chunk)))
    group = [*keys, "_chunk"]
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*group).agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    bases = totals.select(*group, *[F.sum(f"_t_{out}").over(before).alias(f"_b_{out}") for out in sums])
    inside = Window.partitionBy(*group).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # null keys are groups like others
    right = bases.withColumnsRenamed({g: f"_r_{g}" for g in group})
    same = F.col("_chunk") == F.col("_r__chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = keyed.join(right, same)
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.coalesce(F.col(f"_b_{name}"), F.lit(0)) + F.sum(src).over(inside)).alias(name)
            for name, src in sums.items()
        ],
    )
    return out
