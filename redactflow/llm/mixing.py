"""A training mix with given shares of overlapping sources, by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Words flow from patterns to source
quotas; a pattern's first pass over its words costs 0, the second 1, the third 2 a word, so repetition is used only
where quotas can't be met otherwise. Costs sit on the supply alone, and convex ones are met by raising every pattern's
supply pass by pass and augmenting the flow each time: the flow after each pass is a cheapest one. The graph has one
node for each pattern and source, never one for each document; it is all the driver sees.

A pattern's flow is whole passes over all its documents plus a rest, which goes to its documents in a seeded order
until it is used up, the last of them in part. The place in that order at which the rest ends is found by refining a
histogram of the seeded hash, so documents are neither sorted nor gathered, and a pattern of any size is spread out.

Words of a null text: 0, and such a document takes 0. A null source is a source of its own, the last one. Repeated
rows are documents of their own. An empty table gives an empty mix. Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactflow.llm.table import boxed, col, without
from redactflow.session import cut_lineage

PASSES = 3
WEIGHTS = (5, 2, 1)
SEED = "mix"
#: The seeded hash has 60 bits; its histogram is refined by 10 bits a level before the rows left are ordered.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 10, 2
WORD = r"[^\x20\x09-\x0D]+"
RESULT = ["size", "source_size", "target", "taken", "flow_pattern"]


def targets(sizes: Sequence[int], weights: Sequence[int], passes: int = PASSES) -> list[float]:
    """Shares of all words by weight; one that would exceed ``passes`` times its source's size stops there, and the
    excess is shared again by weight. In order of size by weight, the sources that stop come first."""
    total, order = sum(sizes), sorted(range(len(sizes)), key=lambda i: (passes * sizes[i] / weights[i], i))
    left, weight, level = total, sum(weights), 0.0
    for i in order:
        level = left / weight
        if passes * sizes[i] >= level * weights[i]:
            break
        left -= passes * sizes[i]
        weight -= weights[i]
    return [float(min(passes * n, level * w)) for n, w in zip(sizes, weights, strict=True)]


def route(supply: Sequence[int], quota: Sequence[int], member: Sequence[Sequence[int]], passes: int = PASSES) -> list[dict[int, int]]:
    """Words that each pattern sends to each source: a maximal flow of least repetition cost."""
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in member]
    spare, need = [0] * len(supply), list(quota)
    feeds: list[list[int]] = [[] for _ in quota]
    for p, m in enumerate(member):
        for s in m:
            feeds[s].append(p)
    for _ in range(passes):
        spare = [a + b for a, b in zip(spare, supply, strict=True)]
        while True:
            # shortest augmenting path from patterns with spare words to a source in need
            seen: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p in range(len(supply)) if spare[p]}
            queue, end = deque(seen), None
            while queue and end is None:
                kind, i = node = queue.popleft()
                if kind == "s":
                    if need[i]:
                        end = node
                    nearby = [("p", p) for p in feeds[i] if flow[p][i]]
                else:
                    nearby = [("s", s) for s in member[i]]
                for other in nearby:
                    if other not in seen:
                        seen[other] = node
                        queue.append(other)
            if end is None:
                break
            path = [end]
            while (back := seen[path[-1]]) is not None:
                path.append(back)
            steps = list(zip(path[1:], path, strict=False))
            amount = min(spare[path[-1][1]], need[end[1]], *[flow[b[1]][a[1]] for a, b in steps if a[0] == "s"])
            for a, b in steps:
                if a[0] == "p":
                    flow[a[1]][b[1]] += amount
                else:
                    flow[b[1]][a[1]] -= amount
            spare[path[-1][1]] -= amount
            need[end[1]] -= amount
    return flow


def _hash(doc_id: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _cutoffs(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(pattern, at, before) of each pattern with a rest: the histogram cell in which the rest ends, and the words of
    all cells in front of it."""
    cut = rest.select("pattern", "rest", F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("before"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        cell = F.shiftright("h", shift)
        inside = rows.select("pattern", "size", cell.alias("cell")).groupBy("pattern", "cell").agg(F.sum("size").alias("n"))
        inside = inside.join(F.broadcast(cut), "pattern").filter(F.shiftright("cell", LEVEL_BITS) == F.col("at"))
        # at most 2**LEVEL_BITS cells of a pattern
        upto = Window.partitionBy("pattern").orderBy("cell")
        ends = inside.withColumn("upto", F.col("before") + F.sum("n").over(upto))
        hit = ends.filter(F.col("upto") > F.col("rest"))
        cut = hit.groupBy("pattern", "rest").agg(
            F.min("cell").alias("at"), F.min_by(F.col("upto") - F.col("n"), "cell").alias("before")
        )
        cut = cut_lineage(cut, "cut")
    return cut


def mix(docs: DataFrame, sources: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target (of its source; of several, the sum), taken and flow_pattern.

    ``sources``: array of the sources a document belongs to; by default the column ``source`` alone.
    """
    of = F.array(col(source)) if sources is None else sources
    keyed = without(docs, RESULT).withColumns(
        {
            "size": F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("bigint"),
            # null and the text "null" are two sources: each name is marked
            "_names": F.array_sort(F.array_distinct(F.transform(of, lambda s: F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("~"))))),
        }
    )
    keyed = keyed.withColumn("flow_pattern", F.to_json("_names")).withColumn("_h", _hash(col(doc_id)))
    thin = keyed.select(col(doc_id).alias("_id"), F.xxhash64(col(text)).alias("_key"), F.col("size"), "flow_pattern", "_names", F.col("_h").alias("h"))
    thin = cut_lineage(thin.withColumn("_row", F.monotonically_increasing_id()), "sizes").withColumnRenamed("flow_pattern", "pattern")
    # one row for each membership pattern: what the sources' metadata allows, not what documents there are
    found = thin.groupBy("pattern").agg(F.first("_names").alias("names"), F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: r["pattern"])
    names = sorted({n for r in found for n in r["names"]})  # "=" sorts before "~", so null is last
    number = {n: i for i, n in enumerate(names)}
    member = [[number[n] for n in r["names"]] for r in found]
    sizes = [0] * len(names)
    for r, m in zip(found, member, strict=True):
        for s in m:
            sizes[s] += r["n"]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    flow = route([r["n"] for r in found], [int(t) for t in goal], member)
    plan = []
    for r, m, f in zip(found, member, flow, strict=True):
        whole, rest = divmod(sum(f.values()), r["n"]) if r["n"] else (0, 0)
        plan.append((r["pattern"], whole, rest, sum(sizes[s] for s in m), float(sum(goal[s] for s in m))))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "pattern string, whole bigint, rest bigint, source_size bigint, target double")

    cut = _cutoffs(thin, plan.filter("rest > 0"))
    # both have a row for each pattern, all of which the driver has already held: documents need not move to meet them
    joined = thin.join(F.broadcast(plan), "pattern").join(F.broadcast(cut.select("pattern", "at", "before")), "pattern", "left")
    cell = F.shiftright("h", HASH_BITS - LEVEL_BITS * LEVELS)
    edge = Window.partitionBy("pattern").orderBy("h", "_id", "_key", "_row").rowsBetween(Window.unboundedPreceding, -1)
    outside = joined.filter(F.col("at").isNull() | (cell != F.col("at")))
    outside = outside.withColumn("extra", F.when(cell < F.col("at"), F.col("size")).otherwise(0))
    # the rows of one cell: about one in 2**(LEVEL_BITS * LEVELS) of a pattern's
    inside = joined.filter(cell == F.col("at"))
    gone = F.col("before") + F.coalesce(F.sum("size").over(edge), F.lit(0))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - gone)))
    taken = outside.unionByName(inside).select(
        "_row", F.col("_id").alias("doc_id"), F.col("_key").alias("text_key"), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), F.col("pattern").alias("flow_pattern"),
    )
    return taken.drop("_row")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of which the mix takes words, with size, source_size, target, taken and flow_pattern.

    Repeated rows of one document come back as one row, which holds what the mix takes of all of them.
    """
    keys = ["doc_id", "text_key", "flow_pattern"]
    part = mix(docs).groupBy(*keys, "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("_n"))
    part = part.filter("taken > 0").withColumnsRenamed({"doc_id": "_id", "text_key": "_key", "flow_pattern": "_pattern"})
    mine = F.to_json(F.array(F.coalesce(F.concat(F.lit("="), col("source").cast("string")), F.lit("~"))))
    rest = boxed(docs, doc_id=F.col("doc_id").cast("bigint"), text_key=F.xxhash64("text"), mine=mine)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("mine") == F.col("_pattern"))
    joined = cut_lineage(rest.join(part, same), "mixed")
    again = joined.filter("_n > 1").dropDuplicates(["_id", "_key", "_pattern"])
    once = joined.filter("_n = 1").unionByName(again).withColumnRenamed("_pattern", "flow_pattern")
    kept = [F.col("_doc").getField(c).alias(c) for c in without(docs, RESULT).columns]
    return once.select(*kept, *RESULT)
