"""Queries over the work queue, manifests, listings and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.functions.times import age_seconds, parse_iso_ts
from redactflow.operators import queue as Q
from redactflow.operators import reports as R
from redactflow.operators import verify as V
from redactflow.plans.registry import query
from redactflow.plans.views import Tables

NOW = "2024-01-15 00:00:00"


def _pending(t: Tables) -> DataFrame:
    orders = t.orders.select(
        F.col("o_custkey").cast("string").alias("stem"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("_name"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("retry_count"),
        "o_orderstatus",
        "o_totalprice",
    )
    raw = orders.filter(F.col("o_orderstatus") != "P").withColumn("path", F.concat(F.lit("raw/"), "_name"))
    held = orders.filter(F.col("o_orderstatus") == "P").withColumn("path", F.concat(F.lit("quarantine/"), "_name"))
    people = t.customer.select(F.col("c_custkey").cast("string").alias("stem"), "c_mktsegment", "c_acctbal")
    return Q.pending_queue(
        raw,
        held,
        terminal=people.filter(F.col("c_mktsegment") == "BUILDING"),
        locked=people.filter(F.col("c_acctbal") < 0),
        rejected=orders.filter(F.col("o_totalprice") > 400000),
    )


@query("SELECT stem, path, retry_count, priority FROM pending", "pending")
def pending_queue(t: Tables) -> DataFrame:
    return _pending(t)


@query(
    """SELECT count(*) AS pending_count, 'full' AS run_type,
    CASE WHEN count(*) >= 5000 THEN 64 WHEN count(*) >= 1000 THEN 48 ELSE 32 END AS batch_size,
    (SELECT string_agg(name, ',' ORDER BY name) FROM (
      SELECT replace(replace(path, 'raw/', ''), 'quarantine/', '') AS name FROM pending ORDER BY path, stem LIMIT 20)) AS first_names
    FROM pending""",
    "pending",
)
def dry_run_plan(t: Tables) -> DataFrame:
    return R.dry_run_plan(_pending(t)).withColumn("first_names", F.array_join("first_names", ","))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS stem FROM orders o
    WHERE sha256(o_orderpriority) = sha256(CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderpriority END)
    AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')"""
)
def skip_set(t: Tables) -> DataFrame:
    """Orders as manifest entries; returned lines as outputs; partly shipped orders as changed sources."""
    stem = F.col("o_orderkey").cast("string").alias("stem")
    manifest = t.orders.select(stem, F.sha2("o_orderpriority", 256).alias("original_hash"))
    seen = F.when(F.col("o_orderstatus") == "P", F.lit("changed")).otherwise(F.col("o_orderpriority"))
    current = t.orders.select(stem, F.upper(F.sha2(seen, 256)).alias("sha256"))
    outputs = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").cast("string").alias("stem"))
    return Q.skip_set(manifest, outputs, current)


_STATUS = """SELECT l.path, lower(l.sha256) AS expected_sha256, lower(c.sha256) AS actual_sha256,
    CASE WHEN c.path IS NULL THEN 'missing' WHEN lower(l.sha256) = lower(c.sha256) THEN 'verified'
    ELSE 'mismatched' END AS status FROM listing l LEFT JOIN copied c ON l.path = c.path"""


@query(_STATUS, "listing copied")
def verify_hashes(t: Tables) -> DataFrame:
    return V.verify_hashes(t.listing, t.copy)


@query(
    f"""SELECT count(*) FILTER (status = 'verified') AS verified_count, count(*) FILTER (status = 'missing') AS missing_count,
    count(*) FILTER (status = 'mismatched') AS mismatched_count,
    count(*) FILTER (status <> 'verified') = 0 AS ok FROM ({_STATUS})""",
    "listing copied",
)
def verify_hashes_summary(t: Tables) -> DataFrame:
    return V.hash_summary(V.verify_hashes(t.listing, t.copy))


@query(
    f"""SELECT count(*) AS source_count, (SELECT count(*) FROM copied) AS target_count,
    count(*) FILTER (status = 'missing') AS missing_count, count(*) FILTER (status = 'mismatched') AS mismatched_count,
    count(*) FILTER (status <> 'verified') = 0 AS ok FROM ({_STATUS})""",
    "listing copied",
)
def verify_export(t: Tables) -> DataFrame:
    return V.verify_export(t.listing, t.copy)


@query(
    """SELECT coalesce(e.path, l.path) AS path,
    CASE WHEN l.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' END AS status
    FROM expected e FULL JOIN listed l ON e.path = l.path WHERE e.path IS NULL OR l.path IS NULL""",
    "expected listed",
)
def compare_listing(t: Tables) -> DataFrame:
    return V.compare_listing(t.expected, t.listed).filter(F.col("status").isNotNull())


@query(
    """, joined AS (SELECT e.path AS e, l.path AS l FROM expected e FULL JOIN listed l ON e.path = l.path)
    SELECT count(e) AS expected_count, count(l) AS listed_count, count(*) FILTER (l IS NULL) AS missing_count,
    count(*) FILTER (e IS NULL) AS extra_count, count(*) FILTER (l IS NULL) = 0 AS ok,
    (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT l FROM joined WHERE e IS NULL ORDER BY l LIMIT 50)) AS extra_shown
    FROM joined""",
    "expected listed",
)
def verify_listing(t: Tables) -> DataFrame:
    return V.verify_listing(t.expected, t.listed).withColumn("extra_shown", F.array_join("extra_shown", ","))


@query(
    """SELECT count(*) FILTER (c.path IS NOT NULL AND lower(l.sha256) = lower(c.sha256)) AS unchanged_count,
    count(*) FILTER (c.path IS NOT NULL AND lower(l.sha256) <> lower(c.sha256)) AS changed_count,
    0::BIGINT AS added_count, count(*) FILTER (c.path IS NULL) AS removed_count, FALSE AS originals_untouched
    FROM listing l LEFT JOIN copied c ON l.path = c.path""",
    "listing copied",
)
def source_unchanged(t: Tables) -> DataFrame:
    return V.source_unchanged(t.listing, t.copy)


@query(
    """, rec AS (SELECT CAST(doc_id AS VARCHAR) AS stem, quality, toxic FROM labels),
    joined AS (SELECT i.stem, r.stem IS NOT NULL AS audited, quality, toxic FROM items i LEFT JOIN rec r ON i.stem = r.stem)
    SELECT stem, 'missing_audit' AS error FROM joined WHERE NOT audited
    UNION ALL SELECT stem, 'missing_hashes' FROM joined WHERE audited AND quality = 0
    UNION ALL SELECT stem, 'output_hash_mismatch' FROM joined WHERE audited AND quality = 1 AND toxic = 1
    UNION ALL SELECT stem, 'missing_final_decision' FROM joined WHERE audited AND toxic = 1
    UNION ALL SELECT stem, 'missing_retry_count' FROM joined WHERE audited AND quality = 0 AND toxic = 1
    UNION ALL SELECT stem, 'unexpected_strip_method' FROM joined WHERE audited AND quality = toxic""",
    "items",
)
def audit_errors(t: Tables) -> DataFrame:
    """Labels as audit records with fields left out according to the label."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    audit = t.labels.join(t.items.select("doc_id", "sha256"), "doc_id").select(
        F.col("doc_id").cast("string").alias("stem"),
        F.col("sha256").alias("source_sha256"),
        F.when(good, F.when(toxic, F.lit("00")).otherwise(F.col("sha256"))).alias("output_sha256"),
        F.when(~toxic, F.lit("pass")).alias("final_decision"),
        F.when(~(~good & toxic), F.lit(0)).alias("retry_count"),
        F.when(F.col("quality") != F.col("toxic"), F.lit("chunks_dropped")).otherwise(F.lit("none")).alias("strip_method"),
    )
    return V.audit_errors(t.items, audit)


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS stem, coalesce(max(score), 0.0) AS max_score, count(d.stem) AS box_count,
    coalesce(string_agg(text, '' ORDER BY text), '') AS texts, round(coalesce(sum(score), 0), 6) AS score_sum
    FROM orders o LEFT JOIN detections d ON d.stem = CAST(o_orderkey AS VARCHAR) GROUP BY o_orderkey""",
    "detections",
)
def attach_detections(t: Tables) -> DataFrame:
    items = t.orders.select(F.col("o_orderkey").cast("string").alias("stem"))
    rows = V.attach_detections(items, t.detections)
    scores = F.transform("boxes", lambda b: b.getField("score"))
    return rows.select(
        "stem",
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("max_score"),
        F.size("boxes").alias("box_count"),
        F.array_join(F.array_sort(F.transform("boxes", lambda b: b.getField("text"))), "").alias("texts"),
        F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s).alias("score_sum"),
    )


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS stem, round(coalesce(max(score), 0.0), 6) AS max_score, count(d.stem) AS box_count
    FROM orders o LEFT JOIN detections d ON d.stem = CAST(o_orderkey AS VARCHAR) GROUP BY o_orderkey""",
    "detections",
)
def box_stats(t: Tables) -> DataFrame:
    return V.box_stats(t.orders.select(F.col("o_orderkey").cast("string").alias("stem")), t.detections)


def _locks(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.locks, t.locks.filter("done").select("batch_index")


@query(
    f"""SELECT DISTINCT stem FROM locks WHERE NOT done AND epoch(TIMESTAMP '{NOW}') - epoch(started) <= 3600""", "locks"
)
def active_locks(t: Tables) -> DataFrame:
    return Q.active_locks(*_locks(t), F.to_timestamp(F.lit(NOW)))


@query(
    f"""SELECT batch_index FROM locks WHERE NOT done AND epoch(TIMESTAMP '{NOW}') - epoch(started) > 3600""", "locks"
)
def resumable_batches(t: Tables) -> DataFrame:
    return Q.resumable_batches(*_locks(t), F.to_timestamp(F.lit(NOW))).select("batch_index")


@query(
    f"""SELECT batch_index, strftime(started, '%Y-%m-%d %H:%M:%S') AS started,
    CAST(epoch(TIMESTAMP '{NOW}') - epoch(started) AS BIGINT) AS age FROM locks""",
    "locks",
)
def lock_ages(t: Tables) -> DataFrame:
    started = parse_iso_ts(F.col("started_at"))
    return t.locks.select(
        "batch_index",
        F.date_format(started, "yyyy-MM-dd HH:mm:ss").alias("started"),
        age_seconds(started, F.to_timestamp(F.lit(NOW))).alias("age"),
    )


@query(
    """SELECT stem, path, priority FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY priority, path) AS n
    FROM candidates) WHERE n = 1""",
    "candidates",
)
def first_per_stem(t: Tables) -> DataFrame:
    return Q.first_per_stem(t.candidates)


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank,
    CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 64 AS BIGINT) AS batch_index FROM orders"""
)
def assign_batches(t: Tables) -> DataFrame:
    return Q.assign_batches(
        t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 64
    ).select("o_orderkey", "rank", "batch_index")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def pilot_cap(t: Tables) -> DataFrame:
    slim = t.orders.select("o_orderkey", "o_orderdate")
    return Q.pilot_cap(slim, 500, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey")


@query(
    """SELECT l_orderkey, l_linenumber, l_discount FROM lineitem
    ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50"""
)
def sample_problems(t: Tables) -> DataFrame:
    order = [F.col("l_discount").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]]
    slim = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_partkey", "l_suppkey")
    return Q.sample_problems(slim, 50, order).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT path FROM listed EXCEPT SELECT path FROM expected", "expected listed")
def new_items(t: Tables) -> DataFrame:
    return V.new_items(t.expected, t.listed)


@query("SELECT path FROM expected EXCEPT SELECT path FROM listed", "expected listed")
def failed_items(t: Tables) -> DataFrame:
    return V.failed_items(t.expected, t.listed)


@query(
    """, old AS (SELECT CAST(c_custkey AS VARCHAR) AS stem, c_name AS original_hash, c_mktsegment AS output_hash
      FROM customer WHERE c_acctbal > 0),
    new AS (SELECT CAST(o_custkey AS VARCHAR) AS stem, arg_max(o_orderpriority, o_orderkey) AS original_hash
      FROM orders GROUP BY o_custkey)
    SELECT coalesce(o.stem, n.stem) AS stem, coalesce(n.original_hash, o.original_hash) AS original_hash, o.output_hash
    FROM old o FULL JOIN new n ON o.stem = n.stem""",
    "candidates",
)
def merge_manifest(t: Tables) -> DataFrame:
    old = t.customer.filter(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").cast("string").alias("stem"),
        F.col("c_name").alias("original_hash"),
        F.col("c_mktsegment").alias("output_hash"),
    )
    entries = t.orders.select(
        F.col("o_custkey").cast("string").alias("stem"), F.col("o_orderpriority").alias("original_hash"), "o_orderkey"
    )
    return V.merge_manifest(old, V.last_entry_per_stem(entries, [F.col("o_orderkey")]))


@query(
    """SELECT l_orderkey AS batch_index, CAST(l_partkey AS VARCHAR) AS stem FROM lineitem
    EXCEPT SELECT l_orderkey, CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F'"""
)
def unfinished_items(t: Tables) -> DataFrame:
    """Lines as batch items; returned ones are marked completed, shipped ones have an output."""
    line = t.lineitem.select(
        F.col("l_orderkey").alias("batch_index"), F.col("l_partkey").cast("string").alias("stem"),
        "l_returnflag", "l_linestatus",
    )
    items = line.select("batch_index", "stem").distinct()
    completed = line.filter(F.col("l_returnflag") == "R")
    return Q.unfinished_items(items, completed, line.filter(F.col("l_linestatus") == "F"))


@query(
    """SELECT l_orderkey AS batch_index, CAST(l_partkey AS VARCHAR) AS stem FROM lineitem WHERE l_returnflag = 'R'
    UNION SELECT l_orderkey, CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'A'"""
)
def merge_completed(t: Tables) -> DataFrame:
    line = t.lineitem.select(
        F.col("l_orderkey").alias("batch_index"), F.col("l_partkey").cast("string").alias("stem"), "l_returnflag"
    )
    return Q.merge_completed(line.filter(F.col("l_returnflag") == "R"), line.filter(F.col("l_returnflag") == "A"))


@query(
    """SELECT batch_index, len(list_distinct(list_concat([stem], [stem, 'extra']))) AS completed, 0::BIGINT AS open
    FROM locks""",
    "locks",
)
def lock_progress(t: Tables) -> DataFrame:
    locks = t.locks.withColumn("completed_stems", F.col("stems"))
    finished = F.array_append("stems", F.lit("extra"))
    out = Q.lock_progress(locks, finished)
    return out.select("batch_index", F.size("completed_stems").alias("completed"), F.size("open_stems").alias("open"))


@query("SELECT count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM listing", "listing")
def manifest_totals(t: Tables) -> DataFrame:
    return R.manifest_totals(t.listing)


@query("SELECT path, sha256, size_bytes FROM listing", "listing")
def manifest_files(t: Tables) -> DataFrame:
    return R.manifest_files(t.listing)


@query(
    "SELECT count(*) AS entries, strftime(max(o_orderdate), '%Y-%m-%d') AS updated_at, count(*) > 0 AS \"exists\" FROM orders"
)
def manifest_summary(t: Tables) -> DataFrame:
    out = R.manifest_summary(t.orders, "o_orderdate")
    return out.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


@query("SELECT o_orderstatus AS location, count(*) AS items FROM orders GROUP BY 1")
def location_counts(t: Tables) -> DataFrame:
    return R.location_counts(t.orders.select(F.col("o_orderstatus").alias("location")))
