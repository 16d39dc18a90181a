"""Checksums, listings and audit records compared by join. None of these reads file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactflow.functions.names import normalize_path
from redactflow.operators.joins import join_small
from redactflow.operators.order import prefix_sums
from redactflow.schemas import BOXES_DDL
from redactflow.session import cut_lineage


def _one_per_path(df: DataFrame, side: str) -> DataFrame:
    """One row per normalised path. Repeated paths collapse before the shuffle; if their hashes disagree,
    lowest and highest differ and the path cannot verify."""
    digest = F.lower("sha256")
    return df.groupBy(normalize_path(F.col("path")).alias("path")).agg(
        F.min(digest).alias(f"{side}_sha256"), F.max(digest).alias(f"_{side}_max"), F.lit(True).alias(f"_in_{side}")
    )


def _same_hash() -> Column:
    return (
        (F.col("expected_sha256") == F.col("actual_sha256"))
        & (F.col("_expected_max") == F.col("expected_sha256"))
        & (F.col("_actual_max") == F.col("actual_sha256"))
    )


def verify_hashes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path, expected_sha256, actual_sha256, status`` with status missing, mismatched or verified."""
    joined = _one_per_path(expected, "expected").join(_one_per_path(actual, "actual"), "path", "left")
    status = (
        F.when(F.col("_in_actual").isNull(), F.lit("missing"))
        .when(F.coalesce(_same_hash(), F.lit(False)), F.lit("verified"))
        .otherwise(F.lit("mismatched"))
    )
    return joined.select("path", "expected_sha256", "actual_sha256", status.alias("status"))


def hash_summary(verified: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("verified", "missing", "mismatched")]
    out = verified.agg(*counts)
    return out.withColumn("ok", (F.col("missing_count") == 0) & (F.col("mismatched_count") == 0))


def verify_export(source: DataFrame, target: DataFrame) -> DataFrame:
    """One-way source to target: one row with the counts of both sides, missing and mismatched."""
    both = _one_per_path(source, "expected").join(_one_per_path(target, "actual"), "path", "full")
    here, there = F.col("_in_expected").isNotNull(), F.col("_in_actual").isNotNull()
    same = F.coalesce(_same_hash(), F.lit(False))
    out = both.agg(
        F.count_if(here).alias("source_count"),
        F.count_if(there).alias("target_count"),
        F.count_if(here & ~there).alias("missing_count"),
        F.count_if(here & there & ~same).alias("mismatched_count"),
    )
    return out.withColumn("ok", (F.col("missing_count") == 0) & (F.col("mismatched_count") == 0))


def compare_listing(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, status`` for every path on only one side: missing (not listed) or extra (not in the manifest)."""
    expected = manifest.select("path").distinct().withColumn("_e", F.lit(True))
    listed = listing.select("path").distinct().withColumn("_l", F.lit(True))
    both = expected.join(listed, "path", "full")
    status = F.when(F.col("_l").isNull(), F.lit("missing")).when(F.col("_e").isNull(), F.lit("extra"))
    return both.select("path", status.alias("status"))


def verify_listing(manifest: DataFrame, listing: DataFrame, shown: int = 50) -> DataFrame:
    """One row: counts, ``ok`` (nothing missing) and the first ``shown`` extra names."""
    compared = compare_listing(manifest, listing)
    extra = compared.filter(F.col("status") == "extra").orderBy("path").limit(shown)
    names = extra.agg(F.sort_array(F.collect_list("path")).alias("names"))
    status = F.coalesce("status", F.lit("both"))
    out = compared.agg(
        F.count_if(status != "extra").alias("expected_count"),
        F.count_if(status != "missing").alias("listed_count"),
        F.count_if(status == "missing").alias("missing_count"),
        F.count_if(status == "extra").alias("extra_count"),
    )
    return out.withColumns({"ok": F.col("missing_count") == 0, "extra_shown": names.scalar()})


def source_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per path: unchanged, changed, added or removed."""
    old = _one_per_path(before, "expected")
    new = _one_per_path(after, "actual")
    both = old.join(new, "path", "full")
    same = F.col("expected_sha256").eqNullSafe(F.col("actual_sha256")) & F.col("_expected_max").eqNullSafe(
        F.col("_actual_max")
    )
    status = (
        F.when(F.col("_in_expected").isNull(), F.lit("added"))
        .when(F.col("_in_actual").isNull(), F.lit("removed"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return both.select("path", status.alias("status"))


def source_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: counts per status, and whether every original is still byte-identical."""
    states = ("unchanged", "changed", "added", "removed")
    out = source_changes(before, after).agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in states]
    )
    return out.withColumn("originals_untouched", (F.col("changed_count") == 0) & (F.col("removed_count") == 0))


STRIP_METHODS = ("segments_dropped", "chunks_dropped", "reencoded")


def audit_errors(outputs: DataFrame, audit: DataFrame, strip_methods: tuple[str, ...] = STRIP_METHODS) -> DataFrame:
    """One row per problem ``(stem, error)`` of each output: no audit, hashes, decision, retry count, strip method.

    ``outputs``: stem, sha256. ``audit``: stem, source_sha256, output_sha256, final_decision, retry_count, strip_method.
    """
    record = audit.select(
        "stem", "source_sha256", "output_sha256", "final_decision", "retry_count", "strip_method",
        F.lit(True).alias("_audited"),
    )
    joined = outputs.select("stem", "sha256").join(record, "stem", "left")
    there = F.col("_audited").isNotNull()
    no_hash = F.col("source_sha256").isNull() | F.col("output_sha256").isNull()
    differs = F.lower("output_sha256") != F.lower("sha256")
    undecided = ~F.coalesce(F.col("final_decision").isin("pass", "fail"), F.lit(False))
    odd_strip = ~F.coalesce(F.col("strip_method").isin(*strip_methods), F.lit(False))
    errors = F.array(
        F.when(~there, F.lit("missing_audit")),
        F.when(there & no_hash, F.lit("missing_hashes")),
        F.when(there & differs, F.lit("output_hash_mismatch")),
        F.when(there & undecided, F.lit("missing_final_decision")),
        F.when(there & F.col("retry_count").isNull(), F.lit("missing_retry_count")),
        F.when(there & odd_strip, F.lit("unexpected_strip_method")),
    )
    return joined.select("stem", F.explode(F.array_compact(errors)).alias("error"))


def audit_columns(audit: DataFrame) -> DataFrame:
    """The fields ``audit_errors`` needs, from the nested audit record."""
    return audit.select(
        "stem",
        F.col("integrity_hashes.source_sha256").alias("source_sha256"),
        F.col("integrity_hashes.output_sha256").alias("output_sha256"),
        F.col("qa.final_decision").alias("final_decision"),
        "retry_count",
        F.col("actions.metadata_strip_method").alias("strip_method"),
    )


def new_items(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Paths in ``after`` that were not in ``before``."""
    return after.select(key).distinct().join(before.select(key).distinct(), key, "left_anti")


def failed_items(listed: DataFrame, transferred: DataFrame, key: str = "path") -> DataFrame:
    """Paths that were to be transferred and did not arrive."""
    return new_items(transferred, listed, key)


def last_entry_per_stem(entries: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("stem").orderBy(*[c.desc() for c in order])
    return entries.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by stem: fields of the new entry win, fields it leaves null keep their old value."""
    names = [c for c in old.columns if c != "stem"]
    fresh = new.select("stem", *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_n_{c}") for c in names])
    joined = old.join(fresh, "stem", "full")
    return joined.select("stem", *[F.coalesce(f"_n_{c}", c).alias(c) for c in names])


#: Distinct boxes of items with many that one task puts in order.
PART_ROWS = 500_000


def attach_detections(items: DataFrame, detections: DataFrame, per_row: int = 4096) -> DataFrame:
    """Items with their boxes as ``boxes array``, empty when there is none, in rows of at most ``per_row`` boxes.

    An item has ``parts`` rows, numbered ``part`` from 0: one, unless it has more boxes than ``per_row``; all but the
    last are full. Counts, added up before the shuffle, tell which items have more. The others, nearly all, are grouped in
    one shuffle of boxes. Equal boxes of items with more are counted, and the counts alone are put in order and summed up,
    in tasks of at most ``PART_ROWS`` distinct boxes; a row of such an item is a list of boxes and how often each comes
    until the item has been joined, so no row, task or shuffle grows with what an item repeats.
    """
    spark = detections.sparkSession
    boxes = F.sort_array(F.collect_list(F.struct("polygon", "text", "score"))).alias("boxes")
    # a box of no item can't be attached
    found = detections.filter(F.col("stem").isNotNull()).select("stem", "polygon", "text", "score")
    counts = found.groupBy("stem").agg(F.count("*").alias("_n")).filter(F.col("_n") > per_row)
    many = cut_lineage(counts.select("stem", F.ceil(F.col("_n") / per_row).cast("int").alias("parts")), "many")
    some_many = not many.isEmpty()
    few = found.join(many, "stem", "left_anti") if some_many else found
    grouped = few.groupBy("stem").agg(boxes).withColumns({"part": F.lit(0), "parts": F.lit(1)})
    plain = items.join(many, "stem", "left_anti") if some_many else items
    joined = plain.join(grouped, "stem", "left")
    if some_many:
        box = ["stem", "text", "score", "polygon"]
        equal = cut_lineage(found.join(many, "stem", "left_semi").groupBy(*box).agg(F.count("*").alias("_n")), "equal")
        order = [F.col("stem"), F.col("text"), F.col("score"), F.xxhash64("polygon"), F.col("polygon")]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-equal.count() // PART_ROWS))
        summed = cut_lineage(prefix_sums(equal, order, {"_upto": "_n"}, parts), "summed")
        base = summed.groupBy("stem").agg(F.min(F.col("_upto") - F.col("_n")).alias("_base")).join(many, "stem")
        placed = join_small(summed, base, ["stem"]).withColumns(
            {"_first": F.col("_upto") - F.col("_n") - F.col("_base"), "_last": F.col("_upto") - F.col("_base") - 1}
        )
        row = placed.withColumn("part", F.explode(F.sequence(F.expr(f"_first div {per_row}"), F.expr(f"_last div {per_row}"))))
        times = F.least("_last", (F.col("part") + 1) * per_row - 1) - F.greatest("_first", F.col("part") * per_row) + 1
        one = F.struct(F.struct("polygon", "text", "score").alias("box"), times.cast("int").alias("times"))
        rows = row.groupBy("stem", F.col("part").cast("int").alias("part")).agg(F.sort_array(F.collect_list(one)).alias("_rows"), F.first("parts").alias("parts"))
        hot = items.join(many, "stem", "left_semi").withColumnRenamed("stem", "_stem")
        small = cut_lineage(hot, "hot")
        attached = rows.join(small, F.col("stem") == F.col("_stem")).drop("_stem")
        repeated = F.flatten(F.transform("_rows", lambda r: F.array_repeat(r["box"], r["times"])))
        joined = joined.unionByName(attached.withColumn("boxes", repeated).drop("_rows"))
    filled = {"boxes": F.coalesce("boxes", F.array().cast(BOXES_DDL)), "part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(1))}
    return joined.withColumns(filled).select(*items.columns, "boxes", "part", "parts")


def box_stats(items: DataFrame, detections: DataFrame) -> DataFrame:
    """Highest score and box count per item without building arrays; partial sums before the shuffle."""
    stats = detections.groupBy("stem").agg(F.max("score").alias("max_score"), F.count("*").alias("box_count"))
    joined = items.select("stem").join(stats, "stem", "left")
    return joined.select(
        "stem",
        F.greatest(F.lit(0.0), F.coalesce("max_score", F.lit(0.0))).alias("max_score"),
        F.coalesce("box_count", F.lit(0)).cast("bigint").alias("box_count"),
    )
