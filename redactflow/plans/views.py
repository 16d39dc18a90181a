"""Inputs of the registered queries: the given tables, and views derived from them that stand in for listings,
manifests, attempts, locks and QA scores."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.functions.vectors import cosine_distance
from redactflow.operators.route import number_attempts
from redactflow.session import spread


class Tables:
    """Lazy access to one folder of tables and their views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, table: str, *columns: str) -> DataFrame:
        """Columns of a text table, dealt out over the cores when the table is small."""
        return spread(getattr(self, table).select(*columns))

    @cached_property
    def items(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").cast("string").alias("stem"),
            F.col("n_chars").alias("length"),
            F.sha2("text", 256).alias("sha256"),
            "source",
            "doc_id",
        )

    @cached_property
    def listing(self) -> DataFrame:
        """Item hashes by path."""
        return self.items.select(F.col("stem").alias("path"), "sha256", F.col("length").alias("size_bytes"))

    @cached_property
    def copy(self) -> DataFrame:
        """A copy of the listing in which one source was lost, one was changed and two have hashes in upper case."""
        source, digest = F.col("source"), F.col("sha256")
        altered = F.when(source == "src5", F.reverse(digest)).when(source.isin("src1", "src9"), F.upper(digest))
        altered = altered.otherwise(digest)
        return self.items.filter(source != "src3").select(
            F.col("stem").alias("path"), altered.alias("sha256"), F.col("length").alias("size_bytes")
        )

    @cached_property
    def files(self) -> DataFrame:
        k = F.col("doc_id")
        prefix = F.get(F.array(*[F.lit(p) for p in ("orig_", "thumb_", "test_", "perf_", "", "")]), (k % 6).cast("int"))
        ext = F.get(F.array(*[F.lit(e) for e in (".jpg", ".PNG", ".mp4", ".json", ".tiff")]), (k % 5).cast("int"))
        roots = ("final_clean", "logs/batch_summaries", "temp_processed")
        root = F.get(F.array(*[F.lit(r) for r in roots]), (k % 3).cast("int"))
        return self.documents.select(
            root.alias("root"),
            F.concat(prefix, k.cast("string"), ext).alias("rel_path"),
            F.lit(False).alias("is_dir"),
            F.col("n_chars").alias("size_bytes"),
            "source",
        )

    @cached_property
    def qa(self) -> DataFrame:
        joined = self.documents.select("doc_id", "source").join(self.labels, "doc_id", "left")
        return joined.select(
            "doc_id",
            "source",
            F.when(F.col("toxic") == 1, 0.95).when(F.col("toxic") == 0, 0.10).alias("max_score"),
            F.col("toxic").alias("count"),
            F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.6).alias("ssim"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Each vector with the next one; every tenth with itself."""
        e = self.embeddings
        partner = F.when(F.col("vec_id") % 10 == 0, F.col("vec_id")).otherwise(F.col("vec_id") + 1)
        left = e.select("vec_id", F.col("embedding").alias("a"), partner.alias("other_id"))
        return left.join(e.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("b")), "other_id")

    @cached_property
    def distances(self) -> DataFrame:
        return self.pairs.select("vec_id", cosine_distance(F.col("a"), F.col("b")).alias("distance"))

    @cached_property
    def detections(self) -> DataFrame:
        corner = F.col("l_linenumber").cast("float")
        point = F.array(corner, corner)
        return self.lineitem.select(
            F.col("l_orderkey").cast("string").alias("stem"),
            F.lit("text").alias("kind"),
            F.array(point, point, point, point).alias("polygon"),
            F.col("l_returnflag").alias("text"),
            (F.lit(0.80) + F.col("l_discount")).alias("score"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Events as routed items of a run."""
        kind = F.col("event_type")
        batch = F.expr("event_id div 500")
        outcome = F.when(kind == "signup", "quarantine").when(kind == "error", "manual_review").otherwise("pass")
        return self.events.select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            "value",
            batch.alias("batch_index"),
            F.concat(F.lit("run-"), (batch % 2).cast("string")).alias("run_id"),
            outcome.alias("outcome"),
            F.when(outcome == "pass", "final_clean").otherwise(outcome).alias("route"),
        )

    @cached_property
    def batches(self) -> DataFrame:
        factor = F.when(F.col("batch_index") % 7 == 0, 3.0).otherwise(1.0)
        return (
            self.outcomes.groupBy("run_id", "batch_index")
            .agg(
                F.count("*").alias("images"),
                F.sum("value").alias("_value"),
                *[
                    F.count_if(F.col("outcome") == o).alias(o)
                    for o in ("pass", "quarantine", "manual_review")
                ],
            )
            .withColumn("elapsed_sec", F.col("_value") / 100 * factor)
            .drop("_value")
        )

    @cached_property
    def attempts(self) -> DataFrame:
        log = self.events.select(
            F.col("user_id").cast("string").alias("stem"),
            "ts",
            "event_id",
            F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("decision"),
        )
        return number_attempts(log, "stem", [F.col("ts"), F.col("event_id")])

    @cached_property
    def hard_attempts(self) -> DataFrame:
        """Like ``attempts``, but only a purchase passes, so many stems use up their budget."""
        log = self.events.select(
            F.col("user_id").cast("string").alias("stem"),
            "ts",
            "event_id",
            F.when(F.col("event_type") == "purchase", "pass").otherwise("fail").alias("decision"),
        )
        return number_attempts(log, "stem", [F.col("ts"), F.col("event_id")])

    @cached_property
    def locks(self) -> DataFrame:
        day = F.date_format(F.col("ts"), "yyyyMMdd").cast("bigint")
        return (
            self.events.groupBy("user_id", day.alias("day"))
            .agg(F.min("ts").alias("_start"), F.count_if(F.col("event_type") == "purchase").alias("_done"))
            .select(
                (F.col("user_id") * 100000000 + F.col("day")).alias("batch_index"),
                F.array(F.col("user_id").cast("string")).alias("stems"),
                F.date_format("_start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"),
                (F.col("_done") > 0).alias("done"),
            )
        )

    @cached_property
    def expected(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").cast("string").alias("path"))

    @cached_property
    def listed(self) -> DataFrame:
        k = F.col("l_orderkey")
        return self.lineitem.select(
            F.when(k % 50 == 0, k + 1_000_000).otherwise(k).cast("string").alias("path")
        ).distinct()

    @cached_property
    def candidates(self) -> DataFrame:
        return self.customer.select(
            F.col("c_nationkey").cast("string").alias("stem"),
            (F.col("c_custkey") % 2).alias("priority"),
            F.col("c_name").alias("path"),
        )
