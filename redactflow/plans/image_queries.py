"""Queries over rasters that Spark derives from the embeddings table: one 64x64 image per vector.

Each of the 64 values becomes an 8x8 block. The block numbered by the row's label is pure white ("text") and the
block twenty further on has the value 250 ("face"), so two simple detectors find exactly one of each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS
from redactflow.image import ops
from redactflow.image.png import insert_text_chunk
from redactflow.operators.qa import pair_original_output
from redactflow.operators.route import master_row
from redactflow.operators.screen import image_dims
from redactflow.operators.verify import audit_errors
from redactflow.plans.registry import query
from redactflow.plans.views import Tables
from redactflow.plans.waves import run_waves
from redactflow.schemas import BOXES_DDL
from redactflow.session import cut_lineage, scratch_path, spread

SIDE, BLOCK = 64, 8
TEXT_LEVEL, FACE_LEVEL = 255, 250


def rasters(t: Tables) -> DataFrame:
    """``stem, vec_id, label, height, width, data``, built JVM-side."""

    def level(value: Column, at: Column) -> Column:
        plain = F.pmod(F.floor(F.abs(value) * 1000), F.lit(200))
        return F.when(at == F.col("label"), TEXT_LEVEL).when(at == F.col("label") + 20, FACE_LEVEL).otherwise(plain)

    blocks = F.transform("embedding", lambda v, i: F.repeat(F.lpad(F.hex(level(v, i).cast("bigint")), 2, "0"), BLOCK * 3))
    lines = [
        F.repeat(F.array_join(F.slice("_blocks", 1 + BLOCK * r, BLOCK), ""), BLOCK) for r in range(SIDE // BLOCK)
    ]
    return spread(t.embeddings).withColumn("_blocks", blocks).select(
        F.concat(F.lit("vec-"), F.col("vec_id")).alias("stem"),
        "vec_id",
        "label",
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        F.unhex(F.concat(*lines)).alias("data"),
    )


def at_level(rgb: np.ndarray, level: int) -> np.ndarray:
    """Pixels of one gray level."""
    red, green, blue = (rgb[..., i] == level for i in range(3))
    return red & green & blue


def level_detector(wanted: int, margin: int = 0) -> Callable[[], ops.Detector]:
    """Box around all pixels of one gray level, widened by ``margin``."""

    def make() -> ops.Detector:
        def detect(rgb: np.ndarray) -> list[dict]:
            ys, xs = np.nonzero(at_level(rgb, wanted))
            if not len(xs):
                return []
            x0, x1, y0, y1 = xs.min() - margin, xs.max() + margin, ys.min() - margin, ys.max() + margin
            return [{"polygon": [[x0, y0], [x1, y0], [x1, y1], [x0, y1]], "text": "block", "score": 0.95}]

        return detect

    return make


def _corner_boxes(t: Tables) -> DataFrame:
    """Rasters with one box from the corner, sized by label."""
    x, y = (F.col("label") + 3).cast("float"), (F.col("label") + 5).cast("float")
    zero = F.lit(0.0).cast("float")
    polygon = F.array(F.array(zero, zero), F.array(x, zero), F.array(x, y), F.array(zero, y))
    box = F.struct(polygon.alias("polygon"), F.lit("corner").alias("text"), F.lit(0.9).alias("score"))
    return rasters(t).withColumn("boxes", F.array(box).cast(BOXES_DDL))


_STEM = "'vec-' || CAST(vec_id AS VARCHAR)"


@query(f"SELECT {_STEM} AS stem, (label + 4) * (label + 6) AS masked_pixels FROM embeddings")
def boxes_to_mask(t: Tables) -> DataFrame:
    return ops.masks(_corner_boxes(t), dilate=0).select("stem", "masked_pixels")


def _rows_below(data: Column, row: int) -> Column:
    return F.substring(data, row * SIDE * 3 + 1, SIDE * SIDE * 3)


@query(
    f"SELECT {_STEM} AS stem, 1::BIGINT AS regions_blurred, TRUE AS replacement_success, TRUE AS rest_unchanged FROM embeddings"
)
def blur_boxes(t: Tables) -> DataFrame:
    start = _corner_boxes(t)
    done = ops.blur(start).withColumnRenamed("data", "blurred")
    both = done.join(start.select("stem", "data"), "stem")
    same = _rows_below(F.col("blurred"), 15) == _rows_below(F.col("data"), 15)
    return both.select("stem", "regions_blurred", "replacement_success", same.alias("rest_unchanged"))


def _redacted(t: Tables, mode: str) -> DataFrame:
    start = _corner_boxes(t)
    done = ops.redact(start, mode, dilate=2).withColumnRenamed("data", "redacted")
    return done.join(start.select("stem", "data"), "stem")


@query(f"SELECT {_STEM} AS stem, 'ok' AS status, TRUE AS rest_unchanged FROM embeddings")
def redact_regions(t: Tables) -> DataFrame:
    same = _rows_below(F.col("redacted"), 17) == _rows_below(F.col("data"), 17)
    return _redacted(t, "diffuse").select("stem", "status", same.alias("rest_unchanged"))


@query(f"SELECT {_STEM} AS stem, repeat('000000', label + 6) AS first_row, TRUE AS row_end_unchanged FROM embeddings")
def redact_regions_solid(t: Tables) -> DataFrame:
    """The first row is black over the box and its two dilated columns, and unchanged after them."""
    length = (F.col("label") + 6) * 3
    both = _redacted(t, "solid").join(rasters(t).select("stem", "label"), "stem")
    end = F.lit(SIDE * 3) - length
    same = F.substring("redacted", length + 1, end) == F.substring("data", length + 1, end)
    return both.select(
        "stem", F.hex(F.substring("redacted", F.lit(1), length)).alias("first_row"), same.alias("row_end_unchanged")
    )


@query(f"SELECT {_STEM} AS stem, 'chunks_dropped' AS method, TRUE AS had_note, TRUE AS same_as_plain FROM embeddings")
def strip_metadata(t: Tables) -> DataFrame:
    """PNG files with a text note put in: after stripping they equal the files without it."""
    plain = ops.encode(rasters(t))

    def note(batches):
        for frame in batches:
            frame["noted"] = [insert_text_chunk(c, "Comment", s) for c, s in zip(frame["content"], frame["stem"])]
            yield frame

    noted = plain.mapInPandas(note, "stem string, content binary, noted binary")
    stripped = ops.strip_all_metadata(noted.select("stem", F.col("noted").alias("content")))
    both = stripped.withColumnRenamed("content", "clean").join(noted, "stem")
    return both.select(
        "stem",
        "method",
        (F.length("noted") > F.length("content")).alias("had_note"),
        (F.col("clean") == F.col("content")).alias("same_as_plain"),
    )


@query(f"SELECT {_STEM} AS stem, 64::BIGINT AS width, 64::BIGINT AS height, 4096::BIGINT AS pixels FROM embeddings")
def encode_png(t: Tables) -> DataFrame:
    return image_dims(ops.encode(rasters(t))).select("stem", "width", "height", "pixels")


@query(
    f"""SELECT {_STEM} AS stem, 1::BIGINT AS boxes, (label % 8) * 8::DOUBLE AS x0, (label // 8) * 8::DOUBLE AS y0,
    (label % 8) * 8 + 7::DOUBLE AS x1, (label // 8) * 8 + 7::DOUBLE AS y1, 0.95::DOUBLE AS score FROM embeddings"""
)
def apply_model(t: Tables) -> DataFrame:
    found = ops.apply_model(rasters(t), level_detector(TEXT_LEVEL))
    first = F.get("boxes", F.lit(0))
    corner = lambda i, j: first.getField("polygon")[i][j].cast("double")
    return found.select(
        "stem", F.size("boxes").alias("boxes"), corner(0, 0).alias("x0"), corner(0, 1).alias("y0"),
        corner(2, 0).alias("x1"), corner(2, 1).alias("y1"), first.getField("score").alias("score"),
    )


@query(f"SELECT {_STEM} AS stem, 1.0::DOUBLE AS ssim, 0.0::DOUBLE AS edge_ratio FROM embeddings")
def image_qa_unchanged(t: Tables) -> DataFrame:
    start = rasters(t).select("stem", "height", "width", "data")
    pairs = pair_original_output(start.withColumn("boxes", F.array().cast(BOXES_DDL)), start)
    return ops.image_qa(pairs)


def _anonymized(t: Tables) -> DataFrame:
    return ops.anonymize_images(rasters(t), level_detector(FACE_LEVEL, 4), level_detector(TEXT_LEVEL))


@query(
    f"""SELECT {_STEM} AS stem, 1::BIGINT AS input_face_count, 0::BIGINT AS post_face_count, 1::BIGINT AS text_count,
    0::BIGINT AS output_count, 1::BIGINT AS text_regions_inpainted, 'completed' AS processing_status, FALSE AS detection_fail
    FROM embeddings"""
)
def anonymize_images_counts(t: Tables) -> DataFrame:
    return _anonymized(t).select(
        "stem", "input_face_count", "post_face_count", "text_count", "output_count", "text_regions_inpainted",
        "processing_status", "detection_fail",
    )


@query()
def anonymize_images(t: Tables) -> DataFrame:
    return _anonymized(t).select(
        "stem", "output_sha256", "ssim", "edge_ratio", "final_decision", "failure_reason", "route", "retry_count"
    )


_LENIENT = replace(DEFAULTS, ssim_min=-1.0, edge_ratio_max=float("inf"))


def _as_items(t: Tables) -> DataFrame:
    return rasters(t).select(F.concat(F.lit("in/"), "stem", F.lit(".png")).alias("path"), "*")


@query(
    f"""SELECT {_STEM} AS stem, 'in/vec-' || vec_id || '.png' AS path, 'final_clean' AS route, 0::BIGINT AS retry_count,
    TRUE AS has_hashes FROM embeddings"""
)
def run_waves_images(t: Tables) -> DataFrame:
    """Images through the whole run; thresholds of the tiles' noise are set aside, residual text still counts."""

    def process(chosen: DataFrame) -> DataFrame:
        return ops.anonymize_images(chosen, level_detector(FACE_LEVEL, 4), level_detector(TEXT_LEVEL), settings=_LENIENT)

    done = run_waves(t.spark, _as_items(t), process, scratch_path(t.spark, "images"))
    hashes = F.col("source_sha256").isNotNull() & (F.col("output_sha256") == F.sha2("content", 256))
    return done.select("stem", "path", "route", "retry_count", hashes.alias("has_hashes"))


@query(
    f"""SELECT 'vec-' || vec_id || '.png' AS image, 'pass' AS final_decision, 'final_clean' AS route, 0::BIGINT AS retry_count,
    1::BIGINT AS text_regions_detected, 1::BIGINT AS text_regions_inpainted, 1::BIGINT AS original_face_count, FALSE AS face_gan_applied,
    'completed' AS processing_status, 0::BIGINT AS errors FROM embeddings"""
)
def anonymize_images_audit(t: Tables) -> DataFrame:
    """The nested audit record of each image as a report row, and what the completeness check says of it."""
    make = level_detector(FACE_LEVEL, 4), level_detector(TEXT_LEVEL)
    judged = cut_lineage(ops.anonymize_images(_as_items(t), *make, settings=_LENIENT), "judged")
    audit = ops.to_audit(judged, F.to_timestamp(F.lit("2024-06-01 00:00:00")))
    flat = audit.select(
        "stem", "integrity_hashes.*", F.col("qa.final_decision").alias("final_decision"), "retry_count",
        F.col("actions.metadata_strip_method").alias("strip_method"),
    )
    wrong = audit_errors(judged.select("stem", F.col("output_sha256").alias("sha256")), flat).groupBy("stem").agg(F.count("*").alias("errors"))
    rows = master_row(audit).withColumn("stem", F.regexp_replace("image", "[.]png$", ""))
    return rows.join(wrong, "stem", "left").withColumn("errors", F.coalesce("errors", F.lit(0))).drop("stem")


@query("SELECT vec_id, 1 + label % 2 AS blurred, TRUE AS inside FROM embeddings")
def blur_counts_boxes_inside(t: Tables) -> DataFrame:
    """One box outside the raster and one or two inside; only those inside count."""

    def box(at: int) -> Column:
        point = lambda x: F.array(F.lit(float(x)), F.lit(float(x)))
        return F.struct(F.array(point(at), point(at + 9)).cast("array<array<float>>").alias("polygon"), F.lit("b").alias("text"), F.lit(0.9).alias("score"))

    boxes = F.when(F.col("label") % 2 == 1, F.array(box(500), box(3), box(30))).otherwise(F.array(box(500), box(3)))
    done = ops.blur(rasters(t).withColumn("boxes", boxes.cast(BOXES_DDL)))
    return done.select(
        F.substring_index("stem", "-", -1).cast("bigint").alias("vec_id"), F.col("regions_blurred").alias("blurred"), F.col("replacement_success").alias("inside")
    )


@query(
    """SELECT vec_id, round((2 * a * b + 6.5025) / (a * a + b * b + 6.5025), 6) AS ssim FROM
    (SELECT vec_id, CAST(vec_id % 200 AS DOUBLE) AS a, CAST((vec_id * 7) % 251 AS DOUBLE) AS b FROM embeddings)"""
)
def ssim_of_flat_rasters(t: Tables) -> DataFrame:
    """Two flat rasters have a similarity in closed form."""
    level = lambda v: F.unhex(F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(SIDE * SIDE * 3)))
    a, b = level(F.col("vec_id") % 200), level((F.col("vec_id") * 7) % 251)
    pairs = t.embeddings.select(
        F.col("vec_id").cast("string").alias("stem"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), a.alias("data"),
        F.array().cast(BOXES_DDL).alias("boxes"), F.lit(SIDE).alias("original_height"), F.lit(SIDE).alias("original_width"), b.alias("original_data"),
    )
    return ops.image_qa(pairs).select(F.col("stem").cast("bigint").alias("vec_id"), "ssim")


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2, "0")


def _line(level: Callable[[Column], Column]) -> Column:
    """One row of pixels as hexadecimal digits, gray, from the level at each x."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda x: F.repeat(_byte(level(x)), 3)), "")


def _gray(t: Tables, level: Callable[[Column], Column], hole: Column | None = None) -> DataFrame:
    """Rasters whose rows are alike, and black inside ``hole`` (x from and to, y from and to)."""
    plain = _line(level)
    if hole is None:
        lines = F.repeat(plain, F.lit(SIDE))
    else:
        x0, x1, y0, y1 = hole["x0"], hole["x1"], hole["y0"], hole["y1"]
        torn = _line(lambda x: F.when((x >= x0) & (x <= x1), 0).otherwise(level(x)))
        lines = F.concat(F.repeat(plain, y0), F.repeat(torn, y1 - y0 + 1), F.repeat(plain, SIDE - 1 - y1))
    stem = F.concat(F.lit("vec-"), F.col("vec_id")).alias("stem")
    return spread(t.embeddings).select(stem, "vec_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.unhex(lines).alias("data"))


def _rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    points = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    polygon = F.array(*[F.array(x.cast("float"), y.cast("float")) for x, y in points])
    return F.array(F.struct(polygon.alias("polygon"), F.lit("t").alias("text"), F.lit(0.9).alias("score"))).cast(BOXES_DDL)


def _id_of(stem: str) -> Column:
    return F.substring_index(stem, "-", -1).cast("bigint").alias("vec_id")


@query(
    """SELECT vec_id, sha256(unhex(repeat(string_agg(repeat(lpad(to_hex(2 * x + vec_id % 50), 2, '0'), 3), '' ORDER BY x), 64))) AS data_sha256
    FROM embeddings, (SELECT unnest(range(64)) AS x) GROUP BY vec_id"""
)
def redact_regions_ramp(t: Tables) -> DataFrame:
    """A black hole in a linear ramp: the smoothest surface through what is around it is the ramp."""
    k = F.col("vec_id")
    hole = {"x0": 3 + k % 9, "x1": 40 + k % 13, "y0": (2 + k % 7).cast("int"), "y1": (50 + k % 11).cast("int")}
    start = _gray(t, lambda x: 2 * x + k % 50, hole)
    boxed = start.withColumn("boxes", _rectangle(hole["x0"], hole["y0"], hole["x1"], hole["y1"]))
    return ops.redact(boxed, "diffuse", dilate=0).select(_id_of("stem"), F.sha2("data", 256).alias("data_sha256"))


@query(
    """WITH k AS (SELECT unnest(range(51)) - 25 AS i), w AS (SELECT i, exp(-(i * i) / 128.0) / (SELECT sum(exp(-(i * i) / 128.0)) FROM k) AS w FROM k),
    p AS (SELECT x, w, CASE WHEN x + i < 0 THEN -(x + i) WHEN x + i > 47 THEN 94 - (x + i) ELSE x + i END AS s FROM (SELECT unnest(range(48)) AS x), w),
    f AS (SELECT x, coalesce(sum(w) FILTER (s >= 24), 0) AS share FROM p GROUP BY x)
    SELECT vec_id, string_agg(lpad(to_hex(CAST(round(a + share * b) AS BIGINT)), 2, '0'), '' ORDER BY x) AS line, 1::BIGINT AS regions
    FROM (SELECT vec_id, vec_id % 100 AS a, 37 + vec_id % 89 AS b FROM embeddings), f GROUP BY vec_id"""
)
def blur_of_a_step(t: Tables) -> DataFrame:
    """A step blurred by the kernel is a sum of its weights."""
    k, zero = F.col("vec_id"), F.lit(8)
    start = _gray(t, lambda x: k % 100 + F.when(x >= 32, 37 + k % 89).otherwise(0))
    done = ops.blur(start.withColumn("boxes", _rectangle(zero, zero, F.lit(56), F.lit(56))))
    line = F.hex(F.substring("data", (30 * SIDE + 8) * 3 + 1, 48 * 3))
    gray = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda x: F.substring(line, x * 6 + 1, F.lit(2))), "")
    return done.select(_id_of("stem"), gray.alias("line"), F.col("regions_blurred").alias("regions"))


@query(
    """WITH g AS (SELECT x, y FROM (SELECT unnest(range(64)) AS x), (SELECT unnest(range(64)) AS y)),
    b AS (SELECT DISTINCT vec_id % 6 AS w, vec_id % 5 AS h FROM embeddings),
    d AS (SELECT w, h, x, y, greatest(28 - x, x - (30 + w), 0) AS dx, s, greatest(28 - (y - s), (y - s) - (30 + h), 0) AS dy FROM g, b, (SELECT unnest([-2, -1, 0, 1, 2]) AS s)),
    m AS (SELECT w, h, x, y, bool_or(s = 0 AND dy <= 12 AND dx <= round(sqrt(greatest(144 - dy * dy, 0)))) AS inside,
      bool_or(dy <= 12 AND dx <= round(sqrt(greatest(144 - dy * dy, 0))) + CASE WHEN abs(s) = 2 THEN 0 ELSE 2 END) AS wanted FROM d GROUP BY ALL),
    r AS (SELECT w, h, count(*) FILTER (inside AND x = 31) / count(*) FILTER (inside)::DOUBLE AS i,
      count(*) FILTER (wanted AND NOT inside AND x = 31) / count(*) FILTER (wanted AND NOT inside)::DOUBLE AS o FROM m GROUP BY ALL)
    SELECT vec_id, round(i / (o + 1e-6), 6) AS edge_ratio FROM embeddings JOIN r ON w = vec_id % 6 AND h = vec_id % 5"""
)
def edge_ratio_of_a_step(t: Tables) -> DataFrame:
    """One straight edge through the text: its share of the widened mask over its share of the ring around that."""
    k, at = F.col("vec_id"), F.lit(28)
    start = _gray(t, lambda x: 20 + F.when(x >= 32, 60 + k % 100).otherwise(0))
    boxed = start.withColumn("boxes", _rectangle(at, at, 30 + k % 6, 30 + k % 5))
    pairs = pair_original_output(boxed, start.select("stem", "height", "width", "data"))
    return ops.image_qa(pairs).select(_id_of("stem"), "edge_ratio")


def _checkered(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """An inpainter of the caller: the colour upside down."""
    return 255 - rgb


@query(
    """SELECT vec_id, upper(repeat(lpad(to_hex(255 - vec_id % 200), 2, '0'), 3 * (5 + vec_id % 7)) || repeat(lpad(to_hex(vec_id % 200), 2, '0'), 3 * (59 - vec_id % 7))) AS first_row
    FROM embeddings"""
)
def redact_with_own_fill(t: Tables) -> DataFrame:
    """The caller's function fills the mask and nothing else."""
    k, zero = F.col("vec_id"), F.lit(0)
    start = _gray(t, lambda x: k % 200 + x * 0).withColumn("boxes", _rectangle(zero, zero, 4 + k % 7, F.lit(9)))
    return ops.redact(start, _checkered, dilate=0).select(_id_of("stem"), F.hex(F.substring("data", 1, SIDE * 3)).alias("first_row"))
