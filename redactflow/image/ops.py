"""Image operators on DataFrames. Each runs as one Arrow map: Spark partitions the rows, one raster at a time is open.

Rasters come as ``height, width, data`` with ``data`` in BGR row order, the layout of Spark's image source.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.image.measures import edge_artifact_ratio, ssim
from redactflow.image.png import encode_png, orientation, strip_metadata, upright
from redactflow.image.raster import Fill, blur_boxes, boxes_to_mask, redact_regions
from redactflow.functions.vectors import EPS
from redactflow.operators.qa import (
    decide,
    detection_fail,
    detection_reason,
    face_count_warn,
    identity_fail,
    integrity_fail,
    integrity_reason,
    recycle_overrides,
)
from redactflow.operators.route import regions_inpainted, route
from redactflow.schemas import AUDIT_SCHEMA_NAME, BOXES_DDL

Detector = Callable[[np.ndarray], Sequence[dict]]
#: Makes the RGB raster of a file from its path and content, or None where it cannot open such a file.
Reader = Callable[[str, bytes], np.ndarray | None]
#: The error of a file that a reader leaves to others.
UNOPENED = "unopened"
#: Rows, and bytes of images, that a map hands back together.
OUT_ROWS, OUT_BYTES = 256, 4 << 20

_loaded: dict[str, object] = {}


def once_per_worker(make: Callable[[], object]) -> Callable[[], object]:
    """Load a model on first use and keep it for the life of the Python worker."""
    key = uuid.uuid4().hex

    def get() -> object:
        if key not in _loaded:
            _loaded[key] = make()
        return _loaded[key]

    return get


def to_rgb(height: int, width: int, data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, dtype=np.uint8)
    channels = flat.size // (height * width)
    raster = flat.reshape(height, width, channels)
    if channels == 1:
        return np.repeat(raster, 3, axis=2)
    return raster[:, :, 2::-1]


def to_bgr_bytes(rgb: np.ndarray) -> bytes:
    return np.ascontiguousarray(rgb[:, :, ::-1]).tobytes()


def _map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Row-wise map over Arrow batches. One row of a batch is opened at a time; results leave in batches of ``OUT_ROWS``
    rows or ``OUT_BYTES`` bytes of images, whichever is reached first."""
    arrow_schema_of = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held = [], 0
            for i in range(batch.num_rows):
                done.append(fn(batch.slice(i, 1).to_pylist()[0]))
                held += sum(len(v) for v in done[-1].values() if isinstance(v, bytes))
                if len(done) >= OUT_ROWS or held >= OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow_schema_of)
                    done, held = [], 0
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow_schema_of)

    return df.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def apply_model(df: DataFrame, make_predict_fn: Callable[[], Detector], key: str = "stem") -> DataFrame:
    """Boxes found by a detector of the caller: adds ``boxes`` to ``key, height, width, data``."""
    detector = once_per_worker(make_predict_fn)

    def detect(row: dict) -> dict:
        found = detector()(to_rgb(row["height"], row["width"], row["data"])) if row["data"] else []
        return {key: row[key], "boxes": [_box(b) for b in found]}

    return _map_rows(df.select(key, "height", "width", "data"), detect, f"{key} string, boxes {BOXES_DDL}")


def embed_with(make_predict_fn: Callable, column: Column, size: int, batch_size: int = 64) -> Column:
    """Embeddings by a batch model of the caller (``ndarray -> ndarray``), loaded once per worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    model = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[size]]
    )
    return model(column)


def _box(box: dict) -> dict:
    polygon = [[float(v) for v in p] for p in box["polygon"]]
    return {"polygon": polygon, "text": str(box.get("text", "")), "score": float(box.get("score", 0.0))}


def rectangle_of(box: dict) -> list[float]:
    pts = np.asarray(box["polygon"], dtype=np.float64)
    return [*pts.min(axis=0), *pts.max(axis=0)]


def masks(df: DataFrame, dilate: int = DEFAULTS.mask_dilation, key: str = "stem") -> DataFrame:
    """``key, mask`` (one byte per pixel, 255 = repaint) and ``masked_pixels`` from ``height, width, boxes``."""

    def draw(row: dict) -> dict:
        mask = boxes_to_mask(row["height"], row["width"], row["boxes"] or [], dilate)
        return {key: row[key], "mask": mask.tobytes(), "masked_pixels": int((mask > 0).sum())}

    return _map_rows(
        df.select(key, "height", "width", "boxes"), draw, f"{key} string, mask binary, masked_pixels bigint"
    )


def blur(df: DataFrame, ksize: int = DEFAULTS.face_blur_ksize, key: str = "stem") -> DataFrame:
    """Blur the boxes of each raster; ``regions_blurred`` and ``replacement_success`` tell what was done."""

    def run(row: dict) -> dict:
        boxes = [rectangle_of(b) for b in row["boxes"] or []]
        out, n = blur_boxes(to_rgb(row["height"], row["width"], row["data"]), boxes, ksize)
        return {
            key: row[key], "height": row["height"], "width": row["width"], "data": to_bgr_bytes(out),
            "regions_blurred": n, "replacement_success": n > 0,
        }

    schema = f"{key} string, height int, width int, data binary, regions_blurred int, replacement_success boolean"
    return _map_rows(df.select(key, "height", "width", "data", "boxes"), run, schema)


def redact(
    df: DataFrame, mode: str | Fill = "boundary_mean", dilate: int = DEFAULTS.mask_dilation, key: str = "stem"
) -> DataFrame:
    """Fill the boxes of each raster from their surroundings; ``status`` is ok or skipped (nothing to do)."""

    def run(row: dict) -> dict:
        rgb = to_rgb(row["height"], row["width"], row["data"])
        mask = boxes_to_mask(row["height"], row["width"], row["boxes"] or [], dilate)
        out, status = redact_regions(rgb, mask, mode)
        return {
            key: row[key], "height": row["height"], "width": row["width"], "data": to_bgr_bytes(out), "status": status,
        }

    schema = f"{key} string, height int, width int, data binary, status string"
    return _map_rows(df.select(key, "height", "width", "data", "boxes"), run, schema)


def strip_all_metadata(df: DataFrame, key: str = "stem") -> DataFrame:
    """``content`` without EXIF, IPTC, XMP and comments, and the ``method``; other formats come back with null content
    and must be decoded and written again (``encode``)."""

    def run(row: dict) -> dict:
        clean, method = strip_metadata(row["content"] or b"")
        return {key: row[key], "content": clean, "method": method}

    return _map_rows(df.select(key, "content"), run, f"{key} string, content binary, method string")


def encode(df: DataFrame, key: str = "stem") -> DataFrame:
    """Rasters as metadata-free PNG bytes."""

    def run(row: dict) -> dict:
        return {key: row[key], "content": encode_png(to_rgb(row["height"], row["width"], row["data"]))}

    return _map_rows(df.select(key, "height", "width", "data"), run, f"{key} string, content binary")


def image_qa(pairs: DataFrame, key: str = "stem") -> DataFrame:
    """``ssim`` and ``edge_ratio`` of outputs paired with originals (``original_*`` columns); null original gives null."""

    def run(row: dict) -> dict:
        out = to_rgb(row["height"], row["width"], row["data"])
        similar = None
        if row["original_data"]:
            similar = ssim(to_rgb(row["original_height"], row["original_width"], row["original_data"]), out)
        return {key: row[key], "ssim": similar, "edge_ratio": edge_artifact_ratio(out, row["boxes"] or [])}

    columns = ["height", "width", "data", "boxes", "original_height", "original_width", "original_data"]
    return _map_rows(pairs.select(key, *columns), run, f"{key} string, ssim double, edge_ratio double")


PROCESSED_DDL = f"""
stem string, path string, retry_count int, content binary, source_sha256 string, output_sha256 string, input_face_count int, post_face_count int, text_boxes {BOXES_DDL},
text_count int, mask_dilation_px int, output_boxes {BOXES_DDL}, cache_hit boolean, redaction_status string,
inpaint_success boolean, metadata_strip_method string, ssim double, edge_ratio double, identity_distance double,
processing_status string, error string
"""


def process_images(
    items: DataFrame,
    make_face_detector: Callable[[], Detector],
    make_text_detector: Callable[[], Detector],
    mode: str | Fill = "boundary_mean",
    settings: Settings = DEFAULTS,
    make_embedder: Callable[[], Callable[[np.ndarray], Sequence[float]]] | None = None,
    read: Reader | None = None,
) -> DataFrame:
    """Faces blurred, text redacted, output re-scanned, measured and encoded: one row per item.

    ``items``: stem, height, width, data, and where there are any: path, retry_count, ``orientation`` (or ``content``,
    from which it is read), source_sha256 (else the hash of ``content`` or of the raster), ``extra_mask_dilation`` of
    the next pass. ``make_embedder`` gives a model from raster to vector; the cosine distance between original and
    output is then the ``identity_distance``. An item that cannot be processed gives a row with ``error``; the job
    goes on. With ``read`` items have stem, path and content in place of a raster, which it makes; an item that it gives
    None for comes back with the error ``UNOPENED``.
    """
    faces, texts = once_per_worker(make_face_detector), once_per_worker(make_text_detector)
    embed = once_per_worker(make_embedder) if make_embedder else None
    # content whole: the orientation may stand behind any number of other segments
    names = ("path", "retry_count", "source_sha256", "orientation", "extra_mask_dilation", "content")
    optional = [F.col(c) for c in names if c in items.columns]
    raster = [] if read else ["height", "width", "data"]

    def opened(row: dict) -> np.ndarray | None:
        if read:
            return read(row["path"], row["content"])
        if not row["data"]:
            raise ValueError("decode_failed")
        return to_rgb(row["height"], row["width"], row["data"])

    def run(row: dict) -> dict:
        kept = {k: row.get(k) for k in ("stem", "path", "retry_count")}
        source = row.get("content") or row["data"]
        kept["source_sha256"] = row.get("source_sha256") or (hashlib.sha256(source).hexdigest() if source else None)
        try:
            rgb = opened(row)
            if rgb is None:
                return kept | {"processing_status": "failed", "error": UNOPENED}
            return kept | _process(row, rgb, faces(), texts(), mode, settings, embed() if embed else None)
        except Exception as exc:  # one bad item must not stop the partition
            return kept | {"processing_status": "failed", "error": f"{type(exc).__name__}: {exc}"}

    return _map_rows(items.select("stem", *raster, *optional), run, " ".join(PROCESSED_DDL.split()))


def _distance(embed: Callable[[np.ndarray], Sequence[float]], a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.asarray(embed(a), dtype=np.float64), np.asarray(embed(b), dtype=np.float64)
    return float(1 - x @ y / ((np.linalg.norm(x) + EPS) * (np.linalg.norm(y) + EPS)))


def _process(
    row: dict, rgb: np.ndarray, faces: Detector, texts: Detector, mode: str | Fill, settings: Settings, embed: Callable | None
) -> dict:
    turn = row.get("orientation") or orientation(row.get("content") or b"")
    original = np.ascontiguousarray(upright(rgb, turn))
    found_faces = list(faces(original))
    blurred, _ = blur_boxes(original, [rectangle_of(b) for b in found_faces], settings.face_blur_ksize)
    found_text = [_box(b) for b in texts(blurred)]
    reach = settings.mask_dilation + int(row.get("extra_mask_dilation") or 0)
    mask = boxes_to_mask(*blurred.shape[:2], found_text, reach)
    redacted, status = redact_regions(blurred, mask, mode)
    # nothing found means nothing changed since the scan: its result stands for the output too
    rescanned = [_box(b) for b in texts(redacted)] if found_text else []
    content = encode_png(redacted)
    return {
        "content": content,
        "output_sha256": hashlib.sha256(content).hexdigest(),
        "input_face_count": len(found_faces),
        "post_face_count": len(list(faces(blurred))) if found_faces else 0,
        "text_boxes": found_text,
        "text_count": len(found_text),
        "mask_dilation_px": reach,
        "output_boxes": rescanned,
        "cache_hit": not found_text,
        "redaction_status": status,
        "inpaint_success": status == "ok" or not found_text,
        "metadata_strip_method": "reencoded",
        "ssim": ssim(original, redacted),
        "edge_ratio": edge_artifact_ratio(redacted, rescanned),
        # who is on the picture is told by faces; without one there is nothing to compare
        "identity_distance": _distance(embed, original, redacted) if embed and found_faces else None,
        "processing_status": "completed",
    }


def judge_images(processed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """QA, decision and routing as columns over processed rows; failed items are failed attempts."""
    from redactflow.functions.boxes import box_count, max_score

    given = {"retry_count": F.lit(0), "identity_distance": F.lit(None).cast("double")}
    start = processed.withColumns({k: F.coalesce(F.col(k), v) if k in processed.columns else v for k, v in given.items()})
    broken = F.col("processing_status") == "failed"
    scored = start.withColumns(
        {"output_max_score": max_score(F.col("output_boxes")), "output_count": box_count(F.col("output_boxes"))}
    )
    flags = scored.withColumns(
        {
            "detection_fail": detection_fail(F.col("output_max_score"), F.col("output_count"), settings),
            "integrity_fail": integrity_fail(
                F.col("ssim"),
                F.col("identity_distance"),
                F.col("edge_ratio"),
                F.col("post_face_count"),
                F.col("input_face_count"),
                settings=settings,
            ),
            "face_count_warning": face_count_warn(F.col("post_face_count"), settings),
            "text_regions_inpainted": regions_inpainted(F.col("text_count"), F.col("inpaint_success")),
        }
    )
    return route(decide(flags, {"processing_error": broken}), settings)


def anonymize_images(
    items: DataFrame,
    make_face_detector: Callable[[], Detector],
    make_text_detector: Callable[[], Detector],
    mode: str | Fill = "boundary_mean",
    settings: Settings = DEFAULTS,
    make_embedder: Callable[[], Callable[[np.ndarray], Sequence[float]]] | None = None,
) -> DataFrame:
    """``process_images`` then ``judge_images``. Write the result before using it twice: rasters are costly.

    With items that have a path it can be the ``process`` of ``run_waves``.
    """
    processed = process_images(items, make_face_detector, make_text_detector, mode, settings, make_embedder)
    return judge_images(processed, settings)


def to_audit(judged: DataFrame, now: Column, batch_id: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The nested audit record of judged images (``AUDIT_DDL``), without contents."""
    col = F.col
    failed = col("processing_status") == "failed"
    ssim_fail = F.coalesce(col("ssim") < settings.ssim_min, F.lit(False))
    edge_fail = F.coalesce(col("edge_ratio") > settings.edge_ratio_max, F.lit(False))
    who_fail = identity_fail(col("identity_distance"), col("post_face_count"), col("input_face_count"), settings)

    def stage(name: str, backend: str, status: Column) -> Column:
        said = F.when(failed, F.lit("failed")).otherwise(status)
        return F.struct(F.lit(name).alias("name"), F.lit(backend).alias("backend"), said.alias("status"), F.when(failed, col("error")).alias("error"))

    detection = F.struct(
        col("output_count").cast("int").alias("ocr_lines"), col("output_max_score").alias("max_det_score"),
        col("detection_fail").alias("fail"), detection_reason(col("detection_fail")).alias("reason"),
    )
    integrity = F.struct(
        col("ssim"), ssim_fail.alias("ssim_fail"), col("identity_distance"), who_fail.alias("identity_fail"), col("edge_ratio"),
        edge_fail.alias("edge_fail"), col("integrity_fail").alias("fail"), integrity_reason(col("integrity_fail")).alias("reason"),
    )
    blurred = F.when(col("input_face_count") > 0, "blurred").otherwise("none")
    record = F.struct(
        F.lit(AUDIT_SCHEMA_NAME).alias("schema"),
        col("stem"),
        F.coalesce(F.element_at(F.split("path", "/"), -1), col("stem")).alias("image"),
        col("path").alias("source_path"),
        (F.lit(None).cast("string") if batch_id is None else batch_id).alias("batch_id"),
        now.cast("timestamp").alias("created_at"),
        now.cast("timestamp").alias("updated_at"),
        col("retry_count").cast("int").alias("retry_count"),
        col("failure_reason"),
        F.struct("source_sha256", "output_sha256").alias("integrity_hashes"),
        F.struct(
            F.struct("input_face_count", "post_face_count").alias("faces"),
            F.struct(col("text_boxes").alias("boxes"), col("text_count").alias("count"), col("mask_dilation_px")).alias("text"),
        ).alias("detections"),
        F.struct(col("input_face_count").alias("original_face_count"), F.lit(None).cast("array<float>").alias("original_embedding")).alias("qa_probes"),
        F.struct(col("output_boxes"), col("output_max_score"), col("output_count").cast("int").alias("output_count")).alias("qa_cache"),
        F.array(
            stage("faces", "blur", blurred), stage("text", "redact", F.coalesce("redaction_status", F.lit("skipped"))), stage("metadata", "png", F.lit("ok"))
        ).alias("stages"),
        F.struct(
            F.array(F.lit("faces"), F.lit("text"), F.lit("metadata")).alias("order"), blurred.alias("face_action"),
            col("redaction_status").alias("text_action"), col("metadata_strip_method"),
        ).alias("actions"),
        F.struct(
            col("processing_status"), F.lit(False).alias("face_gan_applied"), col("text_regions_inpainted").cast("int").alias("text_regions_inpainted"),
            col("inpaint_success"), (col("final_decision") == "pass").alias("qa_passed"),
        ).alias("success_metrics"),
        F.struct(
            detection.alias("detection"), integrity.alias("integrity"), col("final_decision"), col("route").alias("final_route"), col("failure_reason")
        ).alias("qa"),
        F.when(col("final_decision") == "fail", recycle_overrides(col("retry_count"))).alias("next_pass_overrides"),
    )
    have = judged.columns
    filled = judged.withColumns({c: F.lit(None).cast("string") for c in ("path", "source_sha256") if c not in have})
    return filled.select(record.alias("a")).select("a.*")
