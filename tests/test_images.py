import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactflow import sources
from redactflow.image import measures, ops, png, raster
from redactflow.image.headers import dims_of
from redactflow.operators.qa import pair_original_output
from redactflow.schemas import BOXES_DDL
from tests.helpers import BANDS, bright_bands, by, flat, sign, write_bytes, write_png


def rect(x0, y0, x1, y1):
    return {"polygon": [[x0, y0], [x1, y0], [x1, y1], [x0, y1]], "text": "", "score": 0.9}


def rgb_of(row):
    return ops.to_rgb(row["height"], row["width"], bytes(row["data"]))


# --- masks -------------------------------------------------------------------------------------------------


def test_mask_fills_rectangle_with_outline():
    mask = raster.boxes_to_mask(20, 30, [rect(5, 4, 10, 8)])
    want = np.zeros((20, 30), dtype=np.uint8)
    want[4:9, 5:11] = 255
    assert (mask == want).all()


def test_mask_even_odd_clipped_and_rotated():
    diamond = {"polygon": [[10, 2], [18, 10], [10, 18], [2, 10]]}
    mask = raster.boxes_to_mask(21, 21, [diamond])
    ys, xs = np.mgrid[0:21, 0:21]
    assert ((mask > 0) == (np.abs(ys - 10) + np.abs(xs - 10) <= 8)).all()
    assert (raster.boxes_to_mask(10, 10, [rect(-5, -5, 3, 40)])[:, :4] == 255).all()
    assert not raster.boxes_to_mask(10, 10, [{"polygon": []}, rect(20, 20, 30, 30)]).any()


@pytest.mark.parametrize("radius", [1, 3, 12])
def test_dilation_is_a_disk(radius):
    mask = np.zeros((41, 41), dtype=np.uint8)
    mask[20, 20] = 255
    got = raster.dilate(mask, radius) > 0
    ys, xs = np.mgrid[-20:21, -20:21]
    reach = np.rint(np.sqrt(np.clip(radius**2 - ys**2, 0, None)))
    assert (got == ((np.abs(ys) <= radius) & (np.abs(xs) <= reach))).all()
    edge = np.zeros((9, 9), dtype=np.uint8)
    edge[0, 0] = 255
    assert raster.dilate(edge, 2)[0, 2] == 255 and raster.dilate(edge, 2)[8, 8] == 0


# --- blur and redaction -------------------------------------------------------------------------------------


def test_blur_touches_only_the_box():
    rgb = np.random.default_rng(2).integers(0, 255, (120, 160, 3)).astype(np.uint8)
    out, n = raster.blur_boxes(rgb, [[30.7, 20.2, 90.9, 80.9], [150, 100, 400, 400], [50, 50, 50, 50]], 51)
    assert n == 2  # the last one is empty
    untouched = np.ones(rgb.shape[:2], dtype=bool)
    untouched[20:80, 30:90] = False
    untouched[100:120, 150:160] = False
    assert (out[untouched] == rgb[untouched]).all()
    assert out[20:80, 30:90].std() < rgb[20:80, 30:90].std() / 2
    assert (raster.gaussian_blur(flat(30, 30), 51) == 120).all()


@pytest.mark.parametrize("mode", ["solid", "boundary_mean", "diffuse", lambda rgb, mask: rgb * 0 + 7])
def test_redaction_leaves_the_rest(mode):
    rgb = sign(100, 120)
    mask = raster.boxes_to_mask(100, 120, [rect(10, 10, 40, 40), rect(100, 80, 130, 110)])
    out, status = raster.redact_regions(rgb, mask, mode)
    assert status == "ok" and (out[mask == 0] == rgb[mask == 0]).all() and (out[mask > 0] != rgb[mask > 0]).any()
    same, status = raster.redact_regions(rgb, mask * 0, mode)
    assert status == "skipped" and same is rgb


def test_redaction_fills_from_surroundings_and_rejects_unknown_modes():
    rgb = flat(50, 50, 90)
    rgb[20:30, 20:30] = 255
    mask = raster.boxes_to_mask(50, 50, [rect(20, 20, 29, 29)])
    for mode in ("boundary_mean", "diffuse"):
        assert (raster.redact_regions(rgb, mask, mode)[0] == 90).all()
    with pytest.raises(ValueError):
        raster.redact_regions(rgb, mask, "magic")


# --- measures ----------------------------------------------------------------------------------------------


def test_ssim_properties():
    rgb = sign(200, 260)
    assert measures.ssim(rgb, rgb) == pytest.approx(1.0)
    noisy = np.clip(rgb.astype(int) + np.random.default_rng(3).integers(-60, 60, rgb.shape), 0, 255).astype(np.uint8)
    blurred = raster.gaussian_blur(rgb, 21)
    assert measures.ssim(rgb, noisy) < 0.9 and measures.ssim(rgb, blurred) < 0.75
    assert measures.ssim(rgb, noisy) == pytest.approx(measures.ssim(noisy, rgb))
    assert measures.ssim(flat(5, 5), flat(5, 5)) is None


def test_ssim_equals_direct_formula():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 255, (12, 15)).astype(float), rng.integers(0, 255, (12, 15)).astype(float)
    scores = []
    for y in range(12 - 6):
        for x in range(15 - 6):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            cov = np.cov(p, q)
            c1, c2 = 6.5025, 58.5225
            top = (2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2)
            scores.append(top / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    gray = lambda m: np.repeat(m[:, :, None], 3, axis=2).astype(np.uint8)
    assert measures.ssim(gray(a), gray(b)) == pytest.approx(np.mean(scores), abs=1e-9)


def test_large_images_are_reduced_and_sizes_matched():
    big = np.kron(sign(150, 200), np.ones((4, 4, 1))).astype(np.uint8)
    assert measures.ssim(big, big) == pytest.approx(1.0)
    half = big[::2, ::2]
    assert measures.ssim(big, half) > 0.9
    assert np.allclose(measures.resize_area(flat(10, 20), 5, 7), 120)


def test_edges_find_a_step():
    gray = np.zeros((40, 40))
    gray[:, 20:] = 200
    found = measures.edges(gray)
    assert found[:, 18:22].any(axis=1).all() and not found[:, :17].any() and not found[:, 23:].any()
    assert found.sum(axis=1).max() == 1


def test_edge_ratio():
    assert measures.edge_artifact_ratio(sign(), []) == 0.0
    assert measures.edge_artifact_ratio(flat(200, 200), [rect(50, 50, 100, 80)]) == 0.0
    busy = np.random.default_rng(0).integers(0, 255, (200, 200, 3)).astype(np.uint8)
    assert measures.edge_artifact_ratio(busy, [rect(50, 50, 120, 80)]) > 0.12


# --- bytes -------------------------------------------------------------------------------------------------


def jpeg_with_segments(orientation=6):
    tiff = b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, orientation, 0) + b"\0" * 4
    exif = b"Exif\0\0" + tiff
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    sof = seg(0xC0, bytes([8]) + struct.pack(">HH", 48, 64) + b"\3\1\x11\0\2\x11\0\3\x11\0")
    return (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xE1, exif) + seg(0xED, b"Photoshop") + seg(0xE2, b"ICC_PROFILE\0")
        + seg(0xFE, b"comment") + seg(0xEE, b"Adobe") + sof + seg(0xDA, b"\0") + b"\x01\x02\xff\x00\x03\xff\xd9"
    )


def test_strip_jpeg_keeps_pixels_profile_and_frame():
    raw = jpeg_with_segments()
    clean, method = png.strip_metadata(raw)
    assert method == "segments_dropped"
    for gone in (b"Exif", b"Photoshop", b"comment"):
        assert gone in raw and gone not in clean
    for kept in (b"JFIF", b"ICC_PROFILE", b"Adobe"):
        assert kept in clean
    assert clean.endswith(b"\x01\x02\xff\x00\x03\xff\xd9") and dims_of(clean) == dims_of(raw) == (64, 48)


def test_strip_png_and_unsupported():
    plain = png.encode_png(sign(30, 40))
    noted = png.insert_text_chunk(plain, "Author", "Jane")
    assert png.strip_metadata(noted) == (plain, "chunks_dropped")
    assert png.strip_metadata(plain + b"trailing")[0] == plain
    assert png.strip_metadata(b"GIF89a....") == (None, "unsupported")


def test_orientation():
    assert png.orientation(jpeg_with_segments(6)) == 6 and png.orientation(png.encode_png(flat(2, 2))) == 1
    block = np.zeros((2, 3, 3), dtype=np.uint8)
    block[0, 0] = 9  # the mark is top left in the stored raster
    places = {1: (0, 0), 2: (0, 2), 3: (1, 2), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (2, 1), 8: (2, 0)}
    for turn, (y, x) in places.items():
        assert png.upright(block, turn)[y, x, 0] == 9, turn


def test_header_dims_webp_tiff():
    vp8x = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (639).to_bytes(3, "little") + (399).to_bytes(3, "little")
    assert dims_of(vp8x) == (640, 400)
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 128, 0) + struct.pack("<HHII", 257, 4, 1, 96)
    assert dims_of(tiff) == (128, 96)
    assert dims_of(b"\xff\xd8\xff") is None and dims_of(b"") is None and dims_of(b"II*\0\xff") is None


def test_written_png_decodes_in_the_jvm(spark, folder):
    write_png(f"{folder}/s.png", sign(60, 80))
    row = sources.decode_images(spark, folder).first()
    assert (rgb_of(row) == sign(60, 80)).all()


# --- flows -------------------------------------------------------------------------------------------------


@pytest.fixture
def originals(spark, folder):
    for i in range(3):
        write_png(f"{folder}/sign_{i}.png", sign(seed=i))
    write_png(f"{folder}/plain.png", flat(240, 320))
    write_bytes(f"{folder}/corrupted.jpg", b"this is not a image")
    return folder


def no_faces():
    return lambda rgb: []


def find_bands():
    return bright_bands


def test_anonymize_images_end_to_end(spark, originals):
    before = {r["path"]: r["h"] for r in sources.scan_items(spark, originals).select("path", F.sha2("content", 256).alias("h")).collect()}
    done = ops.anonymize_images(sources.decode_images(spark, originals), no_faces, find_bands)
    got = by(done.collect(), "stem")
    assert sorted(got) == ["corrupted", "plain", "sign_0", "sign_1", "sign_2"]
    bad = got["corrupted"]
    assert bad["processing_status"] == "failed" and "decode_failed" in bad["error"]
    assert bad["route"] == "quarantine" and bad["retry_count"] == 1 and bad["content"] is None
    plain = got["plain"]
    assert plain["route"] == "final_clean" and plain["cache_hit"] and plain["ssim"] == pytest.approx(1.0)
    for i in range(3):
        row = got[f"sign_{i}"]
        assert row["text_count"] == 2 and row["output_count"] == 0 and row["text_regions_inpainted"] == 2
        assert row["mask_dilation_px"] == 12 and not row["detection_fail"]
        assert hashlib.sha256(bytes(row["content"])).hexdigest() == row["output_sha256"]
    after = {r["path"]: r["h"] for r in sources.scan_items(spark, originals).select("path", F.sha2("content", 256).alias("h")).collect()}
    assert before == after


def test_unmasked_pixels_unchanged_in_published_file(spark, originals, folder):
    done = ops.process_images(sources.decode_images(spark, originals), no_faces, find_bands)
    row = by(done.collect(), "stem")["sign_0"]
    out = f"{folder}/out"
    write_bytes(f"{out}/sign_0.png", bytes(row["content"]))
    published = rgb_of(sources.decode_images(spark, out).first())
    mask = raster.boxes_to_mask(400, 640, BANDS, 12)
    assert (published[mask == 0] == sign()[mask == 0]).all()
    assert not bright_bands(published)


def test_retry_starts_from_the_original_with_stronger_parameters(spark, originals):
    items = sources.decode_images(spark, originals).filter("stem = 'sign_0'")
    again = items.withColumns({"extra_mask_dilation": F.lit(8), "retry_count": F.lit(2)})
    row = ops.process_images(again, no_faces, find_bands).first()
    assert row["mask_dilation_px"] == 20 and row["text_count"] == 2  # the text is still there to be found


def test_detector_failure_is_one_error_row(spark, originals):
    def fragile():
        def detect(rgb):
            if rgb.shape[0] == 240:
                raise RuntimeError("CUDA out of memory")
            return []

        return detect

    got = by(ops.anonymize_images(sources.decode_images(spark, originals), no_faces, fragile).collect(), "stem")
    assert got["plain"]["error"] == "RuntimeError: CUDA out of memory" and got["sign_1"]["error"] is None
    assert got["plain"]["failure_reason"].startswith("rule:processing_error")


def test_failed_redaction_reports_no_regions(spark, originals):
    def refuses(rgb, mask):
        raise RuntimeError("no backend")

    got = by(ops.anonymize_images(sources.decode_images(spark, originals), no_faces, find_bands, refuses).collect(), "stem")
    assert got["sign_0"]["text_regions_inpainted"] == 0 and got["sign_0"]["final_decision"] == "fail"
    assert got["plain"]["final_decision"] == "pass"


def test_qa_pairs_with_missing_original(spark, originals):
    items = sources.decode_images(spark, originals).filter("data is not null").select("stem", "height", "width", "data")
    outputs = items.withColumn("boxes", F.array().cast(BOXES_DDL))
    pairs = pair_original_output(outputs, items.filter("stem <> 'plain'"))
    got = by(ops.image_qa(pairs).collect(), "stem")
    assert got["plain"]["ssim"] is None and got["sign_1"]["ssim"] == pytest.approx(1.0)


def test_blur_redact_and_masks_as_frames(spark, originals):
    items = sources.decode_images(spark, originals).filter("stem = 'sign_0'")
    boxed = items.join(ops.apply_model(items, find_bands), "stem")
    assert boxed.select(F.size("boxes")).first()[0] == 2
    blurred = ops.blur(boxed).first()
    assert blurred["regions_blurred"] == 2 and blurred["replacement_success"]
    assert ops.redact(boxed, "solid").first()["status"] == "ok"
    assert ops.masks(boxed, 0).first()["masked_pixels"] == 2 * 601 * 51


def test_embedding_model_runs_in_batches(spark):
    from redactflow.functions.vectors import cosine_distance

    def make():
        return lambda batch: batch * 2.0

    frame = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([0.0, 1.0, 0.0, 1.0],)], "v array<float>")
    out = frame.withColumn("e", ops.embed_with(make, F.col("v"), 4))
    assert [r["d"] for r in out.select(cosine_distance(F.col("v"), F.col("e")).alias("d")).collect()] == pytest.approx([0, 0], abs=1e-6)


def test_png_rows_are_plain_zlib():
    body = png.encode_png(flat(3, 4, 5))
    size = struct.unpack(">I", body[33:37])[0]
    assert zlib.decompress(body[41 : 41 + size]) == (b"\0" + bytes([5] * 12)) * 3


# --- fills and edges at any size ------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [6, 61, 500])
def test_diffuse_fill_settles_at_any_size(size):
    ys, xs = np.mgrid[0:560, 0:560]
    ramp = np.rint(np.stack([xs * 0.4, ys * 0.4 + 10, 250 - (xs + ys) * 0.2], axis=2)).astype(np.uint8)
    mask = np.zeros((560, 560), np.uint8)
    mask[20 : 20 + size, 30 : 30 + size] = 255
    torn = np.where(mask[..., None] > 0, 0, ramp).astype(np.uint8)
    out, status = raster.redact_regions(torn, mask, "diffuse")
    assert status == "ok" and np.abs(out.astype(int) - ramp).max() <= 1
    hole = mask > 0
    work = raster._spread_in(torn.astype(float), hole)
    assert np.abs(raster._neighbours(work) - work)[hole].max() < 0.5 and (work[~hole] == torn[~hole]).all()


def test_diffuse_fill_of_any_shape():
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 255, (90, 75, 3)).astype(np.uint8)
    for hole in (rng.random((90, 75)) < 0.6, np.ones((90, 75), bool), np.eye(90, 75, dtype=bool)):
        out, _ = raster.redact_regions(rgb, np.where(hole, 255, 0).astype(np.uint8), "diffuse")
        assert (out[~hole] == rgb[~hole]).all()
        if not hole.all():
            assert out[hole].min() >= rgb[~hole].min() and out[hole].max() <= rgb[~hole].max()


@pytest.mark.parametrize("seed", range(6))
def test_edges_near_the_mask_are_those_of_the_whole_raster(seed, monkeypatch):
    """Long weak edges that are strong far away: the part looked at grows until nothing runs on."""
    rng = np.random.default_rng(seed)
    rgb = np.clip(np.cumsum(rng.integers(-3, 4, (120, 140, 3)), axis=1) * 3 + 120, 0, 255).astype(np.uint8)
    box = [rect(40, 50, 60, 58)]
    monkeypatch.setattr(measures, "MARGIN", 1)
    small = measures.edge_artifact_ratio(rgb, box)
    monkeypatch.setattr(measures, "MARGIN", 10_000)
    assert small == measures.edge_artifact_ratio(rgb, box)


def test_diffuse_fill_is_the_exact_one():
    """Holes of four corners anywhere, on the raster's border too, against the solution of all equations at once."""
    rng = np.random.default_rng(5)
    for n in range(40):
        height, width = rng.integers(8, 32, 2)
        rgb = rng.integers(0, 255, (height, width, 3)).astype(np.uint8)
        if n % 2:
            mask = raster.boxes_to_mask(height, width, [{"polygon": rng.uniform(-8, 40, (4, 2)).tolist()}], int(rng.integers(0, 4)))
        else:
            x0, x1, y0, y1 = *np.sort(rng.uniform(-5, width, 2)), *np.sort(rng.uniform(-5, height, 2))
            mask = raster.boxes_to_mask(height, width, [{"polygon": [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]}], 2)
        hole = mask > 0
        if not hole.any() or hole.all():
            continue
        places = np.argwhere(hole)
        number = np.zeros(hole.shape, int)
        number[hole] = np.arange(len(places))
        a, b = 4.0 * np.eye(len(places)), np.zeros((len(places), 3))
        for i, (y, x) in enumerate(places):
            for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                at = min(max(y + dy, 0), height - 1), min(max(x + dx, 0), width - 1)
                if hole[at]:
                    a[i, number[at]] -= 1
                else:
                    b[i] += rgb[at]
        want = np.linalg.solve(a, b)
        got = raster.redact_regions(rgb, mask, "diffuse")[0][hole]
        assert np.abs(got - want).max() < 0.51, n


def test_masks_larger_than_the_raster():
    mask = np.zeros((5, 9), np.uint8)
    mask[2, 4] = 255
    assert (raster.dilate(mask, 40) == 255).all()
