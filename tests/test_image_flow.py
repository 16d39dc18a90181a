"""The image flow from a folder to audit records, and speed on a photo-sized raster."""

import os
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS
from redactflow.image import ops
from redactflow.image.measures import edge_artifact_ratio, edges, resize_area, to_gray
from redactflow.image import raster
from redactflow.image.png import SIGNATURE, _chunk, decode_png, encode_png, insert_text_chunk, orientation, strip_metadata, upright, with_orientation
from redactflow.image.raster import blur_boxes
from redactflow.operators.verify import audit_errors
from redactflow.sources import files
from redactflow.streaming import drain, read_batches, stream_images
from tests.helpers import write_bytes


def nothing():
    return lambda rgb: []


def a_face():
    return lambda rgb: [{"polygon": [[2, 2], [20, 2], [20, 20], [2, 20]], "score": 0.9}]


def mean_colour():
    return lambda rgb: rgb.reshape(-1, 3).mean(axis=0)


def picture(seed=0, height=80, width=120):
    return np.random.default_rng(seed).integers(0, 255, (height, width, 3)).astype(np.uint8)


def test_facts_of_a_folder(spark, folder):
    write_bytes(f"{folder}/a.png", encode_png(picture()))
    write_bytes(f"{folder}/b c+%.png", encode_png(picture(1)))
    write_bytes(f"{folder}/bad.jpg", b"\xff\xd8 no picture")
    write_bytes(f"{folder}/tiny.png", encode_png(picture(2, 4, 4)))
    got = {r["stem"]: r for r in files.decode_images(spark, folder).collect()}
    assert set(got) == {"a", "b c+%", "bad", "tiny"} and got["bad"]["data"] is None
    assert all(r["orientation"] == 1 and len(r["source_sha256"]) == 64 for r in got.values())
    accepted, rejected = files.screen_folder(spark, folder)
    assert {r["stem"] for r in accepted.collect()} == {"a", "b c+%"}
    reasons = {r["stem"]: r["reject_reason"].split(":")[0] for r in rejected.collect()}
    assert reasons == {"bad": "corrupted_or_unreadable", "tiny": "resolution_too_low"}


def test_path_retries_and_hashes_stay(spark):
    data = ops.to_bgr_bytes(picture())
    row = ("s", "in/s.png", 1, 80, 120, bytearray(data), 6, "ab" * 32)
    items = spark.createDataFrame([row], "stem string, path string, retry_count int, height int, width int, data binary, orientation int, source_sha256 string")
    judged = ops.anonymize_images(items, a_face, nothing, make_embedder=mean_colour).cache()
    r = judged.first()
    assert (r["path"], r["source_sha256"]) == ("in/s.png", "ab" * 32)
    height, width = struct.unpack(">II", bytes(r["content"])[16:24])[::-1]
    assert (height, width) == (120, 80)  # turned upright
    # the mean colour hardly changes: the output is too like the original
    assert r["identity_distance"] < DEFAULTS.identity_distance_min and r["final_decision"] == "fail" and r["retry_count"] == 2
    audit = ops.to_audit(judged, F.current_timestamp())
    a = audit.first()
    assert a["qa"]["integrity"]["identity_fail"] and a["image"] == "s.png" and a["next_pass_overrides"] is not None
    flat = audit.select("stem", "integrity_hashes.*", F.col("qa.final_decision").alias("final_decision"), "retry_count", F.col("actions.metadata_strip_method").alias("strip_method"))
    assert audit_errors(judged.select("stem", F.col("output_sha256").alias("sha256")), flat).isEmpty()


def test_boxes_outside_are_not_counted():
    rgb = picture()
    out, n = blur_boxes(rgb, [[500, 500, 509, 509], [-9, -9, -1, -1]])
    assert n == 0 and (out == rgb).all()


def slow_edges(gray, low=50, high=150):
    """Growth of strong edges over the whole frame, again and again."""
    import redactflow.image.measures as m

    weak = m.edges(gray, low, low)
    strong = m.edges(gray, high, high) & weak
    while True:
        p = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for dy in range(3):
            for dx in range(3):
                near |= p[dy : dy + strong.shape[0], dx : dx + strong.shape[1]]
        grown = weak & near
        if (grown == strong).all():
            return strong
        strong = grown


@pytest.mark.parametrize("seed", range(4))
def test_edges_grow_as_before(seed):
    rng = np.random.default_rng(seed)
    gray = to_gray(np.kron(rng.integers(0, 255, (12, 17, 3)), np.ones((7, 5, 1))) + rng.integers(0, 30, (84, 85, 3)))
    assert (edges(gray) == slow_edges(gray)).all()


def test_resize_is_the_mean_of_cells():
    image = np.random.default_rng(3).integers(0, 255, (30, 44)).astype(float)
    assert np.allclose(resize_area(image, 15, 11), image.reshape(15, 2, 11, 4).mean(axis=(1, 3)))
    assert np.isclose(resize_area(image, 7, 13).mean(), image.mean())
    assert np.allclose(resize_area(image, 60, 88), np.kron(image, np.ones((2, 2))))


def test_a_photo_with_residual_text_is_quick():
    rgb = np.kron(np.random.default_rng(0).integers(0, 255, (375, 500, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    box = {"polygon": [[400, 400], [1400, 400], [1400, 500], [400, 500]]}
    start = time.process_time()
    edge_artifact_ratio(rgb, [box])
    assert time.process_time() - start < (30 if os.environ.get("SLOW_BOX") else 12)


@pytest.mark.parametrize("turn", range(1, 9))
def test_png_files_tell_how_they_are_turned(turn):
    file = with_orientation(encode_png(picture()), turn)
    assert orientation(file) == turn and orientation(strip_metadata(file)[0]) == 1 and orientation(encode_png(picture())) == 1
    assert orientation(file[:40]) == 1  # cut off
    back = {6: 8, 8: 6}.get(turn, turn)
    assert (upright(upright(picture(), back), turn) == picture()).all()


def band():
    """The rows that are all white."""

    def detect(rgb):
        rows = np.flatnonzero((rgb == 255).all(axis=(1, 2)))
        return [{"polygon": [[0, rows[0]], [rgb.shape[1] - 1, rows[0]], [rgb.shape[1] - 1, rows[-1]], [0, rows[-1]]], "text": "t", "score": 0.9}] if len(rows) else []

    return detect


def decode_flat(content):
    """A decoder of the caller: two numbers and a level."""
    head, height, width, level = content.split()
    if head != b"FLAT":
        raise ValueError("not mine")
    return np.full((int(height), int(width), 3), int(level), np.uint8)


def test_stream_of_turned_files_equals_batch(spark, folder):
    rgb = picture() // 2
    rgb[5:12] = 255
    names = {f"turn {t}+%[{t}].png": t for t in (1, 3, 6, 8)}
    for name, t in names.items():
        write_bytes(f"{folder}/in/{name}", with_orientation(encode_png(upright(rgb, {6: 8, 8: 6}.get(t, t))), t))
    write_bytes(f"{folder}/in/bad.png", b"no picture")
    write_bytes(f"{folder}/in/a.webp", b"FLAT 40 60 9")
    write_bytes(f"{folder}/in/torn.webp", b"RIFF")
    decoders = {".webp": decode_flat}
    for _ in range(2):  # a second drain finds nothing new
        stream = files.open_image_stream(spark, f"{folder}/in", 3)
        drain(stream_images(stream, nothing, band, f"{folder}/out", f"{folder}/ck", decoders=decoders))
    got = {r["stem"]: r for r in read_batches(spark, f"{folder}/out").collect()}
    batch = ops.anonymize_images(files.decode_images(spark, f"{folder}/in", decoders=decoders), nothing, band)
    want = {r["stem"]: r for r in batch.collect()}
    assert got.keys() == want.keys() and len(got) == 7
    for stem, r in want.items():
        for c in ("source_sha256", "output_sha256", "text_boxes", "processing_status", "route", "error"):
            assert got[stem][c] == r[c], (stem, c)
    for name in names:
        box = got[name.removesuffix(".png")]["text_boxes"][0]["polygon"]
        assert box[0] == [0, 5] and box[2] == [119, 11]
    assert got["a"]["processing_status"] == "completed" and {got[s]["processing_status"] for s in ("bad", "torn")} == {"failed"}


def test_rectangles_and_small_blurs_by_the_short_way(monkeypatch):
    g = np.random.default_rng(1)
    for _ in range(300):
        (x0, x1), (y0, y1) = np.sort(g.integers(-15, 60, (2, 2)))
        corners = [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
        turned = [corners[(i + g.integers(4)) % 4] for i in range(4)]
        for pts in (corners, corners[1:] + corners[:1], corners[::-1], turned):
            # with a corner named twice the polygon is the same one, and no rectangle of four
            long, short = (raster.boxes_to_mask(40, 50, [{"polygon": p}]) for p in ([*pts, pts[-1]], pts))
            assert (long == short).all()
    for height, width, size in ((16, 16, 51), (1, 9, 5), (30, 2, 7)):
        values = picture(2, height, width).astype(np.float64)
        short = raster.gaussian_blur(values, size), raster._convolve(values, raster._kernel(size), 1)
        with monkeypatch.context() as m:
            m.setattr(raster, "PRODUCTS", 0)
            assert (raster.gaussian_blur(values, size) == short[0]).all() and (raster._convolve(values, raster._kernel(size), 1) == short[1]).all()


def png_of(rgb, kinds, colour=2, interlaced=0, more=b""):
    """A PNG whose rows are stored in the ways named: 0 as they are, 1 from the left, 2 from above, 4 by Paeth."""
    height, width, bands = rgb.shape
    lines, above = [], np.zeros((width, bands), np.int32)
    for row, kind in zip(rgb.astype(np.int32), kinds):
        left = np.vstack([np.zeros((1, bands), np.int32), row[:-1]])
        corner = np.vstack([np.zeros((1, bands), np.int32), above[:-1]])
        p = left + above - corner
        off = [abs(p - v) for v in (left, above, corner)]
        paeth = np.where((off[0] <= off[1]) & (off[0] <= off[2]), left, np.where(off[1] <= off[2], above, corner))
        lines.append(bytes([kind]) + ((row - {0: 0, 1: left, 2: above, 4: paeth}[kind]) % 256).astype(np.uint8).tobytes())
        above = row
    packed = zlib.compress(b"".join(lines))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, interlaced)
    half = len(packed) // 2
    return SIGNATURE + _chunk(b"IHDR", head) + more + _chunk(b"IDAT", packed[:half]) + _chunk(b"IDAT", packed[half:]) + _chunk(b"IEND", b"")


def odd_files():
    """PNG files that are read at once, and files that are left to the JVM."""
    rgb = np.random.default_rng(3).integers(0, 256, (9, 14, 3)).astype(np.uint8)
    whole = png_of(rgb, [0] * 9)
    plain = {
        "rows.png": whole, "left.png": png_of(rgb, [1] * 9), "above.png": png_of(rgb, [2] * 9), "mixed.png": png_of(rgb, [2, 1, 0, 2, 2, 1, 1, 0, 2]),
        "one.png": png_of(rgb[:1, :1], [2]), "noted.png": insert_text_chunk(with_orientation(whole, 6), "a", "b"), "more.png": whole + b"\n",
    }
    other = {
        "paeth.png": png_of(rgb, [0, 4, 4, 1, 2, 4, 0, 4, 4]), "gray.png": png_of(rgb[..., :1], [0] * 9, 0),
        "alpha.png": png_of(np.dstack([rgb, rgb[..., :1]]), [1] * 9, 6), "clear.png": png_of(rgb, [0] * 9, more=_chunk(b"tRNS", bytes(6))),
        "gamma.png": png_of(rgb, [0] * 9, more=_chunk(b"gAMA", struct.pack(">I", 99000))), "short.png": png_of(rgb, [0] * 8),
        "torn.png": whole[:-30], "head.png": whole[:20], "wrong.png": whole[:60] + b"?" + whole[61:], "none.png": b"nothing",
    }
    return plain, other


def test_plain_png_is_what_the_jvm_makes_of_it(spark, folder):
    plain, other = odd_files()
    for name, content in plain.items():
        write_bytes(f"{folder}/{name}", content)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in files.decode_images(spark, folder).collect()}
    for name, content in plain.items():
        r = rows[name]
        assert (decode_png(content) == ops.to_rgb(r["height"], r["width"], r["data"])).all(), name
    assert [n for n, content in other.items() if decode_png(content) is not None] == []


@pytest.mark.parametrize("which", ["both", "plain", "other"])
def test_only_what_is_not_plain_is_opened_again(spark, folder, monkeypatch, which):
    plain, other = odd_files()
    for name, content in {**(plain if which != "other" else {}), **(other if which != "plain" else {})}.items():
        write_bytes(f"{folder}/in/{name}", content)
    again = []

    def noted(known):
        again.extend(r["path"].rsplit("/", 1)[-1] for r in known.select("path").collect())
        return files.decode_batch(known)

    monkeypatch.setattr("redactflow.streaming.flows.decode_batch", noted)
    for n in range(2):  # the second run repeats all batches, as after a failure
        stream = files.open_image_stream(spark, f"{folder}/in", 100)
        drain(stream_images(stream, nothing, band, f"{folder}/out", f"{folder}/ck{n}"))
    assert sorted(again) == (sorted([*other, *other]) if which != "plain" else [])
    columns = ("stem", "source_sha256", "output_sha256", "processing_status", "route", "error")
    batch = ops.anonymize_images(files.decode_images(spark, f"{folder}/in"), nothing, band)
    rows = [sorted(tuple(map(str, r)) for r in f.select(*columns).collect()) for f in (read_batches(spark, f"{folder}/out"), batch)]
    assert rows[0] == rows[1] and len(rows[0]) == len(os.listdir(f"{folder}/in"))


def test_formats_without_a_decoder_are_rejected_once(spark, folder):
    write_bytes(f"{folder}/a.webp", b"FLAT 80 90 9")
    write_bytes(f"{folder}/b.png", encode_png(picture()))
    accepted, rejected = files.screen_folder(spark, folder)
    assert [r["stem"] for r in accepted.collect()] == ["b"]
    assert [(r["stem"], r["reject_reason"]) for r in rejected.collect()] == [("a", "no_decoder:.webp")]
