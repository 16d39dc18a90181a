import numpy as np
import pytest
from pyspark.sql import functions as F

from redactflow import sources
from redactflow.config import Settings
from redactflow.image import ops
from redactflow.operators.text import anonymize_text
from redactflow.plans import waves
from redactflow.streaming import drain, read_batches, stream_images
from tests.helpers import bright_bands, by, flat, sign, write_bytes, write_png

FILLER = "Plain prose that says nothing about anyone and goes on for a while so that most of it is kept. " * 3


def items_of(spark, texts):
    return spark.createDataFrame([(s, f"in/{s}.txt", x) for s, x in texts.items()], "stem string, path string, text string")


def by_text(queue):
    return anonymize_text(queue, "text")


def test_every_item_ends_in_one_place(spark, folder):
    items = items_of(spark, {"clean": FILLER, "mail": FILLER + "a@b.co", "short": "a@b.co", "bad": FILLER, "busy": FILLER})
    rejected = spark.createDataFrame([("bad",)], "stem string")
    locked = spark.createDataFrame([("busy",)], "stem string")
    got = by(waves.run_waves(spark, items, by_text, folder, rejected, locked).collect(), "stem")
    assert {s: (r["route"], r["retry_count"]) for s, r in got.items()} == {
        "clean": ("final_clean", 0), "mail": ("final_clean", 0), "short": ("manual_review", 3),
    }
    log = spark.read.parquet(f"{folder}/attempts")
    assert log.filter("stem = 'short'").count() == 3 and log.filter("stem = 'clean'").count() == 1


def test_rerun_is_a_no_op_and_new_items_join(spark, folder):
    items = items_of(spark, {"a": FILLER, "short": "a@b.co"})
    waves.run_waves(spark, items, by_text, folder)
    before = spark.read.parquet(f"{folder}/attempts").count()
    waves.run_waves(spark, items, by_text, folder)
    assert spark.read.parquet(f"{folder}/attempts").count() == before
    more = items.union(items_of(spark, {"b": FILLER}))
    final = waves.run_waves(spark, more, by_text, folder)
    assert final.count() == 3 and spark.read.parquet(f"{folder}/attempts").count() == before + 1


def test_interrupted_run_continues(spark, folder):
    items = items_of(spark, {"a": FILLER, "short": "a@b.co"})
    with pytest.raises(RuntimeError, match="still pending"):
        waves.run_waves(spark, items, by_text, folder, settings=Settings(max_waves=1))
    state = by(waves.current_state(waves.read_attempts(spark, folder)).collect(), "stem")
    assert state["short"]["route"] == "quarantine"
    final = by(waves.run_waves(spark, items, by_text, folder).collect(), "stem")
    assert (final["short"]["route"], final["short"]["wave"]) == ("manual_review", 2)


def test_only_the_first_wave_ranks_all_items(spark, folder, monkeypatch):
    ranked, pending = [], waves._pending
    monkeypatch.setattr(waves, "_pending", lambda *a: ranked.append(1) or pending(*a))
    items = items_of(spark, {"a": FILLER, "short": "a@b.co"})
    final = by(waves.run_waves(spark, items, by_text, folder).collect(), "stem")
    assert (final["short"]["route"], final["short"]["wave"]) == ("manual_review", 2) and len(ranked) == 1


def test_items_without_a_verdict_stay_pending(spark, folder):
    """The first wave loses one item, gives another no route and one a count beyond the budget."""
    calls = []

    def process(chosen):
        calls.append(1)
        done = by_text(chosen)
        if len(calls) > 1:
            return done
        stem = F.col("stem")
        route = F.when(stem == "spent", "quarantine").when(stem != "none", F.col("route"))
        tries = F.when(stem == "spent", 7).otherwise(F.col("retry_count"))
        return done.filter(stem != "lost").withColumns({"route": route, "retry_count": tries.cast("int")})

    items = items_of(spark, {s: FILLER for s in ("a", "lost", "none", "spent")})
    got = by(waves.run_waves(spark, items, process, folder).collect(), "stem")
    assert {s: (r["route"], r["retry_count"], r["wave"]) for s, r in got.items()} == {
        "a": ("final_clean", 0, 0), "lost": ("final_clean", 0, 1), "none": ("final_clean", 0, 1), "spent": ("final_clean", 0, 1),
    }


def test_pilot_set_stays_fixed(spark, folder):
    items = items_of(spark, {f"s{i}": "a@b.co" for i in range(6)})
    final = waves.run_waves(spark, items, by_text, folder, max_items=2).collect()
    assert sorted(r["stem"] for r in final) == ["s0", "s1"]
    assert spark.read.parquet(f"{folder}/attempts").count() == 6


def test_duplicate_stems_are_processed_once(spark, folder):
    rows = [("x", "in/x.jpg", FILLER), ("x", "in/x.png", "a@b.co"), ("y", "in/y.jpg", FILLER)]
    items = spark.createDataFrame(rows, "stem string, path string, text string")
    got = by(waves.run_waves(spark, items, by_text, folder).collect(), "stem")
    assert len(got) == 2 and got["x"]["path"] == "in/x.jpg"


@pytest.mark.parametrize("limit", [100, 2, 0])
def test_pick_same_items_by_every_way(spark, limit):
    items = spark.createDataFrame([(s, s, s * 3) for s in "abcdef"], "stem string, path string, text string")
    pending = spark.createDataFrame([(s, s, 0) for s in "abcd"], "stem string, path string, retry_count int")
    got = waves.pick(items, pending, 4, limit).collect()
    assert sorted((r["stem"], r["text"], r["retry_count"]) for r in got) == [(s, s * 3, 0) for s in "abcd"]
    mixed = pending.withColumn("retry_count", F.lit(1))
    assert {r["retry_count"] for r in waves.pick(items, mixed, 4, limit).collect()} == {1}


def test_images_pass_once_the_mask_is_wide_enough(spark, folder):
    """A bright frame stays visible around the found box until the second retry widens the mask enough."""
    rgb = flat(200, 300, 60)
    rgb[60:120, 60:220] = 240
    rgb[46:134, 46:234][rgb[46:134, 46:234] == 60] = 200
    write_png(f"{folder}/in/framed.png", rgb)
    write_png(f"{folder}/in/plain.png", flat(100, 100))
    write_bytes(f"{folder}/in/broken.jpg", b"nope")

    def text():
        def detect(image):
            core, frame = (image == 240).all(axis=2), (image == 200).all(axis=2)
            ys, xs = np.nonzero(core if core.any() else frame)
            if not len(xs):
                return []
            x0, x1, y0, y1 = xs.min(), xs.max(), ys.min(), ys.max()
            return [{"polygon": [[x0, y0], [x1, y0], [x1, y1], [x0, y1]], "text": "t", "score": 0.99}]

        return detect

    def judge(queue):
        done = ops.process_images(queue, lambda: lambda image: [], text, mode="solid")
        return ops.judge_images(done, Settings(ssim_min=0.0))

    items = sources.decode_images(spark, f"{folder}/in")
    got = by(waves.run_waves(spark, items, judge, f"{folder}/state").collect(), "stem")
    assert (got["plain"]["route"], got["plain"]["wave"]) == ("final_clean", 0)
    assert (got["framed"]["route"], got["framed"]["retry_count"], got["framed"]["mask_dilation_px"]) == ("final_clean", 2, 20)
    # an unreadable file is a failed attempt like any other and ends in manual review
    assert (got["broken"]["route"], got["broken"]["retry_count"]) == ("manual_review", 3)


def test_image_stream_equals_batch(spark, folder):
    for i in range(3):
        write_png(f"{folder}/in/s{i}.png", sign(120, 160, seed=i))
    write_bytes(f"{folder}/in/broken.jpg", b"nope")
    faces, text = (lambda: lambda image: []), (lambda: bright_bands)
    stream = sources.open_image_stream(spark, f"{folder}/in", max_files=2)
    drain(stream_images(stream, faces, text, f"{folder}/out", f"{folder}/ck"))
    drain(stream_images(sources.open_image_stream(spark, f"{folder}/in", 2), faces, text, f"{folder}/out", f"{folder}/ck"))
    rows = read_batches(spark, f"{folder}/out")
    batch = ops.anonymize_images(sources.decode_images(spark, f"{folder}/in"), faces, text)
    pick = lambda f: sorted((r["stem"], r["output_sha256"], r["route"]) for r in f.collect())
    assert pick(rows.select("stem", "output_sha256", "route")) == pick(batch.select("stem", "output_sha256", "route"))
    assert rows.select("batch_id").distinct().count() == 2
