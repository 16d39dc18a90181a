"""Cases in which part of a match, a nested secret or an item once got lost."""

import json
import os


import pytest
from pyspark.sql import functions as F

from redactflow.functions.secrets import REDACTED, redact_json_text, redact_struct
from redactflow.operators import reports, verify
from redactflow.operators.screen import image_dims
from redactflow.operators.text import anonymize_text, mask_entities
from redactflow.plans.waves import run_waves
from redactflow.sinks import tables
from redactflow.sinks.export import export_clean, read_export


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("to " + "a" * 5000 + "@x.org now", "to [EMAIL] now"),
        ("a@" + "b" * 5000 + ".org", "[EMAIL]"),
        ("a@b.cc@d.ee", "[EMAIL]@d.ee"),
        ("x" * 50_000, "x" * 50_000),
        ("n " + "1" * 20 + " n", "n [CARD] n"),
        ("acct: 123456789012345678-12345678901 z", "[ACCOUNT] z"),
        ("acct: 12345678901-123456789012 z", "[ACCOUNT] z"),
    ],
)
def test_whole_runs_are_masked(spark, text, masked):
    out = mask_entities(spark.createDataFrame([(text,)], "t string"), "t").first()["masked"]
    assert out == masked


def test_null_text_is_a_failed_attempt(spark):
    rows = anonymize_text(spark.createDataFrame([(1, None), (2, "fine")], "i long, t string"), "t").collect()
    assert {r["i"]: r["route"] for r in rows} == {1: "quarantine", 2: "final_clean"}


def test_maps_are_walked_by_key(spark):
    row = spark.sql(
        """SELECT map('password', array('hunter2', 'x'), 'k', array('token=abc', 'y')) AS a, map('api_token', 7, 'n', 8) AS b,
        map('secret', map('z', 'hunter2'), 'o', map('password', 'hunter2')) AS c, map('token', named_struct('v', 'hunter2', 'n', 1)) AS d"""
    )
    out = redact_struct(row).first()
    assert out["a"] == {"password": [REDACTED, REDACTED], "k": [f"token={REDACTED}", "y"]}
    assert out["b"] == {"api_token": None, "n": 8}
    assert out["c"] == {"secret": {"z": REDACTED}, "o": {"password": REDACTED}}
    assert out["d"]["token"]["v"] == REDACTED and "hunter2" not in str(out)


JSON = [
    ({"password": {"a": {"b": "my real hunter2"}}, "k": 1}, {"password": REDACTED, "k": 1}),
    ({"token": [1, ["hunter2", {"x": []}]], "z": [{"secret": None}, "]}"]}, {"token": REDACTED, "z": [{"secret": REDACTED}, "]}"]}),
    ({"a": "password: hunter2, more", "b": 'q"\\'}, {"a": f"password={REDACTED} more", "b": 'q"\\'}),
    ([{"B2_KEY_ID": "hunter2"}, {"deep": {"deeper": {"api_key": {"v": "hunter2"}}}}], [{"B2_KEY_ID": REDACTED}, {"deep": {"deeper": {"api_key": REDACTED}}}]),
    ({}, {}),
    ("token", "token"),
]


@pytest.mark.parametrize(("value", "want"), JSON)
@pytest.mark.parametrize("indent", [None, 2])
def test_json_of_any_depth(spark, value, want, indent):
    frame = spark.createDataFrame([(json.dumps(value, indent=indent),)], "j string")
    assert json.loads(frame.select(redact_json_text(F.col("j")).alias("o")).first()["o"]) == want
    variant = redact_struct(frame.select(F.parse_json("j").alias("v"))).select(F.to_json("v").alias("o")).first()["o"]
    assert json.loads(variant) == want


def test_broken_json_with_a_secret_name(spark):
    frame = spark.createDataFrame([('{"password": {"a": "hunter2"',), (None,), ("plain token=abc",)], "j string")
    assert [r["o"] for r in frame.select(redact_json_text(F.col("j")).alias("o")).collect()][:2] == [REDACTED, None]


def test_tiff_directory_behind_the_pixels(spark):
    def entry(tag, value):
        return tag.to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + value.to_bytes(4, "little")

    pixels = bytes(200_000)
    body = b"II*\0" + (8 + len(pixels)).to_bytes(4, "little") + pixels + (2).to_bytes(2, "little") + entry(256, 300) + entry(257, 200) + bytes(4)
    row = image_dims(spark.createDataFrame([(bytearray(body),)], "content binary")).first()
    assert (row["width"], row["height"]) == (300, 200)


def test_equal_boxes_of_a_hot_item_come_in_full_rows(spark):
    boxes = spark.range(9000).select(
        F.lit("hot").alias("stem"), F.lit("t").alias("text"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("polygon"), F.lit(0.5).alias("score")
    )
    items = spark.createDataFrame([("hot",), ("bare",)], "stem string")
    got = verify.attach_detections(items, boxes).collect()
    assert sorted(len(r["boxes"]) for r in got if r["stem"] == "hot") == [808, 4096, 4096]
    assert [(len(r["boxes"]), r["part"], r["parts"]) for r in got if r["stem"] == "bare"] == [(0, 0, 1)]


def test_rows_without_a_run_stay(spark):
    rows = [(None, 0, 10, 5.0, 8, 1, 1), (None, 1, 10, 50.0, 8, 1, 1), ("r", 0, 10, 5.0, 9, 1, 0)]
    timings = spark.createDataFrame(rows, "run_id string, batch_index int, images int, elapsed_sec double, pass int, quarantine int, manual_review int")
    out = reports.running_progress(timings, F.lit(100)).collect()
    assert sorted((r["run_id"] or "", r["batch_index"], r["processed_cumulative"]) for r in out) == [("", 0, 10), ("", 1, 20), ("r", 0, 10)]
    slow = timings.withColumn("sec_per_image", F.col("elapsed_sec") / F.col("images"))
    assert reports.bottlenecks(slow).filter("reason = 'slow_batch_outlier'").first()["run_id"] is None


def exported(spark, target, body, write=None):
    items = spark.createDataFrame([("p", "s", bytearray(body))], "path string, stem string, content binary")
    items = items.withColumns({"sha256": F.sha2("content", 256), "final_decision": F.lit("pass")})
    audit = spark.sql("SELECT 's' AS stem, named_struct('final_decision', 'pass') AS qa")
    more = {"write": write} if write else {}
    return export_clean(spark, items, audit, target, "2024-01-01", **more)


def test_second_export_replaces_second_copies(spark, folder):
    calls = []

    def torn(df, path):
        calls.append(path)
        changed = df.withColumn("content", F.lit(b"broken")) if len(calls) == 1 else df
        changed.write.mode("overwrite").parquet(path)

    exported(spark, folder, b"old", torn)
    assert len(calls) == 2 and bytes(read_export(spark, folder).first()["content"]) == b"old"
    exported(spark, folder, b"new")
    assert [bytes(r["content"]) for r in read_export(spark, folder).collect()] == [b"new"]


def test_upsert_moves_an_item_between_batches(spark, folder):
    now, path = F.lit("2024-01-01").cast("timestamp"), f"{folder}/audit"
    rows = spark.createDataFrame([("x", "b1"), ("y", "b2"), ("z", "b3")], "stem string, batch_id string")
    tables.write_audit(rows, path, now)
    tables.upsert_audit(spark, spark.createDataFrame([("x", "b2"), ("z", "b1")], "stem string, batch_id string"), path, now)
    got = sorted((r["stem"], r["batch_id"]) for r in tables.audit_rows(spark, path).select("stem", "batch_id").collect())
    assert got == [("x", "b2"), ("y", "b2"), ("z", "b1")]


def test_scratch_goes_as_a_whole(folder):
    import subprocess
    import sys

    code = f"""
from redactflow.session import clear_scratch, cut_lineage, local_session
import glob
spark = local_session(1, **{{"spark.checkpoint.dir": "{folder}"}})
assert cut_lineage(spark.range(5)).count() == 5 and glob.glob("{folder}/redactflow/*/*")
clear_scratch(spark)
assert not glob.glob("{folder}/redactflow/*")
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def passing(chosen):
    return chosen.select(
        "stem", "path", F.lit("pass").alias("final_decision"), F.lit(None).cast("string").alias("failure_reason"), F.lit("final_clean").alias("route"), "retry_count"
    )


def test_torn_wave_is_written_anew(spark, folder):
    items = spark.createDataFrame([("a", "pa"), ("b", "pb")], "stem string, path string")
    os.makedirs(f"{folder}/attempts/wave=0/_temporary/0")
    assert run_waves(spark, items, passing, folder).count() == 2
    more = items.unionByName(spark.createDataFrame([("c", "pc")], "stem string, path string"))
    os.makedirs(f"{folder}/attempts/wave=1/_temporary/0")
    assert run_waves(spark, more, passing, folder).count() == 3


def test_running_out_of_waves_is_an_error(spark, folder):
    from redactflow.config import Settings

    items = spark.createDataFrame([("a", "pa")], "stem string, path string")
    with pytest.raises(RuntimeError, match="still pending"):
        run_waves(spark, items, lambda c: passing(c.limit(0)), folder, settings=Settings(max_waves=1))


def test_tiff_dims_of_both_byte_orders_and_torn_files(spark):
    """Only the directory goes to Python; a directory that is cut off or beyond the end is unreadable, as is an empty head."""
    from redactflow.operators import screen

    def tiff(order, mark, at, n=2, kind=3):
        entry = lambda tag, v: tag.to_bytes(2, order) + kind.to_bytes(2, order) + (1).to_bytes(4, order) + (v.to_bytes(2, order) + b"\0\0" if kind == 3 else v.to_bytes(4, order))
        return mark + at.to_bytes(4, order) + bytes(at - 8) + n.to_bytes(2, order) + entry(256, 300) + entry(257, 200) + bytes(4)

    little, big = tiff("little", b"II*\0", 90_000), tiff("big", b"MM\0*", 70_000, kind=4)
    rows = [(0, little), (1, big), (2, little[:-20]), (3, little[:80_000]), (4, b"II*\0"), (5, b""), (6, None), (7, b"II*\0\xff\xff\xff\xff" + bytes(50)), (8, tiff("big", b"MM\0*", 8))]
    frame = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "id long, content binary")
    got = {r["id"]: (r["width"], r["height"]) for r in image_dims(frame).select("id", "width", "height").collect()}
    read = (300, 200)
    assert got == {i: read if i in (0, 1, 8) else (None, None) for i in range(9)}
    seen = frame.select(F.length(screen._short_tiff(F.col("content"))).alias("n")).filter("n IS NOT NULL").agg(F.max("n")).first()[0]
    assert seen < 50


def test_hot_item_repeats_are_not_shuffled(spark):
    """Of a million boxes with three shapes only counts are put in order, and every box comes back, beside those of others."""
    kind = F.col("id") % 3
    boxes = spark.range(1_000_000).select(
        F.when(F.col("id") < 10, "few").otherwise("hot").alias("stem"), F.lit("t").alias("text"),
        F.array(F.array(kind.cast("float"), F.lit(2.0).cast("float"))).alias("polygon"), F.lit(0.5).alias("score"),
    )
    items = spark.createDataFrame([("hot", 1), ("hot", 2), ("few", 3), ("bare", 4), (None, 5)], "stem string, n int")
    rows = verify.attach_detections(items, boxes)
    shown = rows.select("stem", "n", "part", "parts", F.size("boxes").alias("size"))
    got = sorted(tuple(r) for r in shown.filter("stem IS NOT NULL").collect())
    hot = [("hot", n, p, 245, min(4096, 999_990 - p * 4096)) for n in (1, 2) for p in range(245)]
    assert got == sorted([("bare", 4, 0, 1, 0), ("few", 3, 0, 1, 10), *hot]) and shown.filter("stem IS NULL").count() == 1
    each = rows.filter("n = 1").select(F.explode("boxes").alias("b")).groupBy(F.expr("b.polygon[0][0]").alias("x")).count().collect()
    assert sorted((r["x"], r["count"]) for r in each) == [(0.0, 333_330), (1.0, 333_330), (2.0, 333_330)]
    # where the rows are made, nothing but counts has been moved: three boxes in as many pieces as they have rows
    assert "_rows" in rows._jdf.queryExecution().optimizedPlan().toString()
