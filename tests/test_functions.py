import datetime as dt
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from redactflow import functions as fn
from redactflow.functions.secrets import redact_json, redact_struct, sanitize_for_export
from redactflow.functions.times import is_stale


def one(spark, column, **values):
    frame = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def column_values(spark, values, build, dtype="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["x"] for r in frame.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    paths = ["a/b/img.001.JPG", "c:\\x\\y.png", "noext", ".gitkeep", "dir/.hidden.txt", "s3://b/k/z.tiff"]
    assert column_values(spark, paths, fn.stem) == ["img.001", "y", "noext", ".gitkeep", ".hidden", "z"]
    assert column_values(spark, paths, fn.extension) == [".jpg", ".png", "", "", ".txt", ".tiff"]
    assert column_values(spark, paths, fn.basename)[1] == "y.png"


def test_glob_match(spark):
    names = ["orig_1.jpg", "x_orig_.jpg", "clip.mp4", "a.b", "c1.txt", "cx.txt"]
    globs = ["orig_*", "*.mp4", "?.b", "c[0-9].txt"]
    assert column_values(spark, names, lambda c: fn.glob_match(c, globs)) == [True, False, True, True, True, False]
    assert column_values(spark, names, lambda c: fn.glob_match(c, []))[0] is False
    assert column_values(spark, ["c1.txt", "cx.txt"], lambda c: fn.glob_match(c, ["c[!0-9].txt"])) == [False, True]


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1152, 1024**2, 5 * 1024**3]
    assert column_values(spark, sizes, fn.human_size, "bigint") == [
        "0 B", "1023 B", "1.00 KiB", "1.12 KiB", "1.00 MiB", "5.00 GiB",
    ]


def test_redact_secrets(spark):
    texts = [
        "api_key=abc rest", "Password :  hunter2!", "no secrets", "b2_write_key: k1 token=t2", "literal LONGSECRET here", None,
    ]
    got = column_values(spark, texts, lambda c: fn.redact_secrets(c, ["LONGSECRET", "here"]))
    assert got == [
        "api_key=***REDACTED*** rest",
        "Password=***REDACTED***",
        "no secrets",
        "b2_write_key=***REDACTED*** token=***REDACTED***",
        "literal ***REDACTED*** here",  # literals of four characters or fewer stay
        None,
    ]


def test_redact_secrets_unicode_blanks(spark):
    text = ["token\u00a0=\u00a0abc"]
    assert column_values(spark, text, lambda c: fn.redact_secrets(c)) == text
    assert column_values(spark, text, lambda c: fn.redact_secrets(c, unicode=True)) == ["token=***REDACTED***"]


def test_redact_struct_walks_everything(spark):
    row = Row(
        name="x", client_secret="s", note="password: p",
        nested=Row(api_key_id="k", deep=Row(msg="token=1", n=3)),
        items=[Row(text="secret=9", private_key="pk")],
        extra={"MyToken": "v", "plain": "authorization: z", "n": "ok"},
    )
    out = redact_struct(spark.createDataFrame([row])).first()
    red = "***REDACTED***"
    assert (out["name"], out["client_secret"], out["note"]) == ("x", red, f"password={red}")
    assert out["nested"]["api_key_id"] == red and out["nested"]["deep"]["msg"] == f"token={red}"
    assert out["nested"]["deep"]["n"] == 3
    assert out["items"][0]["text"] == f"secret={red}" and out["items"][0]["private_key"] == red
    assert out["extra"] == {"MyToken": red, "plain": f"authorization={red}", "n": "ok"}


def test_redact_variant_payload(spark):
    frame = spark.sql("""SELECT parse_json('{"api_token": "abc", "n": 1, "note": "password: x y", "ok": "fine",
        "in": {"secret": {"a": "b"}}}') AS payload""")
    out = redact_struct(frame).select(F.to_json("payload").alias("j")).first()["j"]
    assert "abc" not in out and '"b"' not in out and ": x" not in out and "fine" in out and '"n":1' in out


def test_redact_json_keeps_bad_text_readable(spark):
    got = column_values(spark, ['{"token": "a", "k": 1}', "broken password=q"], lambda c: redact_json(c, "token string, k int"))
    assert got == ['{"token":"***REDACTED***","k":1}', "broken password=***REDACTED***"]


def test_sanitize_for_export_drops_internal_paths(spark):
    out = sanitize_for_export(spark.createDataFrame([Row(stem="a", decode_path="/tmp/x", note="secret=1")]))
    assert out.columns == ["stem", "note"] and out.first()["note"] == "secret=***REDACTED***"


def test_error_class_first_match_wins(spark):
    messages = [
        "429 then 503", "503", "HTTP 502", "Connection Reset by peer", "i/o TIMEOUT", "b2 upload error", "weird", None,
    ]
    assert column_values(spark, messages, fn.error_class) == [
        "rate_limit", "service_unavailable", "gateway_error", "connection", "timeout", "b2_upload", "unknown", "unknown",
    ]
    assert column_values(spark, messages, fn.is_transient) == [True, True, True, True, True, False, False, False]


def test_parse_check_mismatch(spark):
    lines = [
        "ERROR : a/b.jpg: hash mismatch",
        "2 differences found",
        "ERROR: ERROR : c.png: sizes differ",
        "Failed to check x",
        "d.jpg differ on target",
        "e.jpg: hash mismatch",
        "12: hash mismatch here",
        "0 differ",
        "7 differ",
        "all fine",
        "ERROR couldn't open",
        "",
    ]
    got = column_values(spark, lines, fn.parse_check_mismatch)
    assert got == ["a/b.jpg", None, "c.png", None, "d.jpg", "e.jpg:", "12:", None, None, None, None, None]


def test_is_compute_error(spark):
    assert column_values(spark, ["CUDA error", "no DLL found", "C10::Error", "disk full", None], fn.is_compute_error) == [
        True, True, True, False, False,
    ]


def test_adaptive_batch_size(spark):
    assert column_values(spark, [0, 999, 1000, 4999, 5000], fn.adaptive_batch_size, "bigint") == [32, 32, 48, 48, 64]


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = frame.select(fn.cosine_similarity(F.col("a"), F.col("b")).alias("s"), fn.l2_normalize(F.col("a")).alias("u")).collect()
    assert got[0]["s"] == pytest.approx(0.96, abs=1e-6) and got[0]["u"] == pytest.approx([0.6, 0.8], abs=1e-6)
    assert got[1]["s"] == pytest.approx(0.0) and got[2]["s"] is None


def test_times(spark):
    now = F.to_timestamp(F.lit("2024-01-01 02:00:00"))
    texts = ["2024-01-01T01:30:00Z", "2024-01-01T00:00:00+00:00", "nonsense", None]
    assert column_values(spark, texts, lambda c: fn.age_seconds(fn.parse_iso_ts(c), now)) == [1800, 7200, None, None]
    assert column_values(spark, texts, lambda c: is_stale(c, now, 3600)) == [False, True, True, True]
    edge = ["2024-01-01T01:00:00Z", "2024-01-01T00:59:59.999Z"]
    assert column_values(spark, edge, lambda c: is_stale(c, now, 3600)) == [False, True]


def test_normalize_boxes(spark):
    raw = [
        '[[[[0,0],[1,0],[1,1],[0,1]], ["hi", 0.9]], [[[5,5],[6,6]], ["lo", "0.5"]], "junk", [[[1,2]], ["no score"]]]',
        '[[[[[0,0],[1,0]], ["wrapped", 0.7]]]]',
        '[{"polygon": [[1,2],[3,4]], "text": "d", "score": 0.3}, {"text": "no polygon"}, {"polygon": [[1,1]]}]',
        "not json",
        "[]",
        "null",
    ]
    got = column_values(spark, raw, fn.normalize_boxes)
    assert [b["text"] for b in got[0]] == ["hi", "lo"] and got[0][1]["score"] == 0.5
    assert got[0][0]["polygon"] == [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    assert [b["text"] for b in got[1]] == ["wrapped"]
    assert [(b["text"], b["score"]) for b in got[2]] == [("d", 0.3), ("", 0.0)]
    assert got[3:] == [[], [], []]


def test_box_scores(spark):
    frame = spark.createDataFrame(
        [([([[0.0]], "a", 0.4), ([[0.0]], "b", 0.9)],), ([],), (None,)],
        "boxes array<struct<polygon:array<array<float>>,text:string,score:double>>",
    )
    rows = frame.select(fn.max_score(F.col("boxes")).alias("m"), fn.box_count(F.col("boxes")).alias("n")).collect()
    assert [(r["m"], r["n"]) for r in rows] == [(0.9, 2), (0.0, 0), (0.0, 0)]


def test_progress(spark):
    values = [3723.9, 123.0, 3.2, 0.0, -5.0, None, math.inf, math.nan]
    assert column_values(spark, values, fn.format_eta, "double") == ["1h 2m", "2m 3s", "3s", "0s", "0s", "—", "—", "—"]
    assert one(spark, fn.progress_pct(F.lit(50), F.lit(300))) == 16.67
    assert one(spark, fn.progress_pct(F.lit(5), F.lit(0))) == 100.0
    assert one(spark, fn.progress_pct(F.lit(0), F.lit(0))) == 0.0
    assert column_values(spark, [0, 1, 64, 65], lambda c: fn.total_batches(c, F.lit(64)), "bigint") == [1, 1, 1, 2]


def test_recommendations(spark):
    def texts(a, q, p, c=None):
        return one(spark, fn.recommendations(F.lit(a), F.lit(q), F.lit(p), None if c is None else F.lit(c)))

    assert texts(2.0, 0.0, 1.0) == ["Metrics within expected bounds."]
    slow = texts(4.5, 0.10, 0.5, 0.2)
    assert len(slow) == 4 and slow[0].startswith("Average 4.50s/item") and "10.0%" in slow[1] and "50.0%" in slow[2]
    assert len(texts(0.5, 0.0, 1.0, 0.9)) == 2
