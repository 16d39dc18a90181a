"""Queries over listings: profile, excludes, screening, retention, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.config import Settings
from redactflow.functions.messages import error_class, is_compute_error, is_transient
from redactflow.functions.names import basename, extension, glob_match, human_size, sha256_hex, stem
from redactflow.operators import retention as K
from redactflow.operators.screen import image_dims, integrity_summary, reject_reason, screen_items
from redactflow.plans.registry import query
from redactflow.plans.views import Tables
from redactflow.sources.files import dataset_profile, list_with_excludes, listing_counts
from redactflow.sources.records import events_from_text

_EXT = "lower(regexp_extract(rel_path, '[^.]([.][^.]+)$', 1))"
_STEM = "regexp_replace(rel_path, '([^.])[.][^.]+$', '\\1')"
_EXCLUDED = "(rel_path LIKE 'orig\\_%' ESCAPE '\\' OR rel_path LIKE 'thumb\\_%' ESCAPE '\\' OR rel_path LIKE '%.mp4')"


@query(
    f"SELECT {_EXT} AS ext, source, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files GROUP BY 1, 2",
    "files",
)
def dataset_profile_by_source(t: Tables) -> DataFrame:
    listed = t.files.withColumn("ext", extension(F.col("rel_path")))
    return dataset_profile(listed, ("ext", "source"), "size_bytes")


@query(f"SELECT root, rel_path FROM files WHERE NOT {_EXCLUDED}", "files")
def list_without_excludes(t: Tables) -> DataFrame:
    return list_with_excludes(t.files, "rel_path").select("root", "rel_path")


@query(
    f"""SELECT count(*) FILTER ({_EXT} IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tif', '.tiff')) AS image_count,
    count(*) AS files_listed FROM files WHERE NOT {_EXCLUDED}""",
    "files",
)
def count_listed_images(t: Tables) -> DataFrame:
    return listing_counts(t.files, "rel_path")


@query(f"SELECT rel_path, {_STEM} AS stem, {_EXT} AS ext FROM files", "files")
def name_parts(t: Tables) -> DataFrame:
    shown = F.concat(F.col("root"), F.lit("\\"), F.col("rel_path"))
    return t.files.select("rel_path", stem(shown).alias("stem"), extension(shown).alias("ext"))


@query(
    "SELECT rel_path, rel_path LIKE 'perf\\_%' ESCAPE '\\' OR rel_path LIKE '%.json' AS matched FROM files", "files"
)
def glob_matches(t: Tables) -> DataFrame:
    return t.files.select("rel_path", glob_match(basename(F.col("rel_path")), ["perf_*", "*.json"]).alias("matched"))


_PLAN = f"""SELECT root, rel_path, size_bytes,
    CASE WHEN test THEN TRUE WHEN root = 'temp_processed' THEN TRUE ELSE FALSE END AS "delete",
    CASE WHEN test THEN 'test_name_marker'
      WHEN root = 'temp_processed' THEN 'temp_root_loose_file'
      WHEN root = 'final_clean' AND ext IN ('.jpg', '.png', '.tiff') THEN 'preserve:production_media'
      WHEN root = 'final_clean' AND ext = '.json' THEN 'preserve:metadata_sidecar'
      ELSE 'preserve:unknown_conservative' END AS reason
    FROM (SELECT *, {_EXT} AS ext,
      rel_path LIKE 'test\\_%' ESCAPE '\\' OR rel_path LIKE 'perf\\_%' ESCAPE '\\' AS test FROM files)"""


@query(_PLAN, "files")
def retention_plan(t: Tables) -> DataFrame:
    return K.retention_plan(t.files).select("root", "rel_path", "size_bytes", "delete", "reason")


@query(
    f"""SELECT root, count(*) AS files, 0::BIGINT AS dirs, CAST(sum(size_bytes) AS BIGINT) AS bytes
    FROM ({_PLAN}) WHERE "delete" GROUP BY ROLLUP (root)""",
    "files",
)
def retention_rollup(t: Tables) -> DataFrame:
    return K.retention_rollup(K.retention_plan(t.files))


@query("SELECT rel_path FROM files WHERE rel_path NOT LIKE 'perf\\_%' ESCAPE '\\'", "files")
def drop_test_rows(t: Tables) -> DataFrame:
    return K.drop_test_rows(t.files, "rel_path")[0].select("rel_path")


@query(
    """SELECT count(*) FILTER (rel_path LIKE 'perf\\_%' ESCAPE '\\') AS removed,
    count(*) FILTER (rel_path NOT LIKE 'perf\\_%' ESCAPE '\\') AS kept FROM files""",
    "files",
)
def drop_test_rows_report(t: Tables) -> DataFrame:
    return K.drop_test_rows(t.files, "rel_path")[1]


_SCREEN = Settings(max_bytes=5000, min_pixels=100, max_pixels=4000)


@query(
    """SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'file_too_large:' || n_chars || '>5000'
    WHEN n_chars = 0 THEN 'empty_file' WHEN n_chars > 4000 THEN 'resolution_too_high:' || n_chars || '>4000'
    WHEN n_chars < 100 THEN 'resolution_too_low:' || n_chars || '<100' END AS reject_reason FROM documents"""
)
def screen_reasons(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", reject_reason(F.col("n_chars"), F.col("n_chars"), _SCREEN).alias("reject_reason"))


_SIZE = """CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN printf('%.2f KiB', {n} / 1024.0)
    WHEN {n} < 1073741824 THEN printf('%.2f MiB', {n} / 1048576.0) ELSE printf('%.2f GiB', {n} / 1073741824.0) END"""


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 100 AND 4000")
def screened_items(t: Tables) -> DataFrame:
    items = t.documents.select("doc_id", F.col("n_chars").alias("length"), F.col("n_chars").alias("pixels"))
    return screen_items(items, settings=_SCREEN)[0].select("doc_id")


@query(
    f"""SELECT doc_id, {_SIZE.format(n='n_chars')} AS shown, {_SIZE.format(n='big')} AS shown_big
    FROM (SELECT doc_id, n_chars, n_chars * 262144 AS big FROM documents)"""
)
def human_sizes(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", human_size(F.col("n_chars")).alias("shown"), human_size(F.col("n_chars") * 262144).alias("shown_big")
    )


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sha256_hex(F.col("text")).alias("sha256"))


_MESSAGE = """CASE event_type WHEN 'error' THEN 'HTTP 503 Service Unavailable' WHEN 'click' THEN 'dial tcp: i/o Timeout'
    WHEN 'purchase' THEN 'Too Many Requests, slow down' WHEN 'signup' THEN 'CUDA Out of Memory on device' ELSE 'ok' END"""


@query(
    f"""SELECT event_id, CASE WHEN m LIKE 'Too%' THEN 'rate_limit' WHEN m LIKE 'HTTP%' THEN 'service_unavailable'
    WHEN m LIKE 'dial%' THEN 'timeout' ELSE 'unknown' END AS error_class,
    m LIKE 'Too%' OR m LIKE 'HTTP%' OR m LIKE 'dial%' AS transient, m LIKE 'CUDA%' AS compute
    FROM (SELECT event_id, {_MESSAGE} AS m FROM events)"""
)
def message_classes(t: Tables) -> DataFrame:
    texts = {
        "error": "HTTP 503 Service Unavailable", "click": "dial tcp: i/o Timeout",
        "purchase": "Too Many Requests, slow down", "signup": "CUDA Out of Memory on device",
    }
    message = F.lit("ok")
    for kind, text in texts.items():
        message = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(message)
    return t.events.select(
        "event_id", error_class(message).alias("error_class"), is_transient(message).alias("transient"),
        is_compute_error(message).alias("compute"),
    )


@query(
    """SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, event_type AS type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view'"""
)
def events_from_json_lines(t: Tables) -> DataFrame:
    """Events written as JSON lines, views as broken lines, and read back."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(stamp.alias("ts"), F.col("event_type").alias("type"), F.col("props")))
    broken = F.substring(line, 1, 20)
    lines = t.events.select(F.when(F.col("event_type") == "view", broken).otherwise(line).alias("value"))
    back = events_from_text(lines)
    k = F.get_json_object(F.try_variant_get("payload", "$.props", "string"), "$.k").cast("bigint")
    return back.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "type", k.alias("k"))


@query(
    """SELECT doc_id, n_chars AS width, length(source) + 60 AS height, n_chars * (length(source) + 60) AS pixels
    FROM documents"""
)
def image_dims_by_format(t: Tables) -> DataFrame:
    """Headers in four formats with known dimensions: PNG, GIF, BMP and JPEG by language. GIF and JPEG hold 16 bits of a
    width, so what is wider is a PNG in every language."""
    w, h = F.col("n_chars"), F.length("source") + 60

    def big(value, n: int):
        return F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")

    def little(value, n: int):
        padded = big(value, n)
        return F.concat(*[F.substring(padded, 2 * (n - i) - 1, 2) for i in range(n)])

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("F70000"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), little(w, 4), little(h, 4), F.lit("01001800"))
    jpeg = F.concat(F.lit("FFD8FFE000044A46FFC0001108"), big(h, 2), big(w, 2), F.lit("03011100"))
    head = F.when((F.col("lang") == "en") | (w > 0xFFFF), png).when(F.col("lang") == "fr", gif).when(F.col("lang") == "de", bmp)
    items = t.documents.select("doc_id", F.unhex(head.otherwise(jpeg)).alias("content"))
    return image_dims(items).select("doc_id", "width", "height", "pixels")


@query(
    """SELECT count(*) AS checked, count(*) FILTER (n_chars >= 100) AS verified, count(*) FILTER (n_chars < 100) AS corrupt,
    count(*) FILTER (n_chars < 100) = 0 AS ok,
    (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT CAST(doc_id AS VARCHAR) AS p FROM documents WHERE n_chars < 100
      ORDER BY p LIMIT 50)) AS problems FROM documents"""
)
def integrity_report(t: Tables) -> DataFrame:
    error = F.when(F.col("n_chars") < 100, F.lit("undecodable"))
    checked = t.documents.select(F.col("doc_id").cast("string").alias("path"), error.alias("error"))
    paths = F.array_join(F.transform("problems", lambda p: p.getField("path")), ",")
    return integrity_summary(checked).withColumn("problems", paths)
