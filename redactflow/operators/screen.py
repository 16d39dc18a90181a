"""Ingest screening: ordered reject reasons, header dimensions, integrity check."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactflow.config import DEFAULTS, Settings
from redactflow.functions.names import sha256_hex

HEAD_BYTES = 65_536


def _over(label: str, value: Column, sign: str, limit: int) -> Column:
    return F.concat(F.lit(f"{label}:"), value.cast("string"), F.lit(f"{sign}{limit}"))


def reject_reason(size: Column, pixels: Column, settings: Settings = DEFAULTS, readable: Column | None = None) -> Column:
    """First matching reason, cheapest test first; null means accepted. ``pixels`` null means unreadable."""
    unreadable = pixels.isNull() if readable is None else pixels.isNull() | ~readable
    return (
        F.when(size > settings.max_bytes, _over("file_too_large", size, ">", settings.max_bytes))
        .when(size == 0, F.lit("empty_file"))
        .when(unreadable, F.lit("corrupted_or_unreadable"))
        .when(pixels > settings.max_pixels, _over("resolution_too_high", pixels, ">", settings.max_pixels))
        .when(pixels < settings.min_pixels, _over("resolution_too_low", pixels, "<", settings.min_pixels))
    )


def screen_items(
    df: DataFrame, size: str = "length", pixels: str = "pixels", settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejected rows carry ``reject_reason`` and are anti-joined from later queues."""
    marked = df.withColumn("reject_reason", reject_reason(F.col(size), F.col(pixels), settings))
    accepted = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, marked.filter(F.col("reject_reason").isNotNull())


def _big_endian(content: Column, pos: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, pos, n)), 16, 10).cast("bigint")


def _little_endian(content: Column, pos: int, n: int) -> Column:
    swapped = F.concat(*[F.hex(F.substring(content, pos + i, 1)) for i in reversed(range(n))])
    return F.conv(swapped, 16, 10).cast("bigint")


def header_dims(content: Column) -> Column:
    """``struct<width, height>`` from PNG, GIF and BMP headers, JVM-side; null for anything else."""
    magic = F.hex(F.substring(content, 1, 8))
    png = magic == "89504E470D0A1A0A"
    gif = magic.startswith("474946383761") | magic.startswith("474946383961")
    bmp = magic.startswith("424D")
    signed = 1 << 32

    def bmp_height() -> Column:
        raw = _little_endian(content, 23, 4)  # negative when rows are stored top-down
        return F.when(raw >= signed // 2, F.lit(signed) - raw).otherwise(raw)

    def dims(w: Column, h: Column) -> Column:
        return F.struct(w.alias("width"), h.alias("height"))

    return (
        F.when(png & (F.length(content) >= 24), dims(_big_endian(content, 17, 4), _big_endian(content, 21, 4)))
        .when(gif & (F.length(content) >= 10), dims(_little_endian(content, 7, 2), _little_endian(content, 9, 2)))
        .when(bmp & (F.length(content) >= 26), dims(_little_endian(content, 19, 4), bmp_height()))
    )


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def _other_dims(heads: pd.Series) -> pd.DataFrame:
    from redactflow.image.headers import dims_of

    found = [dims_of(bytes(h)) if h is not None else None for h in heads]
    return pd.DataFrame(
        {
            "width": pd.array([d[0] if d else None for d in found], dtype="Int64"),
            "height": pd.array([d[1] if d else None for d in found], dtype="Int64"),
        }
    )


_other_dims = _other_dims.asNondeterministic()  # so that a filter on the result does not run it a second time


def _short_tiff(content: Column) -> Column:
    """A TIFF of its head and first directory only, wherever that stands; null for anything else. Its dimensions are those
    of the whole file."""
    start = F.hex(F.substring(content, 1, 4))
    little = start == "49492A00"
    big = start == "4D4D002A"
    at = F.when(little, _little_endian(content, 5, 4)).when(big, _big_endian(content, 5, 4))
    place = F.when(at < F.length(content), at).cast("int") + 1
    count = F.hex(F.substring(content, place, F.lit(2)))
    swapped = F.concat(F.substring(count, 3, 2), F.substring(count, 1, 2))
    entries = F.conv(F.when(little, swapped).otherwise(count), 16, 10).cast("int")
    head = F.when(little, F.unhex(F.lit("49492A0008000000"))).otherwise(F.unhex(F.lit("4D4D002A00000008")))
    whole = F.concat(head, F.substring(content, place, 2 + 12 * entries))
    return F.when(little | big, F.coalesce(whole, F.substring(content, 1, 4)))


def image_dims(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``width``, ``height``, ``pixels`` (null when unreadable).

    PNG/GIF/BMP need no Python. JPEG, WebP and TIFF headers are read by an Arrow UDF. Of a TIFF, whose directory may
    stand behind the pixels, it sees the directory alone; of others at most the first 64 KiB, with the whole content as
    second try for a JPEG whose metadata is longer than that. What it needs is cut out below a generator, so that
    contents do not wait beside it for its answers unless the caller asks for them.
    """
    body = F.col(content)
    known = header_dims(body)
    tiff = _short_tiff(body)
    other = known.isNull() & (F.length(body) > 0)
    head = F.when(other, F.coalesce(tiff, F.substring(body, 1, HEAD_BYTES)))
    longer = F.when(other & F.hex(F.substring(body, 1, 2)).eqNullSafe("FFD8") & (F.length(body) > HEAD_BYTES), body)
    parts = F.struct(known.alias("_dims"), head.alias("_head"), longer.alias("_long"))
    cut = df.select(*[F.col(c) for c in df.columns], F.inline(F.array(parts)))
    once = cut.withColumn("_more", _other_dims("_head"))
    retry = F.when(F.col("_more.width").isNull(), F.col("_long"))
    twice = once.withColumn("_rest", _other_dims(retry))
    out = twice.withColumns(
        {
            "width": F.coalesce("_dims.width", "_more.width", "_rest.width"),
            "height": F.coalesce("_dims.height", "_more.height", "_rest.height"),
        }
    )
    return out.withColumn("pixels", F.col("width") * F.col("height")).drop("_dims", "_head", "_long", "_more", "_rest")


def verify_integrity(items: DataFrame, decodable: Column, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Read-only check of the queue: ``(per_item, summary)``.

    ``decodable`` says whether the bytes decode. The summary is one row ``checked, verified, corrupt, ok,
    problems``; ``problems`` shows the first ``limit`` by name, found by a top-n before anything is collected.
    """
    error = F.when(F.col("content").isNull(), F.lit("missing_or_not_a_file")).when(
        ~F.coalesce(decodable, F.lit(False)), F.lit("undecodable")
    )
    per_item = items.select("path", sha256_hex(F.col("content")).alias("sha256"), error.alias("error"))
    return per_item, integrity_summary(per_item, limit)


def integrity_summary(per_item: DataFrame, limit: int = 50) -> DataFrame:
    worst = per_item.filter(F.col("error").isNotNull()).orderBy("path", "error").limit(limit)
    problems = worst.agg(F.sort_array(F.collect_list(F.struct("path", "error"))).alias("problems"))
    totals = per_item.agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("error").isNull()).alias("verified"),
        F.count_if(F.col("error").isNotNull()).alias("corrupt"),
    )
    return totals.withColumns({"ok": F.col("corrupt") == 0, "problems": problems.scalar()})
