"""File listings and images."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactflow.config import DEFAULTS, Settings
from redactflow.functions.names import basename, extension, glob_match, stem
from redactflow.image.ops import Reader
from redactflow.image.png import decode_png, orientation
from redactflow.session import cut_lineage

FILE_DDL = "path string, modificationTime timestamp, length bigint, content binary"
#: From the bytes of a file to an RGB raster, by lower-cased extension.
Decoders = Mapping[str, Callable[[bytes], np.ndarray]]
#: Extensions of images that the JVM cannot open without a decoder of the caller.
UNREADABLE = (".webp",)


def _load(spark: SparkSession, fmt: str, path: str, recursive: bool, **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def empty_files(files: DataFrame) -> DataFrame:
    """Paths of zero-length files of a ``binaryFile`` scan.

    Spark's scans leave such files out, although the file index it keeps on the driver has them. The names in
    that index are compared with the scan; contents are not touched. The readers leave this out unless asked, as all
    names pass through the driver; for large folders take empty files from the store's own inventory table.
    """
    spark = files.sparkSession
    indexed = spark.createDataFrame([(name,) for name in files.inputFiles()], "value string")
    # the index gives URIs, the scan gives plain paths
    plain = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    as_path = F.regexp_replace(plain, "^file:/+", "file:/").alias("path")
    seen = files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    return indexed.select(as_path).join(seen, "path", "left_anti")


def scan_files(spark: SparkSession, path: str, recursive: bool = False, include_empty: bool = False) -> DataFrame:
    """``path, modificationTime, length, content, stem, ext``. Unselected ``content`` is never read from disk."""
    files = _load(spark, "binaryFile", path, recursive)
    if include_empty:
        empty = empty_files(files).select(
            "path",
            F.lit(None).cast("timestamp").alias("modificationTime"),
            F.lit(0).cast("bigint").alias("length"),
            F.lit(b"").alias("content"),
        )
        files = files.unionByName(empty)
    return files.withColumns({"stem": stem(F.col("path")), "ext": extension(F.col("path"))})


def scan_items(
    spark: SparkSession,
    path: str,
    extensions: Sequence[str] = DEFAULTS.image_extensions,
    include_empty: bool = False,
) -> DataFrame:
    """Files directly in the folder whose lower-cased suffix is listed. Order by ``path`` where output order matters."""
    return scan_files(spark, path, include_empty=include_empty).filter(F.col("ext").isin(*[e.lower() for e in extensions]))


def dataset_profile(files: DataFrame, by: Sequence[str] = ("ext",), size: str = "length") -> DataFrame:
    """File count and bytes per extension (and source)."""
    return files.groupBy(*by).agg(
        F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes")
    )


def list_with_excludes(
    files: DataFrame, path: str = "path", excludes: Sequence[str] = DEFAULTS.ingest_excludes
) -> DataFrame:
    """Listing without originals, thumbnails and videos."""
    return files.filter(~glob_match(basename(F.col(path)), excludes))


def is_image_name(path: Column, extensions: Sequence[str] = DEFAULTS.image_extensions) -> Column:
    return extension(path).isin(*extensions)


def listing_counts(
    files: DataFrame,
    path: str = "path",
    excludes: Sequence[str] = DEFAULTS.ingest_excludes,
    extensions: Sequence[str] = DEFAULTS.image_extensions,
) -> DataFrame:
    """One row ``image_count, files_listed`` over the filtered listing."""
    return list_with_excludes(files, path, excludes).agg(
        F.count_if(is_image_name(F.col(path), extensions)).alias("image_count"), F.count("*").alias("files_listed")
    )


def decode_images(
    spark: SparkSession,
    path: str,
    extensions: Sequence[str] = DEFAULTS.image_extensions,
    include_empty: bool = False,
    facts: bool = True,
    decoders: Decoders | None = None,
) -> DataFrame:
    """``path, stem, height, width, channels, data`` (BGR rows); a file that does not decode keeps its row, with nulls.

    The image source reports unreadable files itself, so the listing is not joined. It does not tell how a picture is
    turned: with ``facts`` the files are read once more, for ``orientation`` and ``source_sha256``, a short row for each
    that is written and joined by path. Where that table is too large to broadcast, the join moves rasters: drain
    ``open_image_stream`` over such folders instead, whose batches are bounded.

    ``decoders`` are functions of the caller from the bytes of a file to an RGB raster, by extension, for formats that
    the JVM does not read (WebP); their files are opened by them alone.
    """
    raw = _load(spark, "image", path, False, dropInvalid="false")
    found = _rasters(raw)
    if decoders:
        own = _load(spark, "binaryFile", path, False).filter(F.lower(extension(F.col("path"))).isin(*decoders))
        found = found.filter(~F.lower(extension(F.col("path"))).isin(*decoders)).unionByName(_plugged(own, decoders))
    if facts:
        files = _load(spark, "binaryFile", path, False).filter(is_image_name(F.col("path"), extensions))
        known = files.select("path", _turn(F.col("content")).alias("orientation"), F.sha2("content", 256).alias("source_sha256"))
        plain = F.regexp_replace("path", "^file:/+", "file:/").alias("_path")
        known = cut_lineage(known.select(plain, "orientation", "source_sha256"), "facts")
        found = found.withColumn("_path", plain).join(known, "_path", "left").drop("_path")
    if include_empty:
        listed = _load(spark, "binaryFile", path, False)  # names only: nothing is decoded for the comparison
        found = found.unionByName(empty_files(listed), allowMissingColumns=True)
    return _image_rows(found, extensions)


def _plugged(files: DataFrame, decoders: Decoders) -> DataFrame:
    """Rasters by the caller's decoders; a file on which its decoder fails has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py()
                try:
                    rgb = np.asarray(decoders["." + name.rsplit(".", 1)[-1].lower()](content.as_py()), np.uint8)
                    one = [*rgb.shape, np.ascontiguousarray(rgb[:, :, ::-1]).tobytes()]
                except Exception:  # a decoder of the caller may raise anything; the file is an unreadable one
                    one = [None] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), *[pa.array([v], pa.int32()) for v in one[:3]], pa.array([one[3]], pa.binary())],
                    ["path", "height", "width", "channels", "data"],
                )

    return files.select("path", "content").mapInArrow(run, "path string, height int, width int, channels int, data binary")


def _rasters(raw: DataFrame) -> DataFrame:
    valid = F.col("image.width") > 0
    return raw.select(
        # the image source gives URIs, other scans give plain paths
        F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B"))).alias("path"),
        F.when(valid, F.col("image.height")).alias("height"),
        F.when(valid, F.col("image.width")).alias("width"),
        F.when(valid, F.col("image.nChannels")).alias("channels"),
        F.when(valid, F.col("image.data")).alias("data"),
    )


def _image_rows(found: DataFrame, extensions: Sequence[str]) -> DataFrame:
    named = found.filter(is_image_name(F.col("path"), extensions))
    more = [c for c in ("orientation", "source_sha256") if c in found.columns]
    return named.select("path", stem(F.col("path")).alias("stem"), "height", "width", "channels", "data", *more)


@F.pandas_udf(T.IntegerType())
def _turn(contents: pd.Series) -> pd.Series:
    return pd.Series([orientation(bytes(c)) for c in contents], dtype="int32")


def screen_folder(
    spark: SparkSession, path: str, settings: Settings = DEFAULTS, include_empty: bool = False, decoders: Decoders | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` image files of a folder, with dimensions and without contents. ``rejected`` (stem, path,
    reject_reason) is what ``run_waves(rejected=...)`` takes. A format that neither the JVM nor one of ``decoders`` can
    open is rejected here, once, instead of failing in every wave."""
    from redactflow.operators.screen import image_dims, screen_items

    seen = image_dims(scan_items(spark, path, settings.image_extensions, include_empty)).drop("content")
    seen = cut_lineage(seen, "screened")
    closed = F.lower(F.col("ext")).isin(*[e for e in UNREADABLE if e not in (decoders or {})])
    accepted, rejected = screen_items(seen.filter(~closed), settings=settings)
    unopened = seen.filter(closed).withColumn("reject_reason", F.concat(F.lit("no_decoder:"), "ext"))
    return accepted, rejected.unionByName(unopened.select(*rejected.columns))


def open_image_stream(
    spark: SparkSession, path: str, max_files: int, extensions: Sequence[str] = DEFAULTS.image_extensions
) -> DataFrame:
    """New images of a folder as a stream ``path, stem, content``; at most ``max_files`` per micro-batch."""
    reader = spark.readStream.format("binaryFile").schema(FILE_DDL).option("maxFilesPerTrigger", str(max_files))
    files = reader.load(path).filter(is_image_name(F.col("path"), extensions))
    return files.select("path", stem(F.col("path")).alias("stem"), "content")


def content_reader(decoders: Decoders | None = None) -> Reader:
    """Makes rasters where the content of a file already is: by the caller's decoders, and of plain PNG files. None for
    a file that the JVM has to open (``decode_batch``); a file on which its decoder fails raises an error."""

    def read(path: str, content: bytes) -> np.ndarray | None:
        decode = (decoders or {}).get("." + path.rsplit(".", 1)[-1].lower())
        if decode is None:
            return decode_png(content)
        try:
            rgb = np.asarray(decode(content), np.uint8)
            height, width, bands = rgb.shape
            if bands not in (1, 3):
                raise ValueError(f"{bands} bands are no RGB raster")
            return np.broadcast_to(rgb, (height, width, 3))
        except Exception as exc:  # a decoder of the caller may raise anything; the file is an unreadable one
            raise ValueError("decode_failed") from exc

    return read


def unopened_files(files: DataFrame, read: Reader) -> DataFrame:
    """What is known of the files (path, stem, content) that ``read`` leaves to the JVM: ``path, stem, orientation,
    source_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                content = row.pop("content")
                try:
                    if read(row["path"], content) is None:
                        left.append(row | {"orientation": orientation(content), "source_sha256": hashlib.sha256(content).hexdigest()})
                except ValueError:  # a decoder of the caller has had it
                    continue
            if left:
                yield pa.RecordBatch.from_pylist(left, schema=known)

    known = pa.schema([("path", pa.string()), ("stem", pa.string()), ("orientation", pa.int32()), ("source_sha256", pa.string())])
    return files.select("path", "stem", "content").mapInArrow(run, "path string, stem string, orientation int, source_sha256 string")


def decode_batch(known: DataFrame) -> DataFrame:
    """Rasters that the JVM makes of the files named in ``known`` (``unopened_files`` of one micro-batch), with its columns.
    Names pass through the driver and short rows are broadcast, as many as the stream's ``max_files``; a raster is not
    moved."""
    spark = known.sparkSession
    known = cut_lineage(known, "known")
    names = [_literal(r["path"]) for r in known.select("path").collect()]
    plain = F.regexp_replace("path", "^file:/+", "file:/").alias("_path")
    if names:
        found = _rasters(spark.read.format("image").option("dropInvalid", "false").load(names))
    else:
        found = spark.createDataFrame([], "path string, height int, width int, channels int, data binary")
    facts = F.broadcast(known.withColumn("_path", plain))
    return found.withColumn("_path", plain).drop("path").join(facts, "_path").drop("_path")


def _literal(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)
