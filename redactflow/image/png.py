"""PNG bytes to and from uint8 rasters (height, width, 3 RGB), and metadata removal at byte level."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Ancillary PNG chunks that carry descriptions, and the JPEG application segments that carry pixels' meaning.
PNG_METADATA = (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME")
JPEG_KEEP = (0xE0, 0xE2, 0xEE)  # JFIF, colour profile, Adobe colour transform


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(rgb: np.ndarray) -> bytes:
    """Metadata-free PNG."""
    height, width = rgb.shape[:2]
    rows = np.zeros((height, 1 + width * 3), dtype=np.uint8)
    rows[:, 1:] = np.ascontiguousarray(rgb, dtype=np.uint8).reshape(height, width * 3)
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(content: bytes) -> np.ndarray | None:
    """Raster of a PNG as simple as ``encode_png`` makes it: 8-bit RGB without interlace or colour notes, whose rows are
    kept as they are or as differences from the left or from above. None for every other file, be it whole or not."""
    head, at, packed, end = None, 8, [], False
    while content[:8] == SIGNATURE and not end and at + 12 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body, crc = content[at + 8 : at + 8 + size], content[at + 8 + size : at + 12 + size]
        if kind not in (b"IHDR", b"IDAT", b"IEND", b"pHYs", *PNG_METADATA) or crc != struct.pack(">I", zlib.crc32(kind + body)):
            return None
        if kind == b"IHDR" and size == 13 and not head:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        end, at = kind == b"IEND", at + 12 + size
    if not end or not head or head[2:] != (8, 2, 0, 0, 0):
        return None
    width, height = head[:2]
    inflate = zlib.decompressobj()
    try:
        flat = inflate.decompress(b"".join(packed), height * (1 + width * 3) + 1)
    except zlib.error:
        return None
    if not inflate.eof or not flat or len(flat) != height * (1 + width * 3):
        return None
    lines = np.frombuffer(flat, np.uint8).reshape(height, 1 + width * 3)
    kinds, rows = lines[:, 0], lines[:, 1:].reshape(height, width, 3)
    if not kinds.any():
        return rows
    if kinds.max() > 2:
        return None
    rows = rows.copy()
    for y in np.flatnonzero(kinds):
        if kinds[y] == 1:
            rows[y] = np.cumsum(rows[y], axis=0, dtype=np.uint8)
        elif y:
            rows[y] += rows[y - 1]
    return rows


def insert_text_chunk(png: bytes, key: str, text: str) -> bytes:
    """The same image with a text note after its header."""
    body = key.encode("latin-1") + b"\0" + text.encode("latin-1", "replace")
    at = len(SIGNATURE) + 25
    return png[:at] + _chunk(b"tEXt", body) + png[at:]


def with_orientation(png: bytes, turn: int) -> bytes:
    """The same file with an EXIF note of how it is to be turned."""
    tiff = b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)
    at = len(SIGNATURE) + 25
    return png[:at] + _chunk(b"eXIf", tiff) + png[at:]


def strip_metadata(content: bytes) -> tuple[bytes | None, str]:
    """``(bytes, method)``; pixels are untouched. Formats other than PNG and JPEG give ``(None, "unsupported")``."""
    if content[:8] == SIGNATURE:
        return _strip_png(content), "chunks_dropped"
    if content[:2] == b"\xff\xd8":
        return _strip_jpeg(content), "segments_dropped"
    return None, "unsupported"


def _strip_png(content: bytes) -> bytes:
    kept, at = [SIGNATURE], 8
    while at + 12 <= len(content):
        size = struct.unpack(">I", content[at : at + 4])[0] + 12
        if content[at + 4 : at + 8] not in PNG_METADATA:
            kept.append(content[at : at + size])
        if content[at + 4 : at + 8] == b"IEND":
            break  # bytes after the image are dropped
        at += size
    return b"".join(kept)


def _strip_jpeg(content: bytes) -> bytes:
    kept, at = [content[:2]], 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:  # scan data runs to the end
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            kept.append(content[at : at + 2])
            at += 2
            continue
        size = 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
        descriptive = marker == 0xFE or (0xE0 <= marker <= 0xEF and marker not in JPEG_KEEP)
        if not descriptive:
            kept.append(content[at : at + size])
        at += size
    return b"".join(kept) + content[at:]


def orientation(content: bytes) -> int:
    """EXIF orientation 1..8 of a JPEG or PNG; 1 when there is none."""
    if content[:8] == SIGNATURE:
        at = 8
        while at + 8 <= len(content):
            size = struct.unpack(">I", content[at : at + 4])[0]
            if content[at + 4 : at + 8] == b"eXIf":
                return _tiff_orientation(content[at + 8 : at + 8 + size])
            at += 12 + size
        return 1
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return _tiff_orientation(body[6:])
        at += 2 + size
    return 1


def _tiff_orientation(tiff: bytes) -> int:
    try:
        end = "<" if tiff[:2] == b"II" else ">"
        first = struct.unpack(end + "I", tiff[4:8])[0]
        for i in range(struct.unpack(end + "H", tiff[first : first + 2])[0]):
            entry = tiff[first + 2 + 12 * i : first + 14 + 12 * i]
            if struct.unpack(end + "H", entry[:2])[0] == 0x0112:
                value = struct.unpack(end + "H", entry[8:10])[0]
                return value if 1 <= value <= 8 else 1
    except (struct.error, IndexError):
        pass
    return 1


def upright(rgb: np.ndarray, turn: int) -> np.ndarray:
    """Raster turned as its EXIF orientation asks."""
    if turn in (5, 6, 7, 8):
        rgb = rgb.transpose(1, 0, 2)
    flip_rows = {3, 4, 7, 8}
    flip_cols = {2, 3, 6, 7}
    rgb = rgb[::-1] if turn in flip_rows else rgb
    return rgb[:, ::-1] if turn in flip_cols else rgb
