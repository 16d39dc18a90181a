"""Width and height from JPEG, WebP and TIFF header bytes."""

from __future__ import annotations

import struct

# JPEG frame markers that carry dimensions.
_SOF = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def dims_of(head: bytes) -> tuple[int, int] | None:
    try:
        if head[:2] == b"\xff\xd8":
            return _jpeg(head)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(head)
        if head[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(head)
    except (IndexError, struct.error):
        return None
    return None


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in _SOF:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + ((bits >> 14) & 0x3FFF)
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    return None


def _tiff(data: bytes) -> tuple[int, int] | None:
    end = "<" if data[:2] == b"II" else ">"
    first = struct.unpack(end + "I", data[4:8])[0]
    found: dict[int, int] = {}
    for i in range(struct.unpack(end + "H", data[first : first + 2])[0]):
        entry = data[first + 2 + 12 * i : first + 14 + 12 * i]
        tag, kind = struct.unpack(end + "HH", entry[:4])
        if tag in (256, 257):
            found[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (found[256], found[257]) if len(found) == 2 else None
