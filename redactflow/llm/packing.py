"""Sorted integers as bytes, for shuffles of whole arrays."""

from __future__ import annotations

import numpy as np


def plain(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned integers in as few bytes each as the largest needs, and that number of bytes."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def wide(width: int, blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """Ascending unsigned integers by their differences."""
    return plain(np.diff(values, prepend=np.uint64(0)))


def unpacked(width: int, blob: bytes) -> np.ndarray:
    return np.cumsum(wide(width, blob), dtype=np.uint64)
