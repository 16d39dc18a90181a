"""Small fixtures: rasters, PNG files, lookups."""

import os

import numpy as np

from redactflow.image.png import encode_png


def flat(height, width, level=120):
    return np.full((height, width, 3), level, dtype=np.uint8)


def sign(height=400, width=640, seed=0):
    """Dark noise with two bright bands."""
    rgb = np.random.default_rng(seed).integers(20, 90, size=(height, width, 3)).astype(np.uint8)
    rgb[40:91, 20:621] = 240
    rgb[300:351, 20:621] = 240
    return rgb


BANDS = [
    {"polygon": [[20, 40], [620, 40], [620, 90], [20, 90]], "text": "SSN 123-45-6789", "score": 0.97},
    {"polygon": [[20, 300], [620, 300], [620, 350], [20, 350]], "text": "PLATE 7XKD221", "score": 0.91},
]


def write_png(path, rgb):
    write_bytes(path, encode_png(rgb))


def write_bytes(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)


def by(rows, key):
    return {r[key]: r for r in rows}


def bright_bands(rgb):
    """Detector: rows that are mostly pure 240."""
    rows = np.nonzero((rgb == 240).all(axis=2).mean(axis=1) > 0.5)[0]
    if not len(rows):
        return []
    groups = np.split(rows, np.nonzero(np.diff(rows) > 1)[0] + 1)
    return [
        {"polygon": [[20, g[0]], [620, g[0]], [620, g[-1]], [20, g[-1]]], "text": "band", "score": 0.96} for g in groups
    ]
