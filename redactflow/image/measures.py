"""Image QA measures on rasters: structural similarity and edge density in masked areas."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from redactflow.image.raster import around, boxes_to_mask, dilate

WINDOW = 7
LONGEST = 512


def to_gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2])


def _cells(values: np.ndarray, size: int) -> np.ndarray:
    """Means of ``size`` equal cells along the first axis, from running sums that are cut inside a row where a cell is."""
    n = values.shape[0]
    sums = np.zeros((n + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, dtype=np.float64, out=sums[1:])
    at = np.linspace(0, n, size + 1)
    whole = np.minimum(at.astype(np.int64), n - 1)
    part = (at - whole).reshape(-1, *[1] * (values.ndim - 1))
    upto = sums[whole] + part * (sums[whole + 1] - sums[whole])
    return np.diff(upto, axis=0) * (size / n)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-average resize of a 2-d or 3-d raster."""
    return _cells(_cells(image, height).swapaxes(0, 1), width).swapaxes(0, 1)


def _small_gray(rgb: np.ndarray) -> np.ndarray:
    gray = to_gray(rgb)
    height, width = gray.shape
    longest = max(height, width)
    if longest > LONGEST:
        scale = LONGEST / longest
        gray = np.rint(resize_area(gray, max(1, int(height * scale)), max(1, int(width * scale))))
    return gray


def _window_mean(values: np.ndarray) -> np.ndarray:
    height, width = values.shape
    sums = np.zeros((height + 1, width + 1), order="F" if values.flags.fnc else "C")
    sums[1:, 1:] = values.cumsum(axis=0).cumsum(axis=1)
    box = sums[WINDOW:, WINDOW:] - sums[:-WINDOW, WINDOW:] - sums[WINDOW:, :-WINDOW] + sums[:-WINDOW, :-WINDOW]
    return box / (WINDOW * WINDOW)


def ssim(original: np.ndarray, output: np.ndarray) -> float | None:
    """Mean structural similarity of the gray rasters, 7x7 window, sample covariance; None under 7 pixels."""
    a, b = _small_gray(original), _small_gray(output)
    if a.shape != b.shape:
        b = np.rint(resize_area(b, *a.shape))
    if min(a.shape) < WINDOW:
        return None
    n = WINDOW * WINDOW
    sample = n / (n - 1)
    mean_a, mean_b = _window_mean(a), _window_mean(b)
    var_a = sample * (_window_mean(a * a) - mean_a**2)
    var_b = sample * (_window_mean(b * b) - mean_b**2)
    cov = sample * (_window_mean(a * b) - mean_a * mean_b)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    top = (2 * mean_a * mean_b + c1) * (2 * cov + c2)
    return float((top / ((mean_a**2 + mean_b**2 + c1) * (var_a + var_b + c2))).mean())


#: tan(22.5 degrees): between the sectors of a gradient's direction. No ratio of whole numbers equals it.
_SECTOR = np.sqrt(2) - 1
#: How far around the widened mask edges are looked at first.
MARGIN = 16


def _thin(gray: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Weak and strong pixels: gradient (L1) of whole gray levels, thinned across its direction."""
    p = np.pad(gray.astype(np.int16), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    cols = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = rows[:, 2:] - rows[:, :-2], cols[2:] - cols[:-2]
    across, down = np.abs(gx), np.abs(gy)
    size = across + down
    padded = np.pad(size, 1)
    height, width = size.shape

    def higher(dy: int, dx: int) -> np.ndarray:
        """Above the neighbour on one side, not below that on the other."""
        before = padded[1 - dy : 1 - dy + height, 1 - dx : 1 - dx + width]
        after = padded[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width]
        return (size > before) & (size >= after)

    flat, steep = down < _SECTOR * across.astype(np.float32), across < _SECTOR * down.astype(np.float32)
    falling = (gx > 0) == (gy > 0)
    slant = np.where(falling, higher(1, 1), higher(1, -1))
    keep = np.where(flat, higher(0, 1), np.where(steep, higher(1, 0), slant)) & (size > low)
    return keep, keep & (size > high)


def _run_labels(starts: np.ndarray, ends: np.ndarray, stride: int) -> np.ndarray:
    """The component of each run of pixels, runs of neighbouring rows being joined where they touch (corners too)."""
    first = np.searchsorted(ends, starts + stride - 1)
    count = np.maximum(np.searchsorted(starts, ends + stride + 1, "right") - first, 0)
    a = np.repeat(np.arange(len(starts)), count)
    b = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    label = np.arange(len(starts))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def _grown(weak: np.ndarray, strong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weak pixels connected with strong ones, and those that are not but reach the border of the raster."""
    height, width = weak.shape
    stride = width + 2
    flat = np.pad(weak, ((0, 0), (1, 1))).ravel()
    change = np.flatnonzero(np.diff(flat.astype(np.int8), prepend=0, append=0))
    starts, ends = change[::2], change[1::2] - 1
    out = np.zeros((2, height * stride), bool)
    if len(starts):
        label = _run_labels(starts, ends, stride)
        sums = np.concatenate([[0], np.cumsum(np.pad(strong, ((0, 0), (1, 1))).ravel())])
        row, left, right = starts // stride, starts % stride, ends % stride
        rim = (row == 0) | (row == height - 1) | (left == 1) | (right == width)
        sure, touches = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        sure[label[sums[ends + 1] > sums[starts]]] = True
        touches[label[rim]] = True
        for plane, chosen in zip(out, (sure[label], touches[label] & ~sure[label]), strict=True):
            step = np.zeros(height * stride + 1, np.int8)
            step[starts[chosen]] = 1
            step[ends[chosen] + 1] -= 1
            plane[:] = np.cumsum(step[:-1], dtype=np.int8) > 0
    grown, open_ = (plane.reshape(height, stride)[:, 1:-1] for plane in out)
    return grown, open_


def edges(gray: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge map: gradient (L1), thinning across the gradient, then weak edges kept only where they hang on strong ones."""
    return _grown(*_thin(gray, low, high))[0]


def _edges_near(rgb: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, tuple[slice, slice]]:
    """The edge map of the whole raster, but only the part with all ``wanted`` pixels. Where a weak edge of that part runs
    on beyond it, more is looked at, so the result is that of the whole raster."""
    margin, frame = MARGIN, wanted.shape
    while True:
        part = around(wanted, margin)
        # thinning looks two pixels around
        outer = tuple(slice(max(0, p.start - 2), min(n, p.stop + 2)) for p, n in zip(part, frame, strict=True))
        inner = tuple(slice(p.start - o.start, p.stop - o.start) for p, o in zip(part, outer, strict=True))
        weak, strong = (m[inner] for m in _thin(to_gray(rgb[outer]), 50, 150))
        found, running_on = _grown(weak, strong)
        whole = all(p.start == 0 and p.stop == n for p, n in zip(part, frame, strict=True))
        if whole or not (running_on & wanted[part]).any():
            return found, part
        margin *= 4


def edge_artifact_ratio(rgb: np.ndarray, boxes: Sequence[dict]) -> float:
    """Edge density inside the widened text mask over the density in a thin ring around it; 0 without boxes."""
    mask = boxes_to_mask(rgb.shape[0], rgb.shape[1], boxes)
    if not mask.any():
        return 0.0
    inside = dilate(mask, 12) > 0
    wanted = dilate(np.where(inside, 255, 0).astype(np.uint8), 2) > 0
    found, part = _edges_near(rgb, wanted)
    inside, ring = inside[part], (wanted & ~inside)[part]
    around_it = float(found[ring].mean()) if ring.any() else 1.0
    return float(found[inside].mean()) / (around_it + 1e-6)
