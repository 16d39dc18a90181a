"""Masks, blur and redaction on one raster. Boxes are dicts ``polygon, text, score``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np


#: Crossings of a polygon with rows that are looked at together.
TABLE = 1 << 20


def _fill(mask: np.ndarray, polygon: np.ndarray) -> None:
    """Even-odd fill with the outline included."""
    height, width = mask.shape
    pts = np.round(np.asarray(polygon, dtype=np.float64)).astype(np.int64)
    if pts.ndim != 2 or len(pts) < 1 or pts.shape[1] != 2:
        return
    if len(pts) == 4 and _is_rectangle(pts.tolist()):
        x0, y0, x1, y1 = (max(0, int(v)) for v in (*pts.min(axis=0), *pts.max(axis=0) + 1))
        mask[y0:y1, x0:x1] = 255
        return
    nxt = np.roll(pts, -1, axis=0)
    for (x0, y0), (x1, y1) in zip(pts, nxt):
        steps = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        xs = np.rint(np.linspace(x0, x1, steps)).astype(np.int64)
        ys = np.rint(np.linspace(y0, y1, steps)).astype(np.int64)
        ok = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        mask[ys[ok], xs[ok]] = 255
    first, last = max(0, int(pts[:, 1].min())), min(height - 1, int(pts[:, 1].max()))
    rise = nxt[:, 1] - pts[:, 1]
    slant, rows = np.where(rise == 0, 1, rise), max(1, TABLE // len(pts))
    for at in range(first, last + 1, rows):
        ys = np.arange(at, min(at + rows, last + 1))[:, None]
        crosses = (pts[:, 1] <= ys) != (nxt[:, 1] <= ys)
        xs = np.sort(np.where(crosses, pts[:, 0] + (ys - pts[:, 1]) * (nxt[:, 0] - pts[:, 0]) / slant, np.inf), axis=1)
        xs = xs[:, : len(pts) // 2 * 2]  # a closed line crosses a row an even number of times
        # places are cut to the raster first, so that a stretch outside it is empty
        lo = np.clip(np.ceil(xs[:, ::2]), 0, width).astype(np.int64)
        hi = np.clip(np.floor(xs[:, 1::2]), -1, width - 1).astype(np.int64)
        row, some = np.broadcast_to(ys - at, lo.shape), np.isfinite(xs[:, ::2]) & (hi >= lo)
        step = np.zeros((len(ys), width + 1), np.int32)
        np.add.at(step, (row[some], lo[some]), 1)
        np.add.at(step, (row[some], hi[some] + 1), -1)
        mask[at : at + len(ys)][np.cumsum(step[:, :-1], axis=1) > 0] = 255


def _is_rectangle(pts: list[list[int]]) -> bool:
    """Four corners, in turn, of an upright rectangle: what is in it is its outline and all between."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = pts
    return (ax == dx and bx == cx and ay == by and cy == dy) or (ax == bx and cx == dx and by == cy and ay == dy)


def around(on: np.ndarray, margin: int) -> tuple[slice, slice]:
    """The part of the raster that holds all set pixels, widened by ``margin``."""
    ys, xs = np.nonzero(on.any(axis=1))[0], np.nonzero(on.any(axis=0))[0]
    height, width = on.shape
    return (
        slice(max(0, ys[0] - margin), min(height, ys[-1] + margin + 1)),
        slice(max(0, xs[0] - margin), min(width, xs[-1] + margin + 1)),
    )


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation by a disk of size ``2 * radius + 1``."""
    if radius <= 0 or not mask.any():
        return mask
    part = around(mask > 0, radius)
    full = np.zeros_like(mask)
    full[part] = _dilate(mask[part], radius)
    return full


def _dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    height, width = mask.shape
    on = (mask > 0).astype(np.int32)
    out = np.zeros_like(on, dtype=bool)
    wide = np.zeros((height, width + 2 * radius + 1), np.int32)
    wide[:, radius + 1 : radius + 1 + width] = on
    sums = np.cumsum(wide, axis=1)
    for dy in range(min(radius, height - 1) + 1):
        reach = int(np.rint(np.sqrt(radius * radius - dy * dy)))
        wide = sums[:, radius + 1 + reach : radius + 1 + reach + width] > sums[:, radius - reach : radius - reach + width]
        out[dy:] |= wide[: height - dy]
        out[: height - dy] |= wide[dy:]
    return np.where(out, 255, 0).astype(np.uint8)


def boxes_to_mask(height: int, width: int, boxes: Sequence[dict], radius: int = 0) -> np.ndarray:
    mask = np.zeros((height, width), dtype=np.uint8)
    for box in boxes:
        _fill(mask, box["polygon"])
    return dilate(mask, radius)


def _kernel(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - (size - 1) / 2
    weights = np.exp(-(at**2) / (2 * sigma * sigma))
    return weights / weights.sum()


#: Products that are made together.
PRODUCTS = 1 << 18


@lru_cache(maxsize=64)
def _seen(n: int, taps: int) -> np.ndarray:
    """For each tap, the place in a line of ``n`` values that each value sees by it, mirrored at the ends."""
    line = np.pad(np.arange(n), taps // 2, mode="reflect" if n > 1 else "edge")
    return line[np.arange(taps)[:, None] + np.arange(n)]


def _convolve(values: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    half, n = len(kernel) // 2, values.shape[axis]
    if values.size * len(kernel) <= PRODUCTS:
        # one product after the other is added along the first axis, as below
        each = values.swapaxes(0, axis)[_seen(n, len(kernel))]
        each *= kernel.reshape(-1, *[1] * values.ndim)
        return each.sum(axis=0).swapaxes(0, axis)
    pads = [(half, half) if i == axis else (0, 0) for i in range(values.ndim)]
    padded = np.pad(values, pads, mode="reflect" if n > 1 else "edge")
    out = np.zeros(values.shape, dtype=np.float64)
    for i, weight in enumerate(kernel):
        index = [slice(None)] * values.ndim
        index[axis] = slice(i, i + n)
        out += weight * padded[tuple(index)]
    return out


def gaussian_blur(region: np.ndarray, ksize: int) -> np.ndarray:
    kernel = _kernel(ksize)
    smooth = _convolve(_convolve(region.astype(np.float64), kernel, 0), kernel, 1)
    return np.clip(np.rint(smooth), 0, 255).astype(np.uint8)


def blur_boxes(rgb: np.ndarray, rectangles: Sequence[Sequence[float]], ksize: int = 51) -> tuple[np.ndarray, int]:
    """Blur each ``x1, y1, x2, y2`` clamped to the raster; returns the result and how many boxes lie in it."""
    out, done = rgb.copy(), 0
    height, width = rgb.shape[:2]
    size = max(3, int(ksize) | 1)
    for box in rectangles:
        x1, y1, x2, y2 = (int(v) for v in box[:4])
        if x1 >= width or y1 >= height:
            continue
        x1, x2 = max(0, min(width - 1, x1)), max(0, min(width, x2))
        y1, y2 = max(0, min(height - 1, y1)), max(0, min(height, y2))
        if x2 > x1 and y2 > y1:
            out[y1:y2, x1:x2] = gaussian_blur(out[y1:y2, x1:x2], size)
            done += 1
    return out, done


Fill = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _neighbours(values: np.ndarray) -> np.ndarray:
    padded = np.pad(values, ((1, 1), (1, 1), (0, 0)), mode="edge")
    return (padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:]) / 4


def _boundary_mean(rgb: np.ndarray, hole: np.ndarray) -> np.ndarray:
    ring = dilate(np.where(hole, 255, 0).astype(np.uint8), 1).astype(bool) & ~hole
    return rgb[ring].mean(axis=0) if ring.any() else np.zeros(3)


def _correction(hole: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """One multigrid cycle: what to add, zero outside the hole, so that ``wrong``, how far each pixel is from the mean of
    its neighbours, goes away. Halving the raster turns the slow part of it into a fast one."""
    inside = hole[..., None]

    def smooth(e: np.ndarray, times: int) -> np.ndarray:
        for _ in range(times):
            e = e + np.where(inside, 0.8 * (wrong - e + _neighbours(e)), 0)
        return e

    e = np.zeros_like(wrong)
    if min(hole.shape) <= 4 or not hole.any():
        return smooth(e, 30)
    e = smooth(e, 3)
    left = np.where(inside, wrong - e + _neighbours(e), 0)
    height, width = hole.shape
    even = ((0, height % 2), (0, width % 2))
    cells = np.pad(hole, even, mode="edge").reshape((height + 1) // 2, 2, (width + 1) // 2, 2)
    coarse = np.pad(left, (*even, (0, 0)), mode="edge").reshape(*cells.shape, -1).mean(axis=(1, 3))
    # a pixel of the halved raster is as far from its neighbours as two: its error is four times as large
    half = cells.all(axis=(1, 3))
    found = _correction(half, np.where(half[..., None], 4 * coarse, 0))
    e = e + np.where(inside, _doubled(found)[:height, :width], 0)
    return smooth(e, 3)


def _doubled(values: np.ndarray) -> np.ndarray:
    """Twice the size, each new pixel three parts its own cell and one part the next one, in both directions."""
    p = np.pad(values, ((1, 1), (0, 0), (0, 0)), mode="edge")
    rows = np.stack([0.75 * p[1:-1] + 0.25 * p[:-2], 0.75 * p[1:-1] + 0.25 * p[2:]], axis=1).reshape(-1, *values.shape[1:])
    p = np.pad(rows, ((0, 0), (1, 1), (0, 0)), mode="edge")
    both = np.stack([0.75 * p[:, 1:-1] + 0.25 * p[:, :-2], 0.75 * p[:, 1:-1] + 0.25 * p[:, 2:]], axis=2)
    return both.reshape(rows.shape[0], -1, values.shape[2])


#: Cycles end when none of them moves a pixel by more than this, or after so many.
SETTLED, CYCLES = 0.02, 60


#: Holes in a rectangle of at most so many rows and columns, half of which they fill, are filled by conjugate gradients.
SMALL, STEPS, EXACT = 256, 100, 1e-5


@lru_cache(maxsize=512)
def _line(n: int, free_start: bool, free_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second differences of ``n`` values in a line, their own vectors and values. Beyond an end stands zero, or, where it
    is free, the last value again."""
    line = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    line[0, 0] -= free_start
    line[-1, -1] -= free_end
    values, vectors = np.linalg.eigh(line)
    return line, vectors, values


def _settled_at_once(work: np.ndarray, hole: np.ndarray) -> np.ndarray | None:
    """The fill by conjugate gradients, each step led by the exact solution for the whole rectangle around the hole: a
    rectangle takes one step, rounded corners a few more. None if that is not enough."""
    box = around(hole, 0)
    inside, (rows, columns) = hole[box], box
    height, width = inside.shape
    if max(height, width) > SMALL or 2 * np.count_nonzero(inside) < height * width:
        return None
    down, v, dv = _line(height, rows.start == 0, rows.stop == hole.shape[0])
    across, w, dw = _line(width, columns.start == 0, columns.stop == hole.shape[1])
    weights = np.maximum(dv[:, None] + dw, 1 / (height * width))  # zero for a rectangle that is free on all sides

    def lead(r: np.ndarray) -> np.ndarray:
        return np.where(inside, v @ ((v.T @ r @ w) / weights) @ w.T, 0)

    def total(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * b).sum(axis=(1, 2), keepdims=True)

    left = np.where(inside, 4 * (_neighbours(work) - work)[box].transpose(2, 0, 1), 0)
    found, way = np.zeros_like(left), np.zeros_like(left)
    before = np.ones((len(left), 1, 1))
    for _ in range(STEPS):
        if np.abs(left).max() < EXACT:
            out = work.copy()
            out[box] += found.transpose(1, 2, 0)
            return out
        led = lead(left)
        now = total(left, led)
        way = led + now / before * way
        pull = np.where(inside, down @ way + way @ across, 0)
        share = now / np.maximum(total(way, pull), 1e-300)
        found, left, before = found + share * way, left - share * pull, np.maximum(now, 1e-300)
    return None


def _spread_in(work: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """Every pixel of the hole the mean of its neighbours, as nearly as grays can tell, whatever the hole's size."""
    done = _settled_at_once(work, hole)
    if done is not None:
        return done
    inside = hole[..., None]
    for _ in range(CYCLES):
        step = _correction(hole, np.where(inside, _neighbours(work) - work, 0))
        work = work + step
        if np.abs(step).max() < SETTLED:
            break
    return work


def redact_regions(rgb: np.ndarray, mask: np.ndarray, mode: str | Fill = "boundary_mean") -> tuple[np.ndarray, str]:
    """Fill masked pixels from outside them; every other pixel stays as it is. Returns raster and status.

    Modes: ``solid`` black, ``boundary_mean``, ``diffuse`` (each pixel the mean of its neighbours: the smoothest surface
    through what is around the hole), or a callable ``(rgb, mask) -> rgb`` of the caller.
    """
    hole = mask > 0
    if not hole.any():
        return rgb, "skipped"
    out = rgb.copy()
    if callable(mode):
        out[hole] = mode(rgb, mask)[hole]
    elif mode == "solid":
        out[hole] = 0
    elif mode in ("boundary_mean", "diffuse"):
        part = around(hole, 1)
        inside = hole[part]
        work = rgb[part].astype(np.float64)
        work[inside] = _boundary_mean(rgb[part], inside)
        if mode == "diffuse":
            work = _spread_in(work, inside)
        out[part][inside] = np.clip(np.rint(work[inside]), 0, 255).astype(np.uint8)
    else:
        raise ValueError(f"unknown redaction mode: {mode}")
    return out, "ok"
