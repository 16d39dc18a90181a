"""Thresholds and limits, in one frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # QA thresholds
    text_score_fail: float = 0.85
    min_output_face: int = 0
    identity_distance_min: float = 0.35
    ssim_min: float = 0.75
    edge_ratio_max: float = 0.12
    max_output_faces_warn: int = 20
    retained_ratio_min: float = 0.75
    # routing
    max_retries: int = 3
    min_success_rate: float = 0.99
    max_waves: int = 200
    lock_stale_sec: int = 3600
    # ingest screening
    max_bytes: int = 52_428_800
    max_pixels: int = 50_000_000
    min_pixels: int = 4096
    # batch sizing
    batch_size: int = 32
    max_batch_size: int = 64
    large_queue: int = 5000
    medium_queue: int = 1000
    # image operators
    face_blur_ksize: int = 51
    mask_dilation: int = 12
    # listings (fixed values)
    image_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
    ingest_excludes: tuple[str, ...] = ("orig_*", "thumb_*", "*.mp4", "*.mov", "*.avi")


DEFAULTS = Settings()
