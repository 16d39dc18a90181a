from redactflow.sources.files import (
    dataset_profile,
    decode_images,
    empty_files,
    list_with_excludes,
    listing_counts,
    open_image_stream,
    scan_files,
    scan_items,
)
from redactflow.sources.records import (
    events_from_text,
    read_audit,
    read_events,
    read_processed_manifest,
    read_transfer_manifest,
    transfer_manifest_header,
)

__all__ = [
    "dataset_profile", "decode_images", "empty_files", "events_from_text", "list_with_excludes", "listing_counts",
    "open_image_stream", "read_audit",
    "read_events", "read_processed_manifest", "read_transfer_manifest", "scan_files", "scan_items",
    "transfer_manifest_header",
]
