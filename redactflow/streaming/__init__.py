from redactflow.streaming.flows import (
    drain,
    live_metrics,
    open_stream,
    open_table_stream,
    read_batches,
    read_latest,
    stream_anonymize,
    stream_images,
    windowed_metrics,
    write_batches,
)
from redactflow.streaming.state import retry_budget, rocksdb_state, stale_leases, use_rocksdb

__all__ = [
    "drain", "live_metrics", "open_stream", "open_table_stream", "read_batches", "read_latest", "retry_budget", "rocksdb_state",
    "stale_leases", "stream_anonymize", "stream_images", "use_rocksdb", "windowed_metrics", "write_batches",
]
