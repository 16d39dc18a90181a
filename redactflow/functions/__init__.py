from redactflow.functions.batching import adaptive_batch_size
from redactflow.functions.boxes import max_score, box_count, normalize_boxes
from redactflow.functions.messages import error_class, is_compute_error, is_transient, parse_check_mismatch
from redactflow.functions.names import basename, extension, glob_match, human_size, normalize_path, sha256_hex, stem
from redactflow.functions.progress import format_eta, progress_pct, recommendations, total_batches
from redactflow.functions.secrets import redact_secrets, redact_struct, sanitize_for_export
from redactflow.functions.times import age_seconds, parse_iso_ts
from redactflow.functions.vectors import cosine_distance, cosine_similarity, l2_normalize

__all__ = [
    "adaptive_batch_size", "age_seconds", "basename", "box_count", "cosine_distance", "cosine_similarity",
    "error_class", "extension", "format_eta", "glob_match", "human_size", "is_compute_error", "is_transient",
    "l2_normalize", "max_score", "normalize_boxes", "normalize_path", "parse_check_mismatch", "parse_iso_ts",
    "progress_pct", "recommendations", "redact_secrets", "redact_struct", "sanitize_for_export", "sha256_hex",
    "stem", "total_batches",
]
