from redactflow.sinks.export import current_export, export_clean, exports, forget_exports, read_export
from redactflow.sinks.tables import (
    ProtectedPathError,
    append_events,
    append_master_audit,
    audit_rows,
    compact_audit,
    guarded_write,
    upsert_audit,
    write_audit,
    write_batch_summary,
    write_manifest,
    write_master_summary,
    write_run_scope,
)

__all__ = [
    "ProtectedPathError", "append_events", "append_master_audit", "audit_rows", "compact_audit", "current_export", "export_clean", "exports", "forget_exports", "guarded_write", "read_export", "upsert_audit",
    "write_audit", "write_batch_summary", "write_manifest", "write_master_summary", "write_run_scope",
]
