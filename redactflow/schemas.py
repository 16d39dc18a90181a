"""Fixed record shapes. Readers apply them permissively: a missing field is null, never an error."""

AUDIT_SCHEMA_NAME = "redactflow.audit.v1"
PROCESSED_MANIFEST_SCHEMA_NAME = "redactflow.processed_manifest.v1"
TRANSFER_MANIFEST_SCHEMA_NAME = "redactflow.transfer_manifest.v1"

BOX_DDL = "struct<polygon:array<array<float>>,text:string,score:double>"
BOXES_DDL = f"array<{BOX_DDL}>"

ITEMS = "path string, modificationTime timestamp, length bigint, content binary"

AUDIT_DDL = f"""
schema string, stem string, image string, source_path string, decode_path string, batch_id string,
created_at timestamp, updated_at timestamp, retry_count int, failure_reason string,
integrity_hashes struct<source_sha256:string,output_sha256:string>,
detections struct<faces:struct<input_face_count:int,post_face_count:int>,
  text:struct<boxes:{BOXES_DDL},count:int,mask_dilation_px:int>>,
qa_probes struct<original_face_count:int,original_embedding:array<float>>,
qa_cache struct<output_boxes:{BOXES_DDL},output_max_score:double,output_count:int>,
stages array<struct<name:string,backend:string,status:string,error:string>>,
actions struct<`order`:array<string>,face_action:string,text_action:string,metadata_strip_method:string>,
success_metrics struct<processing_status:string,face_gan_applied:boolean,text_regions_inpainted:int,
  inpaint_success:boolean,qa_passed:boolean>,
qa struct<detection:struct<ocr_lines:int,max_det_score:double,fail:boolean,reason:string>,
  integrity:struct<ssim:double,ssim_fail:boolean,identity_distance:double,identity_fail:boolean,
    edge_ratio:double,edge_fail:boolean,fail:boolean,reason:string>,
  final_decision:string,final_route:string,failure_reason:string>,
next_pass_overrides struct<extra_mask_dilation:int,truncation_value:double,multi_modal_truncation:boolean,ldm_steps:int>
"""

DETECTIONS_DDL = "stem string, kind string, polygon array<array<float>>, text string, score double"
ATTEMPTS_DDL = "stem string, attempt int, decision string, ts timestamp"
LOCKS_DDL = (
    "batch_index int, stems array<string>, source_paths array<string>, started_at string, completed_stems array<string>"
)
COMPLETIONS_DDL = "batch_index int, completed_at timestamp"
MANIFEST_DDL = (
    "stem string, original_hash string, ingest_timestamp timestamp, source_path string, "
    "output_hash string, processed_at timestamp"
)
MANIFEST_FILES_DDL = "path string, sha256 string, size_bytes bigint"
TRANSFER_BATCHES_DDL = "operation string, offset int, count int, elapsed_sec double, failed boolean, error string"
BATCH_TIMINGS_DDL = (
    "run_id string, batch_index int, images int, elapsed_sec double, pass int, quarantine int, manual_review int"
)
FILES_DDL = "root string, rel_path string, is_dir boolean, size_bytes bigint"
RUN_SCOPE_DDL = (
    "processing_mode string, run_type string, batch_size int, max_images int, dry_run boolean, recorded_at timestamp"
)

# transfer manifest as one JSON document per transfer
TRANSFER_MANIFEST_DDL = f"""
schema string, operation string, remote_uri string, dry_run boolean, timestamp string,
file_count bigint, total_bytes bigint,
files array<struct<path:string,sha256:string,size_bytes:bigint>>,
batches array<struct<offset:int,count:int,elapsed_sec:double>>, failed_files array<string>
"""

# processed manifest: a map from stem to its entry
PROCESSED_MANIFEST_DDL = """
schema string, created_at string, updated_at string,
entries map<string,struct<original_hash:string,ingest_timestamp:string,source_path:string,output_hash:string,processed_at:string>>
"""
