"""Queries over text: detection, masking, re-scan, routing, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS
from redactflow.functions.secrets import SECRET_KEYS, redact_json, redact_secrets
from redactflow.operators.reports import master_statistics, residual_gate
from redactflow.operators import entities as E
from redactflow.operators.entities import PATTERNS, any_pattern
from redactflow.operators.text import anonymize_text, detect_entities, mask_entities
from redactflow.plans.registry import query
from redactflow.plans.views import Tables
from redactflow.plans.waves import run_waves
from redactflow.session import scratch_path

SALT = "fixed-salt"
_KINDS = list(PATTERNS)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _luhn_sql(number: str) -> str:
    d = f"CAST({number}[len({number}) - i] AS INTEGER)"
    return f"list_sum([CASE WHEN i % 2 = 0 THEN {d} ELSE 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END END for i in range(len({number}))]) % 10 = 0"


def _kind_sql(run: str) -> str:
    number = f"regexp_replace({run}, '[^0-9]', '', 'g')"
    low, high = E.CARD_DIGITS
    card = f"regexp_matches({run}, '^[0-9]+$') OR len({number}) > {high} OR (len({number}) >= {low} AND {_luhn_sql(number)})"
    names = {
        "CARD": f"CASE WHEN {card} THEN 'CARD' END",
        "SSN": f"CASE WHEN regexp_matches({run}, {_lit(E.SEVEN_TEN)}) THEN 'PHONE' ELSE 'SSN' END",
    }
    arms = " ".join(f"WHEN regexp_matches({run}, {_lit(f'^(?:{p})')}) THEN {names.get(kind, _lit(kind))}" for kind, p in PATTERNS.items())
    return f"CASE {arms} END"


def _score_sql(run: str, kind: str) -> str:
    number = f"regexp_replace({run}, '[^0-9]', '', 'g')"
    good = {k: f"regexp_matches({run}, {_lit(p)})" for k, p in E.EXACT.items()}
    good["CARD"] = f"(len({number}) BETWEEN {E.CARD_DIGITS[0]} AND {E.CARD_DIGITS[1]} AND {_luhn_sql(number)})"
    arms = " ".join(f"WHEN {kind} = '{k}' AND NOT {g} THEN {E.UNSURE}::DOUBLE" for k, g in good.items())
    return f"CASE {arms} ELSE {E.SURE}::DOUBLE END"


def found_sql(table: str, key: str, column: str, salt: str | None = None) -> str:
    """CTE list ending in ``found``: all runs of each text, those that are entities, and the text with their stand-ins."""
    p = _lit(any_pattern())
    token = "'[' || r.kind || ']'" if salt is None else f"'[' || r.kind || ':' || left(sha256({_lit(salt)} || r.match), 12) || ']'"
    joined = f"array_to_string([z[1] || coalesce(z[2], '') for z in list_zip(string_split_regex(t, {p}), [CASE WHEN r.kind IS NULL THEN r.match ELSE {token} END for r in runs])], '')"
    counts = ", ".join(f"len(list_filter(runs, lambda r: r.kind = '{k}')) AS n_{k.lower()}" for k in _KINDS)
    return f"""f0 AS (SELECT {key}, {column} AS t FROM {table}),
    f1 AS (SELECT *, [{{'kind': {_kind_sql("m")}, 'match': m}} for m in regexp_extract_all(t, {p})] AS runs FROM f0),
    found AS (SELECT {key}, t AS original, list_filter(runs, lambda r: r.kind IS NOT NULL) AS entities,
      CASE WHEN len(runs) > 0 THEN {joined} ELSE t END AS masked, {counts},
      CAST(coalesce(len(list_filter(runs, lambda r: r.kind IS NOT NULL)), 0) AS BIGINT) AS entity_count,
      CAST(coalesce(list_sum([length(r.match) for r in runs if r.kind IS NOT NULL]), 0) AS BIGINT) AS masked_chars FROM f1)"""


def detect_sql(table: str, key: str, column: str) -> str:
    return f"""WITH {found_sql(table, key, column)},
    each AS (SELECT {key}, unnest(entities) AS r, unnest(range(len(entities))) AS place FROM found)
    SELECT {key}, r.kind AS kind, r.match AS match, row_number() OVER (PARTITION BY {key}, r.kind ORDER BY place) - 1 AS ordinal,
      {_score_sql("r.match", "r.kind")} AS score FROM each"""


def audited_sql(table: str, key: str, column: str) -> str:
    """CTE list ending in ``audited``: one routed row per text."""
    again = f"len([m for m in regexp_extract_all(masked, {_lit(any_pattern())}) if ({_kind_sql('m')}) IS NOT NULL])"
    scan = f"({again} + len(regexp_extract_all(masked, {_lit(E.torn(PATTERNS))})))"
    return f"""{found_sql(table, key, column)},
    measured AS (SELECT *, CASE WHEN entity_count = 0 THEN 0 ELSE {scan} END AS residual_count,
      CASE WHEN length(original) > 0 THEN (length(original) - masked_chars) / length(original)::DOUBLE ELSE 1.0 END
        AS retained_ratio FROM found),
    checked AS (SELECT *, residual_count > 0 AS detection_fail,
      original IS NULL OR retained_ratio < {DEFAULTS.retained_ratio_min} AS integrity_fail FROM measured),
    audited AS (SELECT *, CASE WHEN detection_fail OR integrity_fail THEN 'fail' ELSE 'pass' END AS final_decision,
      CASE WHEN detection_fail OR integrity_fail THEN 'quarantine' ELSE 'final_clean' END AS route,
      CASE WHEN detection_fail OR integrity_fail THEN 1 ELSE 0 END AS retry_count,
      CASE WHEN detection_fail OR integrity_fail THEN concat_ws(' | ',
        CASE WHEN detection_fail THEN 'detection_verification:readable_text_likely_remaining' END,
        CASE WHEN integrity_fail THEN 'identity_integrity:artifact_or_identity_risk' END) END AS failure_reason,
      sha256(original) AS source_sha256, sha256(masked) AS output_sha256 FROM checked)"""


AUDIT_COLUMNS = (
    "entity_count", "masked_chars", "residual_count", "retained_ratio", "final_decision", "failure_reason", "route",
    "retry_count", "source_sha256", "output_sha256",
)


def audited_select(table: str, key: str, column: str) -> str:
    columns = ", ".join("round(retained_ratio, 6) AS retained_ratio" if c == "retained_ratio" else c for c in AUDIT_COLUMNS)
    return f"WITH {audited_sql(table, key, column)} SELECT {key}, {columns} FROM audited"


@query(detect_sql("documents", "doc_id", "text"))
def detect_entities_documents(t: Tables) -> DataFrame:
    return detect_entities(t.texts("documents", "doc_id", "text"), "text", "doc_id")


@query(detect_sql("pages", "page_id", "html"))
def detect_entities_pages(t: Tables) -> DataFrame:
    return detect_entities(t.texts("pages", "page_id", "html"), "html", "page_id")


@query(
    detect_sql(
        """(SELECT conv_id || '-' || turn AS turn_id, CASE WHEN turn % 3 = 0 THEN text || ' write to user' || conv_id || '@mail.example.org'
        WHEN turn % 3 = 1 THEN 'from 10.0.' || turn || '.7, ' || text || ' (555) 555-0100' ELSE text END AS text FROM conversations)""",
        "turn_id",
        "text",
    )
)
def detect_entities_conversations(t: Tables) -> DataFrame:
    """Turns with an address, a host or a phone number put in."""
    mail = F.concat("text", F.lit(" write to user"), "conv_id", F.lit("@mail.example.org"))
    host = F.concat(F.lit("from 10.0."), "turn", F.lit(".7, "), "text", F.lit(" (555) 555-0100"))
    text = F.when(F.col("turn") % 3 == 0, mail).when(F.col("turn") % 3 == 1, host).otherwise(F.col("text"))
    turns = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), text.alias("text"))
    return detect_entities(turns, "text", "turn_id")


_COUNTS = ", ".join(f"n_{k.lower()}" for k in _KINDS)


@query(
    f"WITH {found_sql('documents', 'doc_id', 'text')} SELECT doc_id, sha256(masked) AS masked_sha256, "
    f"length(masked) AS masked_length, entity_count, masked_chars, {_COUNTS} FROM found"
)
def mask_entities_documents(t: Tables) -> DataFrame:
    masked = mask_entities(t.texts("documents", "doc_id", "text"), "text")
    return masked.select(
        "doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.length("masked").alias("masked_length"),
        "entity_count", "masked_chars", *[f"n_{k.lower()}" for k in _KINDS],
    )


@query(
    f"WITH {found_sql('documents', 'doc_id', 'text', SALT)} SELECT doc_id, sha256(masked) AS masked_sha256, "
    "length(masked) AS masked_length, entity_count FROM found"
)
def pseudonymize_documents(t: Tables) -> DataFrame:
    masked = mask_entities(t.texts("documents", "doc_id", "text"), "text", salt=SALT)
    return masked.select(
        "doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.length("masked").alias("masked_length"), "entity_count"
    )


@query(
    f"WITH {audited_sql('documents', 'doc_id', 'text')} SELECT doc_id, residual_count, "
    "round(retained_ratio, 6) AS retained_ratio, detection_fail, integrity_fail FROM audited"
)
def text_qa_documents(t: Tables) -> DataFrame:
    audit = anonymize_text(t.texts("documents", "doc_id", "text"), "text")
    return audit.select("doc_id", "residual_count", "retained_ratio", "detection_fail", "integrity_fail")


@query(audited_select("documents", "doc_id", "text"))
def anonymize_text_documents(t: Tables) -> DataFrame:
    return anonymize_text(t.texts("documents", "doc_id", "text"), "text").select("doc_id", *AUDIT_COLUMNS)


@query(audited_select("pages", "page_id", "html"))
def anonymize_text_pages(t: Tables) -> DataFrame:
    return anonymize_text(t.texts("pages", "page_id", "html"), "html").select("page_id", *AUDIT_COLUMNS)


def totals(t: Tables) -> DataFrame:
    """Flagship: mask every document, verify by re-scan, route, report totals."""
    audit = anonymize_text(t.texts("documents", "doc_id", "text"), "text")
    rows = audit.withColumn("text_regions_detected", F.col("entity_count")).withColumn(
        "text_regions_inpainted", F.col("entity_count") - F.col("residual_count")
    )
    return master_statistics(rows)


@query(
    f"""WITH {audited_sql('documents', 'doc_id', 'text')}
    SELECT count(*) AS images_in_master, count(*) FILTER (final_decision = 'pass') AS passed,
    count(*) FILTER (final_decision = 'fail') AS failed,
    round(count(*) FILTER (final_decision = 'pass') / count(*)::DOUBLE, 6) AS success_rate,
    count(*) FILTER (final_decision = 'pass') / count(*)::DOUBLE + 1e-9 >= 0.99 AS meets_target_success_rate,
    0.99::DOUBLE AS target_success_rate,
    CAST(sum(entity_count - residual_count) AS BIGINT) AS sum_text_regions_inpainted,
    CAST(sum(entity_count) AS BIGINT) AS sum_text_regions_detected FROM audited"""
)
def anonymize_text_totals(t: Tables) -> DataFrame:
    return totals(t)


@query(
    f"""WITH {audited_sql('documents', 'doc_id', 'text')}
    SELECT count(*) AS output_count, 0::BIGINT AS face_hits, count(*) FILTER (residual_count > 0) AS text_hits,
    TRUE AS originals_untouched,
    CASE WHEN count(*) > 0 AND count(*) FILTER (residual_count > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM audited WHERE final_decision = 'pass'"""
)
def residual_gate_documents(t: Tables) -> DataFrame:
    audit = anonymize_text(t.texts("documents", "doc_id", "text"), "text").filter(F.col("final_decision") == "pass")
    outputs = audit.select(
        F.lit(0).alias("face_count"), F.when(F.col("residual_count") > 0, 1.0).otherwise(0.0).alias("max_score")
    )
    return residual_gate(outputs, F.lit(True))


_SECRET = _lit(rf"(?i)({SECRET_KEYS})\s*[:=]\s*\S+")


@query(
    f"""SELECT doc_id, sha256(t) AS redacted_sha256, t <> text AS changed FROM (
    SELECT doc_id, text, regexp_replace(text, {_SECRET}, '\\1=***REDACTED***', 'g') AS t FROM documents)"""
)
def redact_secrets_documents(t: Tables) -> DataFrame:
    out = t.texts("documents", "doc_id", "text").withColumn("_t", redact_secrets(F.col("text")))
    return out.select("doc_id", F.sha2("_t", 256).alias("redacted_sha256"), (F.col("_t") != F.col("text")).alias("changed"))


@query(
    """SELECT event_id, '{"api_token":"***REDACTED***","note":"password=***REDACTED***","k":'
    || (json_extract_string(props, '$.k')) || '}' AS props FROM events"""
)
def redact_record_events(t: Tables) -> DataFrame:
    """The payload with a secret field and a note put in, then redacted as a record."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    record = F.to_json(
        F.struct(
            F.concat(F.lit("tok"), F.col("event_id")).alias("api_token"),
            F.concat(F.lit("password: "), F.col("event_id")).alias("note"),
            k.alias("k"),
        )
    )
    return t.events.select("event_id", redact_json(record, "api_token string, note string, k bigint").alias("props"))


@query(
    f"""WITH {audited_sql('documents', 'doc_id', 'text')}
    SELECT CAST(doc_id AS VARCHAR) AS stem, CASE WHEN final_decision = 'pass' THEN 'final_clean' ELSE 'manual_review' END AS route,
    CASE WHEN final_decision = 'pass' THEN 0 ELSE 3 END AS retry_count,
    CASE WHEN final_decision = 'pass' THEN 0 ELSE 2 END AS wave, failure_reason FROM audited"""
)
def run_waves_documents(t: Tables) -> DataFrame:
    """All waves to the end: a text that fails once fails again, so it uses up its budget."""
    stem = F.col("doc_id").cast("string")
    items = t.texts("documents", "doc_id", "text").select(stem.alias("stem"), stem.alias("path"), "text")
    final = run_waves(t.spark, items, lambda queue: anonymize_text(queue, "text"), scratch_path(t.spark, "waves"))
    return final.select("stem", "route", "retry_count", "wave", "failure_reason")
