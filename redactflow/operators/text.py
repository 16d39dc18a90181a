"""Detect, mask and re-scan personal data and secrets in text columns. No Python runs per row.

``entities`` says what runs of text may be an entity and decides each as a whole. Every character belongs to at most one
run. A cheap test per text decides first whether any kind can occur at all; texts without entities, which are most of
them, pay for that one pass only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.config import DEFAULTS, Settings
from redactflow.operators.entities import NEEDS, PATTERNS, STARTS, THERE, all_linear, any_pattern, kind_of, score_of, torn
from redactflow.operators.qa import decide, detection_fail
from redactflow.operators.route import route


def has_entity(text: Column, patterns: Mapping[str, str] = PATTERNS) -> Column:
    """Whether any run occurs: kinds are grouped by what they need, and a group is searched only where that is found."""
    groups: dict[str | None, dict[str, str]] = {}
    for kind, pattern in patterns.items():
        need = NEEDS.get(kind) if pattern == PATTERNS.get(kind) else None
        groups.setdefault(need, {})[kind] = pattern if need is None else THERE.get(kind, pattern)
    out = F.lit(False)
    for need, members in groups.items():
        found = text.rlike(f"{STARTS.get(need, '')}(?:{any_pattern(all_linear(members))})")
        if need is not None:
            found = (text.contains(need) if len(need) == 1 else text.rlike(need)) & found
        out = out | found
    return F.coalesce(out, F.lit(False))


def _decided(found: Column, patterns: Mapping[str, str]) -> Column:
    """What becomes of each run: kind (null: let go), match, score."""
    kinds = F.transform(found, lambda m: F.struct(kind_of(m, patterns).alias("kind"), m.alias("match")))
    return F.transform(kinds, lambda r: F.struct(r["kind"].alias("kind"), r["match"].alias("match"), score_of(r["match"], r["kind"], patterns).alias("score")))


def _runs(text: Column, patterns: Mapping[str, str]) -> Column:
    """All runs of a text in order, decided."""
    return _decided(F.regexp_extract_all(text, F.lit(any_pattern(all_linear(patterns))), F.lit(0)), patterns)


#: Put around runs, so that one search gives them and what stands between. Texts that hold it are searched twice.
MARK = "\u0001"


def _cut(text: Column, patterns: Mapping[str, str]) -> Column:
    """A text cut at its runs: pieces and runs in turn, the first and the last a piece."""
    pattern = any_pattern(all_linear(patterns))
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    in_turn = F.flatten(F.zip_with(pieces, found, lambda p, m: F.when(m.isNull(), F.array(p)).otherwise(F.array(p, m))))
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(text.contains(MARK), in_turn).otherwise(marked)


def _of_kind(runs: str, kind: str) -> Column:
    return F.filter(runs, lambda r: r["kind"] == kind)


def pseudonym(match: Column, kind: Column, salt: str) -> Column:
    """Stable keyed stand-in for one match: equal matches get equal tokens."""
    return F.concat(F.lit("["), kind, F.lit(":"), F.substring(F.sha2(F.concat(F.lit(salt), match), 256), 1, 12), F.lit("]"))


def _found(df: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """Adds ``_has`` (any run at all) and ``_runs``."""
    has = has_entity(F.col(column), patterns)
    none = F.array().cast("array<struct<kind:string,match:string,score:double>>")
    return df.withColumn("_has", has).withColumn("_runs", F.when(F.col("_has"), _runs(F.col(column), patterns)).otherwise(none))


def _masked(pieces: Column, runs: Column, salt: str | None) -> Column:
    """The pieces between runs, each followed by what stands for the run after it."""

    def stand_in(r: Column) -> Column:
        token = F.concat(F.lit("["), r["kind"], F.lit("]")) if salt is None else pseudonym(r["match"], r["kind"], salt)
        return F.when(r["kind"].isNull(), r["match"]).otherwise(token)

    return F.array_join(F.zip_with(pieces, runs, lambda p, r: F.concat(p, F.when(r.isNull(), F.lit("")).otherwise(stand_in(r)))), "")


def detect_entities(df: DataFrame, column: str, key: str, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """One row per entity: key, kind, match, ordinal (from 0, per kind), score (1.0, or 0.9 for a run that is longer than
    its kind or fails its check digit)."""
    hit = df.select(key, column).filter(has_entity(F.col(column), patterns))
    found = _found(hit, column, patterns)
    per_kind = F.array(*[F.struct(F.lit(kind).alias("kind"), _of_kind("_runs", kind).alias("runs")) for kind in patterns])
    # the runs are computed once, below a generator, and not once for every kind
    kinds = found.select(key, F.explode(F.array("_runs")).alias("_runs")).select(key, F.explode(per_kind).alias("k"))
    return kinds.select(key, F.col("k.kind").alias("kind"), F.posexplode("k.runs").alias("ordinal", "r")).select(
        key, "kind", F.col("r.match").alias("match"), "ordinal", F.col("r.score").alias("score")
    )


def mask_entities(
    df: DataFrame, column: str, patterns: Mapping[str, str] = PATTERNS, salt: str | None = None
) -> DataFrame:
    """Adds ``masked``, ``entity_count``, ``masked_chars`` and ``n_kind`` per kind.

    With ``salt`` each match becomes a keyed pseudonym instead of ``[KIND]``.
    """
    # A filter on the results must not be pushed below them, which would search the text again inside the predicate. It
    # cannot pass a generator, and what a generator gives is computed once.
    given = [F.col(c) for c in df.columns]
    searched = df.withColumn("_has", has_entity(F.col(column), patterns))
    cut = searched.select(*given, F.inline(F.array(F.struct(F.when(F.col("_has"), _cut(F.col(column), patterns)).alias("_cut")))))
    pieces, found = F.filter("_cut", lambda x, i: i % 2 == 0), F.filter("_cut", lambda x, i: i % 2 == 1)
    none = F.array().cast("array<struct<kind:string,match:string,score:double>>")
    runs = F.when(F.col("_cut").isNull(), none).otherwise(_decided(found, patterns))
    found = cut.select(*given, F.inline(F.array(F.struct(pieces.alias("_pieces"), runs.alias("_runs")))))
    taken = F.filter("_runs", lambda r: r["kind"].isNotNull())
    text = F.col(column)
    result = F.struct(
        F.when(F.col("_pieces").isNull(), text).otherwise(_masked(F.col("_pieces"), F.col("_runs"), salt)).alias("masked"),
        F.size(taken).alias("entity_count"),
        F.aggregate(taken, F.lit(0), lambda acc, r: acc + F.length(r["match"])).alias("masked_chars"),
        *[F.size(_of_kind("_runs", kind)).alias(f"n_{kind.lower()}") for kind in patterns],
    )
    return found.select(*[F.col(c) for c in df.columns], F.inline(F.array(result)))


def residual_count(text: Column, patterns: Mapping[str, str] = PATTERNS) -> Column:
    """Entities still found by a fresh scan of the output, and masks that are part of a longer word or number: whatever
    was missed there is not searched for by the same patterns."""
    found = F.regexp_extract_all(text, F.lit(any_pattern(all_linear(patterns))), F.lit(0))
    entities = F.size(F.filter(found, lambda m: kind_of(m, patterns).isNotNull()))
    return F.coalesce(entities + F.regexp_count(text, F.lit(torn(patterns))), F.lit(0))


def text_qa(
    masked: DataFrame, column: str, settings: Settings = DEFAULTS, patterns: Mapping[str, str] = PATTERNS
) -> DataFrame:
    """Re-scan ``masked`` and compare what was kept with the original: adds detection and integrity verdicts."""
    length = F.length(column)
    kept = F.when(length > 0, (length - F.col("masked_chars")) / length).otherwise(F.lit(1.0))
    out = masked.withColumns(
        {
            "residual_count": F.when(F.col("entity_count") == 0, F.lit(0)).otherwise(
                residual_count(F.col("masked"), patterns)
            ),
            "retained_ratio": kept,
        }
    )
    score = F.when(F.col("residual_count") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "detection_fail": detection_fail(score, F.col("residual_count"), settings),
            # a text that could not be read is a failed attempt
            "integrity_fail": F.col(column).isNull() | F.coalesce(F.col("retained_ratio") < settings.retained_ratio_min, F.lit(False)),
        }
    )


def anonymize_text(
    df: DataFrame,
    column: str,
    settings: Settings = DEFAULTS,
    patterns: Mapping[str, str] = PATTERNS,
    salt: str | None = None,
    qa_rules: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Detect, mask, re-scan, decide, route. One audit row per text with both hashes; no shuffle.

    ``retry_count`` is read when the input has it. The text itself is replaced by ``masked``.
    """
    start = df if "retry_count" in df.columns else df.withColumn("retry_count", F.lit(0))
    checked = text_qa(mask_entities(start, column, patterns, salt), column, settings, patterns)
    routed = route(decide(checked, qa_rules), settings)
    return routed.withColumns(
        {"source_sha256": F.sha2(column, 256), "output_sha256": F.sha2("masked", 256)}
    ).drop(column)
