"""Detection boxes: ``array<struct<polygon, text, score>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactflow.schemas import BOX_DDL, BOXES_DDL


def max_score(boxes: Column) -> Column:
    """Highest score, 0 when there is none."""
    scores = F.transform(boxes, lambda b: b.getField("score"))
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(scores), F.lit(0.0)))


def box_count(boxes: Column) -> Column:
    return F.coalesce(F.size(boxes), F.lit(0))


def _cell(value: Column, path: str, dtype: str) -> Column:
    return F.try_variant_get(value, path, dtype)


def normalize_boxes(raw: Column) -> Column:
    """Well-formed boxes from raw JSON text, in either of two shapes.

    ``[[polygon, [text, score]], ...]`` as detectors emit it (possibly wrapped once more per page), or
    ``[{"polygon":..., "text":..., "score":...}, ...]`` as audits store it. Malformed entries are dropped.
    """

    def lines_of(doc: Column) -> Column:
        entries = F.coalesce(_cell(doc, "$", "array<variant>"), F.array().cast("array<variant>"))
        # one page wrapped in a list: the only element is itself a list whose first element is a list of lines
        wrapped = _cell(doc, "$[0][0][0][0]", "array<variant>").isNotNull() & _cell(doc, "$[1]", "variant").isNull()
        return F.when(wrapped, _cell(doc, "$[0]", "array<variant>")).otherwise(entries)

    def to_box(entry: Column) -> Column:
        has_score = _cell(entry, "$.score", "variant").isNotNull()

        def box(polygon: Column, text: Column, score: Column) -> Column:
            return F.struct(polygon.alias("polygon"), text.alias("text"), score.alias("score")).cast(BOX_DDL)

        listed = box(
            _cell(entry, "$[0]", "array<array<float>>"), _cell(entry, "$[1][0]", "string"), _cell(entry, "$[1][1]", "double")
        )
        stored = box(
            _cell(entry, "$.polygon", "array<array<float>>"),
            F.coalesce(_cell(entry, "$.text", "string"), F.lit("")),
            F.when(has_score, _cell(entry, "$.score", "double")).otherwise(F.lit(0.0)),
        )
        return F.when(_cell(entry, "$[0]", "variant").isNotNull(), listed).otherwise(stored)

    def well_formed(box: Column) -> Column:
        return box.getField("polygon").isNotNull() & box.getField("text").isNotNull() & box.getField("score").isNotNull()

    def boxes_of(doc: Column) -> Column:
        return F.filter(F.transform(lines_of(doc), to_box), well_formed)

    # the lambda variable holds the parsed document, so it is parsed once
    per_doc = F.transform(F.array(F.try_parse_json(raw)), boxes_of)
    return F.coalesce(F.get(per_doc, F.lit(0)), F.array().cast(BOXES_DDL)).cast(BOXES_DDL)
