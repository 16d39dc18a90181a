"""Secret redaction on text columns and on whole nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "***REDACTED***"

# Key words that introduce a secret, and names that mark a whole field as secret.
SECRET_KEYS = r"api[_-]?key|secret|password|token|b2[_-]?(?:readonly|write)?[_-]?key|authorization"
SECRET_FIELD_PARTS = ("password", "secret", "api_key", "token", "private_key")
SECRET_FIELD_NAMES = (
    "B2_KEY_ID",
    "B2_READONLY_KEY",
    "B2_WRITE_KEY",
    "OPENAI_API_KEY",
    "AWS_SECRET_ACCESS_KEY",
    "RCLONE_CONFIG_PASS",
)


def secret_pattern(unicode: bool = False) -> str:
    """``key`` then ``:`` or ``=`` then a value. Blanks may cross line ends; ``unicode`` widens them to any space."""
    flags = "(?iU)" if unicode else "(?i)"
    return rf"{flags}({SECRET_KEYS})[\s]*[:=][\s]*[^\s]+"


def redact_secrets(text: Column, literals: Sequence[str] = (), unicode: bool = False) -> Column:
    """Replace secret values by a constant, and any literal longer than four characters passed by the caller."""
    out = F.regexp_replace(text, secret_pattern(unicode), "$1=" + REDACTED.replace("$", "\\$"))
    for literal in literals:
        if len(literal) > 4:
            out = F.replace(out, F.lit(literal), F.lit(REDACTED))
    return out


def is_secret_field(name: str) -> bool:
    lowered = name.lower()
    return name.upper() in SECRET_FIELD_NAMES or any(part in lowered for part in SECRET_FIELD_PARTS)


def _secret_key_column(key: Column) -> Column:
    named = F.upper(key).isin(*SECRET_FIELD_NAMES)
    return named | F.lower(key).rlike("|".join(SECRET_FIELD_PARTS))


# A JSON text as its tokens: strings, brackets, separators, and the rest (numbers, words, blanks).
_TOKEN = r'"(?:[^"\\]|\\[\s\S])*+"|[\[\]{}:,]|[^"\[\]{}:,]++'


def redact_json_text(text: Column, literals: Sequence[str] = ()) -> Column:
    """Redact JSON text of unknown shape: whatever stands under a secret-named key, to any depth, becomes a constant,
    and secrets inside strings are redacted. Text that is no JSON but names such a key becomes the constant as a whole.

    The text is read token by token; ``skip`` is the depth at which a secret value began, ``named`` that the last key
    was secret. With a known shape use ``redact_json``.
    """
    constant = F.lit(f'"{REDACTED}"')
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"), F.lit(0).alias("depth"), F.lit(0).alias("skip"), F.lit(False).alias("named"))

    def step(s: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        blank = F.trim(token, F.lit(" \t\r\n")) == ""
        inside = s["skip"] > 0
        begins = s["named"] & ~inside & ~blank & ~closes & ~token.isin(":", ",")
        skip = F.when(begins & opens, depth).when(inside & closes & (depth < s["skip"]), 0).otherwise(s["skip"])
        plain = F.when(token.startswith('"'), redact_secrets_inside(token, literals)).otherwise(token)
        shown = F.when(begins, constant).when(inside, F.lit("")).otherwise(plain)
        key = F.substring(s["last"], 2, F.length(s["last"]) - 2)
        named = F.when(token == ":", s["last"].startswith('"') & _secret_key_column(key)).when(blank, s["named"]).otherwise(F.lit(False))
        return F.struct(
            F.concat(s["out"], shown).alias("out"), F.when(blank, s["last"]).otherwise(token).alias("last"), depth.alias("depth"), skip.alias("skip"), named.alias("named")
        )

    read = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, step, lambda s: s["out"])
    names = "|".join((*SECRET_FIELD_PARTS, *SECRET_FIELD_NAMES))
    broken = F.when(text.rlike(f"(?i){names}"), F.lit(REDACTED)).otherwise(redact_secrets(text, literals))
    return F.when(F.try_parse_json(text).isNotNull(), read).when(text.isNotNull(), broken)


def redact_secrets_inside(token: Column, literals: Sequence[str] = ()) -> Column:
    """Secrets inside one JSON string; its end stays."""
    out = F.regexp_replace(token, rf'(?i)({SECRET_KEYS})\s*[:=]\s*(?:[^\s"\\]|\\[^nrt])+', "$1=" + REDACTED)
    for literal in literals:
        if len(literal) > 4:
            out = F.replace(out, F.lit(literal), F.lit(REDACTED))
    return out


def _blank(dtype: T.DataType, value: Column) -> Column:
    """``value`` with nothing left in it: texts become the constant at any depth, what can't hold it becomes null."""
    if isinstance(dtype, T.StringType):
        return F.when(value.isNotNull(), F.lit(REDACTED))
    if isinstance(dtype, T.VariantType):
        return F.when(value.isNotNull(), F.lit(REDACTED).cast("variant"))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _blank(dtype.elementType, x))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _k, v: _blank(dtype.valueType, v))
    if isinstance(dtype, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_blank(f.dataType, value.getField(f.name)).alias(f.name) for f in dtype.fields]))
    return F.lit(None).cast(dtype)


def _walk(col: Column, dtype: T.DataType, literals: Sequence[str]) -> Column:
    if isinstance(dtype, T.StringType):
        return redact_secrets(col, literals)
    if isinstance(dtype, T.VariantType):
        clean = redact_json_text(F.to_json(col), literals)
        return F.coalesce(F.try_parse_json(clean), clean.cast("variant"))
    if isinstance(dtype, T.StructType):
        fields = [
            (F.lit(REDACTED) if is_secret_field(f.name) else _walk(col.getField(f.name), f.dataType, literals)).alias(
                f.name
            )
            for f in dtype.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType) and _holds_text(dtype.elementType):
        return F.transform(col, lambda item: _walk(item, dtype.elementType, literals))
    if isinstance(dtype, T.MapType):
        kind = dtype.valueType
        return F.transform_values(
            col, lambda k, v: F.when(_secret_key_column(k.cast("string")), _blank(kind, v)).otherwise(_walk(v, kind, literals))
        )
    return col


def _holds_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.StringType, T.VariantType)):
        return True
    if isinstance(dtype, T.StructType):
        return any(is_secret_field(f.name) or _holds_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return True
    return False


def redact_struct(df: DataFrame, literals: Sequence[str] = ()) -> DataFrame:
    """Redact every column of ``df``: secret-named fields become a constant, other strings are scanned."""
    return df.select(
        *[
            (F.lit(REDACTED) if is_secret_field(f.name) else _walk(F.col(f"`{f.name}`"), f.dataType, literals)).alias(
                f.name
            )
            for f in df.schema.fields
        ]
    )


def redact_json(text: Column, schema: str | T.StructType | T.MapType) -> Column:
    """Redact a JSON text column: parse with ``schema``, redact, write back. Unparsable text is scanned as plain text."""
    if isinstance(schema, str):
        schema = T.DataType.fromDDL(schema)
    redacted = F.to_json(_walk(F.from_json(text, schema), schema, ()))
    return F.when(F.try_parse_json(text).isNotNull(), redacted).otherwise(redact_secrets(text))


def sanitize_for_export(df: DataFrame, literals: Sequence[str] = (), drop: Sequence[str] = ("decode_path",)) -> DataFrame:
    """Redacted record without internal paths."""
    return redact_struct(df.drop(*drop), literals)
