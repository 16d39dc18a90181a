"""Hashes, path parts, glob tests and byte sizes as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(normalize_path(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty when there is none. A leading dot does not start a suffix."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]([.][^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"([^.])[.][^.]+$", "$1")


def glob_regex(pattern: str) -> str:
    """One shell glob as an anchored regex in the subset Java and RE2 share."""
    parts: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            parts.append("[^\\n]*")
        elif ch == "?":
            parts.append("[^\\n]")
        elif ch == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            parts.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            parts.append(re.escape(ch))
        i += 1
    return "^" + "".join(parts) + "$"


def globs_regex(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{glob_regex(p)})" for p in patterns)


def glob_match(name: Column, patterns: Sequence[str]) -> Column:
    """True when the name matches any of the shell globs; an empty list matches nothing."""
    if not patterns:
        return F.lit(False)
    return name.rlike(globs_regex(patterns))


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with ties to even, as C-style formatting rounds them."""
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))


def human_size(num_bytes: Column) -> Column:
    kib, mib, gib = 1024, 1024**2, 1024**3
    return (
        F.when(num_bytes < kib, F.concat(num_bytes.cast("string"), F.lit(" B")))
        .when(num_bytes < mib, F.concat(fixed(num_bytes / kib, 2), F.lit(" KiB")))
        .when(num_bytes < gib, F.concat(fixed(num_bytes / mib, 2), F.lit(" MiB")))
        .otherwise(F.concat(fixed(num_bytes / gib, 2), F.lit(" GiB")))
    )
