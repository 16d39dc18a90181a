"""A join against a side that is expected to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.session import cut_lineage

BROADCAST_ROWS = 200_000


def join_small(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    written: bool = False,
    null_safe: bool = False,
) -> DataFrame:
    """Join on ``keys``, which must be unique in ``right``; ``how`` is inner or left.

    ``right`` is written out (unless ``written`` says it already is), so Spark knows its size in bytes: it broadcasts
    it when that is small, and otherwise shuffles, splitting a key that holds much of ``left``. With ``null_safe`` a
    null key meets a null key.
    """
    small = right if written else cut_lineage(right)
    if not null_safe:
        return left.join(small, list(keys), how)
    renamed = small.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])
