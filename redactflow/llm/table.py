"""Small helpers shared by the operators: columns by name, whatever else the input has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns that results will take the names of (letter case ignored, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``_doc``, and ``more``: whatever ``df`` has, no name can clash."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("_doc"), *[c.alias(name) for name, c in more.items()])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_doc.*")
