"""Registry of queries: name, Spark function over ``Tables``, and equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactflow.plans.view_sql import with_views
from redactflow.plans.views import Tables

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return tidy(self.build(Tables(spark, folder)))


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, views: str = "") -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, build, with_views(views, sql) if sql else None)
        return build

    return add


def tidy(df: DataFrame) -> DataFrame:
    """One integer type, doubles to six places: what the side-by-side check compares."""

    def shape(f: T.StructField):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return col.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(col.cast("double"), 6).alias(f.name)
        return col

    return df.select(*[shape(f) for f in df.schema.fields])
