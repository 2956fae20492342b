"""Registry of named queries (Spark) and their SQL oracles (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (+ optional SQL twin)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 6, whole: Collection[str] = ()) -> DataFrame:
    """Round every double column (oracle parity: both sides round to 6 places) but those that hold ``whole`` numbers."""
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in whole
        else F.col(f.name) for f in df.schema.fields])
