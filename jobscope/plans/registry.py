"""Registered queries: one per operator, each with its oracle SQL.

A registered query takes ``(spark, sf_dir)``, reads the driver tables through
the adapters and returns a DataFrame.  Its oracle is an independent ANSI SQL
statement DuckDB runs on the same parquet files; the two are compared on
row count, column names and values.  Timestamps leave as TIMESTAMP_NTZ so the
comparison does not depend on any session or process time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
BENCH: list[str] = []


def _ntz(dt: T.DataType):
    if isinstance(dt, T.TimestampType):
        return T.TimestampNTZType()
    if isinstance(dt, T.ArrayType):
        inner = _ntz(dt.elementType)
        return T.ArrayType(inner, dt.containsNull) if inner is not None else None
    if isinstance(dt, T.StructType):
        changed = False
        fields = []
        for f in dt.fields:
            inner = _ntz(f.dataType)
            changed |= inner is not None
            fields.append(T.StructField(f.name, inner or f.dataType, f.nullable))
        return T.StructType(fields) if changed else None
    return None


def finalize(df: DataFrame) -> DataFrame:
    """Comparable output: TIMESTAMP columns become TIMESTAMP_NTZ (UTC wall
    clock, independent of any session or process zone) and arrays become
    their JSON text (engine-neutral values for the oracle's hash)."""
    casts = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            casts[f.name] = F.to_json(F.col(f.name))
            continue
        nt = _ntz(f.dataType)
        if nt is not None:
            casts[f.name] = F.col(f.name).cast(nt)
    return df.withColumns(casts) if casts else df


def register(name: str, sql: str | None = None, bench: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        if bench:
            BENCH.append(name)
        return run

    return deco


def load_all() -> None:
    """Import every query family so that it registers itself."""
    from jobscope.plans import (  # noqa: F401
        q_state,
        q_columns,
        q_supervise,
        q_rules,
        q_catalog,
        q_ops,
        q_streaming,
        q_sinks,
        q_udf,
    )
