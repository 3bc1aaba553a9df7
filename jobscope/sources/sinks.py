"""Sinks (S9-S12).

Routed documents (S9) are layers merged by document id on reading; metrics are
partitioned by stream and day, so that readers prune.  The all-or-nothing upsert
(S11) writes new files of the key buckets it touches.  Both commit a numbered
state of the table, so a failed write leaves the one before intact and writers
at the same time don't lose each other's rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.session import stored
from jobscope.sources import versions
from jobscope.sources.documents import (  # noqa: F401 - S9
    compact,
    read_documents,
    route_table,
    write_documents,
    write_documents_stream,
)


def write_metrics_daily(df: DataFrame, base: str, stream: str = "stream", ts: str = "sdswatch_timestamp",
                        mode: str = "append") -> None:
    """Metric and log documents into daily partitions per stream."""
    df.withColumn("day", F.to_date(ts)).write.mode(mode).partitionBy(stream, "day").parquet(base)


#: Key buckets of a catalog table; the number is fixed when a table is made.
BUCKETS = 64


def current_version(spark: SparkSession, table: str) -> str | None:
    m = versions.newest(spark, table)[1]
    return m["version"] if m else None


def read_current(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of the newest version (None before the first upsert)."""
    m = versions.newest(spark, table)[1]
    return _read_buckets(spark, table, m, sorted(m["buckets"])) if m else None


def _read_buckets(spark: SparkSession, table: str, m: dict, buckets: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(m["schema"]))
    if not buckets:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table}/{m['buckets'][b]}/bucket={b}" for b in buckets])


def upsert_all_or_nothing(df: DataFrame, table: str, key: str = "id", order: str | None = None) -> str:
    """Bulk upsert of catalog rows; either every row lands or none.

    Of incoming rows with one key the last by ``order`` (else the largest row)
    counts; a null key is one key.  The incoming rows are computed once, into
    the shared folder.  Only the key buckets that have incoming rows are
    rewritten, in folders with names of their own, so that what a failed write
    left behind is in nobody's way; then the next state of the table is
    committed.  If another upsert was first, the buckets that it changed are
    merged again from its state, so both land.  Returns the version's name.
    """
    spark = df.sparkSession
    m = versions.newest(spark, table)[1]
    n = m["n"] if m else BUCKETS
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    rest = [c for c in df.columns if c != key]
    row = F.struct(*([order] if order else []), *[c for c in rest if c != order])
    new = df.groupBy(key).agg(F.max(row).alias("_row")).select(key, "_row.*").select(*df.columns)
    new = stored(new.withColumn("bucket", bucket), "upsert")
    # at most n rows
    touched = sorted(str(r.bucket) for r in new.select("bucket").distinct().collect())
    merged: dict[str, tuple] = {}  # of a bucket, the folder it was merged from and the one that was written

    def merge(state: dict | None) -> dict:
        before = state["buckets"] if state else {}
        due = [b for b in touched if b not in merged or merged[b][0] != before.get(b)]
        folder = f"v_{uuid.uuid4().hex}"
        if due:
            rows = new.where(F.col("bucket").isin([int(b) for b in due])).drop("bucket")
            there = [b for b in due if b in before]
            if there:
                gone = rows.select(F.col(key).alias("_new"))
                prev = _read_buckets(spark, table, state, there)
                rows = prev.join(gone, F.col(key).eqNullSafe(F.col("_new")), "left_anti").unionByName(rows, allowMissingColumns=True)
            rows.withColumn("bucket", bucket).repartition(len(due), "bucket").write.partitionBy("bucket").parquet(f"{table}/{folder}")
            merged.update({b: (before.get(b), folder) for b in due})
        old = T.StructType.fromJson(json.loads(state["schema"])) if state else T.StructType()
        fields = {f.name: f for f in [*old.fields, *new.drop("bucket").schema.fields]}
        version = f"v_{int(state['version'].split('_')[1]) + 1 if state else 1:08d}_{uuid.uuid4().hex[:8]}"
        return {"version": version, "n": n, "schema": T.StructType(list(fields.values())).json(), "buckets": {**before, **{b: merged[b][1] for b in touched}}}

    return versions.change(spark, table, merge)["version"]


def union_current(*dfs: DataFrame) -> DataFrame:
    """One view across daily tables and the failed table."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
