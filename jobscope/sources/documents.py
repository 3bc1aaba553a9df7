"""Documents by id (S9): a mixed log routed to its tables, where a later write of an id replaces the earlier.

A write adds a layer: of each (table, document id) its last row, or a mark that
the document is deleted there.  A failed job's document is written to the
failed table and deleted from the one that held it (R5).  ``read_documents``
merges the layers, of each document the row of the newest layer; ``compact``
makes one layer of several.  Which layers there are stands in the folder's log
(``versions``), with the ids of the batches they come from, so a batch that is
written again changes nothing, and a reader never sees half of one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.functions.columns import daily_partition
from jobscope.operators.ops import FAILED_PARTITION
from jobscope.sources import versions

#: Buckets by document id within a table's part of a layer; fixed when a folder is made.
BUCKETS = 8


def route_table(resource: str = "resource", index: str = "index", ts: str = "ts") -> Column:
    """Destination table of a mixed log row: a job goes to its own index
    name, task rows to their index, worker and custom events to the daily
    table of their kind."""
    r = F.col(resource)
    return (
        F.when(r.isin("job", "task") & F.col(index).isNotNull(), F.col(index))
        .when(r == "job", daily_partition("job_status", ts))
        .when(r == "task", daily_partition("task_status", ts))
        .when(r == "worker", daily_partition("worker_status", ts))
        .otherwise(daily_partition("event_status", ts))
    )


def routed(df: DataFrame) -> DataFrame:
    """``df`` with table, document_id and delete_from (the table a failed job's document leaves, else null).

    A job's document id is its payload_id, a worker's its host, others' their uuid.
    """
    for name in ("index", "status", "payload_id", "celery_hostname"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    failed = F.coalesce((F.col("resource") == "job") & (F.col("status") == "job-failed"), F.lit(False))
    home = route_table()
    key = F.when(F.col("resource") == "job", F.coalesce("payload_id", "uuid")).when(F.col("resource") == "worker", F.col("celery_hostname")).otherwise(F.col("uuid"))
    return df.withColumns({
        "table": F.when(failed, F.lit(FAILED_PARTITION)).otherwise(home),
        "document_id": key,
        "delete_from": F.when(failed & (home != FAILED_PARTITION), home),
    })


def _last(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of each (table, document_id) its last row."""
    rest = [c for c in rows.columns if c not in ("table", "document_id")]
    place = F.struct(*order, *[c for c in ("_deleted",) if c in rest])
    return rows.groupBy("table", "document_id").agg(F.max_by(F.struct(*rest), place).alias("_row")).select("table", "document_id", "_row.*")


def write_documents(df: DataFrame, base: str, batch: str | None = None, order: Sequence[str] = ("ts", "seq")) -> None:
    """Add a layer with the documents of a mixed log.

    Within ``df`` the last row of a document by ``order`` counts (its columns
    that ``df`` has); against other layers the later layer.  ``batch``: a name
    by which a second write of the same rows is known and left out.  Rows
    without a document id each get one.
    """
    spark, base = df.sparkSession, base.rstrip("/")
    if batch is not None and batch in ((versions.newest(spark, base)[1] or {}).get("batches", [])):
        return
    order = [c for c in order if c in df.columns]
    rows = routed(df)
    own = [c for c in rows.columns if c not in ("table", "document_id", "delete_from")]
    rows = rows.withColumn("document_id", F.coalesce("document_id", F.concat(F.lit("auto-"), F.expr("uuid()"))))
    # each row once, and once more as a mark in the table that it leaves
    places = F.array_compact(F.array(
        F.struct(F.col("table").alias("table"), F.lit(False).alias("deleted")),
        F.when(F.col("delete_from").isNotNull(), F.struct(F.col("delete_from").alias("table"), F.lit(True).alias("deleted"))),
    ))
    rows = rows.withColumn("_place", F.explode(places)).select(F.col("_place.table").alias("table"), "document_id", F.col("_place.deleted").alias("_deleted"), *own)
    path = f"layer-{uuid.uuid4().hex}"
    schema = _write(_last(rows, order), f"{base}/{path}")

    def add(state: dict | None) -> dict | None:
        state = state or {"layers": [], "batches": [], "next": 0}
        if batch is not None and batch in state["batches"]:
            return None
        layers = [*state["layers"], {"path": path, "place": state["next"], "schema": schema}]
        return {"layers": layers, "batches": state["batches"] + ([batch] if batch is not None else []), "next": state["next"] + 1}

    versions.change(spark, base, add)


def _write(rows: DataFrame, path: str) -> str:
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).write.partitionBy("table", "bucket").parquet(path)
    return rows.schema.json()


def _layers(spark: SparkSession, base: str, layers: list[dict]) -> DataFrame | None:
    """All rows of the layers with ``_layer``, their place in the order of writes."""
    out = None
    for layer in layers:
        schema = T.StructType.fromJson(json.loads(layer["schema"]))
        rows = spark.read.schema(schema.add("bucket", T.IntegerType())).parquet(f"{base}/{layer['path']}").withColumn("_layer", F.lit(layer["place"]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_documents(spark: SparkSession, base: str, tables: Sequence[str] | None = None, ids: Sequence[str] | None = None) -> DataFrame | None:
    """The documents as they are now, of ``tables`` and ``ids`` if given: table, document_id and the rows' columns.

    Only the folders of the tables and of the ids' buckets are read.  None
    before the first write.
    """
    base = base.rstrip("/")
    state = versions.newest(spark, base)[1]
    if not state or not state["layers"]:
        return None
    rows = _layers(spark, base, state["layers"])
    if tables is not None:
        rows = rows.where(F.col("table").isin(list(tables)))
    if ids is not None:
        buckets = spark.createDataFrame([(i,) for i in ids], "id string").select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()
        rows = rows.where(F.col("bucket").isin([r.b for r in buckets]) & F.col("document_id").isin(list(ids)))
    return _last(rows.drop("bucket"), ["_layer"]).where(~F.col("_deleted")).drop("_layer", "_deleted")


def compact(spark: SparkSession, base: str) -> None:
    """Make one layer of all that are there now; layers added meanwhile stay on top.

    The files of the old layers stay for readers that have begun.
    """
    base = base.rstrip("/")
    state = versions.newest(spark, base)[1]
    if not state or len(state["layers"]) < 2:
        return
    old = {layer["path"] for layer in state["layers"]}
    rows = _last(_layers(spark, base, state["layers"]).drop("bucket"), ["_layer"]).where(~F.col("_deleted")).drop("_layer")
    path = f"layer-{uuid.uuid4().hex}"
    schema = _write(rows, f"{base}/{path}")
    place = max(layer["place"] for layer in state["layers"])

    def swap(now: dict | None) -> dict | None:
        if not now or not old <= {layer["path"] for layer in now["layers"]}:
            return None  # another compaction was first
        later = [layer for layer in now["layers"] if layer["path"] not in old]
        return {**now, "layers": [{"path": path, "place": place, "schema": schema}, *later]}

    versions.change(spark, base, swap)


def write_documents_stream(df: DataFrame, base: str, checkpoint: str, trigger: dict | None = None):
    """S9 (stream): a layer for each micro-batch, named by its id, so that a replayed batch adds nothing."""

    def batch(bdf: DataFrame, batch_id: int):
        write_documents(bdf, base, batch=f"{checkpoint}#{batch_id}")

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
