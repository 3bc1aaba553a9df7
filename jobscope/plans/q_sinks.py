"""Registered queries: sinks that keep documents by id (S9) and upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobscope.plans.oracle import with_adapters
from jobscope.plans.registry import register
from jobscope.session import checkpoint_dir
from jobscope.sources import adapters as A
from jobscope.sources import sinks as SK

#: The log is written in two batches, before and from this instant.
CUT = "2024-01-15 00:00:00"


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s9_documents_by_id", with_adapters("""
WITH e AS (SELECT *, 'job_status-' || strftime(ts, '%Y.%m.%d') AS home, status = 'job-failed' AS failed FROM job_events),
w AS (
  SELECT if(failed, 'job_failed', home) AS "table", payload_id AS document_id, status, ts, seq, false AS gone FROM e
  UNION ALL SELECT home, payload_id, status, ts, seq, true FROM e WHERE failed),
r AS (SELECT *, row_number() OVER (PARTITION BY "table", document_id ORDER BY ts DESC, seq DESC) AS rn FROM w)
SELECT "table", document_id, status, ts, seq FROM r WHERE rn = 1 AND NOT gone"""))
def s9_documents_by_id(spark, sf):
    """The job log as documents by id in daily tables, failed ones moved;
    written in two batches, of which the first is replayed."""
    ev = A.job_events(spark, sf).select("resource", "payload_id", "uuid", "celery_hostname", "status", "ts", "seq")
    base = _folder(spark, "documents")
    early = F.col("ts") < F.lit(CUT).cast("timestamp")
    for batch, part in (("0", ev.where(early)), ("1", ev.where(~early)), ("0", ev.where(early))):
        SK.write_documents(part, base, batch=batch)
    return SK.read_documents(spark, base).select("table", "document_id", "status", "ts", "seq")


@register("s11_upsert", with_adapters("""
SELECT id, system_version, n_chars, CASE WHEN n_chars > 1000 THEN 2 ELSE 1 END AS written FROM catalog_docs"""))
def s11_upsert(spark, sf):
    """All catalog documents, then the long ones again."""
    docs = A.catalog_docs(spark, sf).select("id", "system_version", "n_chars")
    table = _folder(spark, "catalog")
    SK.upsert_all_or_nothing(docs.withColumn("written", F.lit(1)), table)
    SK.upsert_all_or_nothing(docs.where("n_chars > 1000").withColumn("written", F.lit(2)), table)
    return SK.read_current(spark, table)
