"""Registered queries: user functions (U1-U3) and the byte-compatible payload hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.functions import udf as U
from jobscope.plans.oracle import with_adapters
from jobscope.plans.registry import register
from jobscope.sources import adapters as A


@register("u1_steps", with_adapters("""
SELECT payload_id, custkey % 3 <> 0 AND status <> 'job-queued' AS "continue", CASE WHEN custkey % 3 <> 0 AND status <> 'job-queued' THEN 'ran ' || job_type END AS result,
       CASE WHEN custkey % 3 <> 0 AND status <> 'job-queued' THEN 2 * time_limit END AS doubled FROM jobs"""))
def u1_steps(spark, sf):
    """Two pre-steps that may stop a job, the main step, and a post-step."""
    jobs = A.jobs(spark, sf).select("payload_id", "custkey", "status", "job_type", "time_limit")
    out = U.register_steps(
        jobs, lambda d: d.withColumn("result", F.concat(F.lit("ran "), "job_type")),
        pre=[lambda d: d.withColumn("continue", F.col("custkey") % 3 != 0)], builtin_pre=[lambda d: d.withColumn("continue", F.col("status") != "job-queued")],
        post=[lambda d: d.withColumn("doubled", 2 * F.col("time_limit"))])
    return out.select("payload_id", "continue", "result", "doubled")


def _creator(payload: dict, job_type: str) -> list[dict]:
    return [{"job_name": f"{job_type}/{i}", "job_queue": f"q{i}", "payload": {"part": i, "of": payload["n"]}} for i in range(payload["n"])]


@register("u2_job_creator", with_adapters("""
WITH s AS (SELECT payload_id, job_type, custkey % 4 AS n, custkey % 7 = 0 AS broken FROM jobs)
SELECT payload_id AS spec_id, job_type || '/' || i AS job_name, job_type, 'q' || i AS job_queue, '{"of": ' || n || ', "part": ' || i || '}' AS payload, 'job-queued' AS status, false AS failed
FROM s, range(0, 4) r(i) WHERE i < n AND NOT broken
UNION ALL SELECT payload_id, NULL, job_type, NULL, NULL, 'job-failed', true FROM s WHERE broken"""))
def u2_job_creator(spark, sf):
    """A user's creator over every job spec; a payload that can't be read is a failed row."""
    n = F.concat(F.lit('{"n": '), (F.col("custkey") % 4).cast("string"), F.lit("}"))
    specs = A.jobs(spark, sf).select(F.col("payload_id").alias("spec_id"), F.when(F.col("custkey") % 7 == 0, "{broken").otherwise(n).alias("payload"), "job_type")
    return U.job_creator(specs, _creator).withColumn("failed", F.col("error").isNotNull()).drop("error")


@register("u3_metadata", with_adapters("""
SELECT id, 'cat/' || dataset || '/' || id AS path, dataset AS source, CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE id END AS name FROM catalog_docs"""))
def u3_metadata(spark, sf):
    """Metadata from every dataset's path; what a dataset has already wins."""
    docs = A.catalog_docs(spark, sf).select(
        "id", F.concat(F.lit("cat/"), "dataset", F.lit("/"), "id").alias("path"),
        F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("name"), F.lit("given"))).alias("metadata"))
    out = U.metadata_extractor(docs, lambda path, _: {"source": path.split("/")[1], "name": path.split("/")[2]})
    return out.select("id", "path", F.col("metadata")["source"].alias("source"), F.col("metadata")["name"].alias("name"))


@register("p8_payload_hash_compatible", with_adapters("""
SELECT payload_id, md5('{"a": {"x": ' || custkey || ', "y": ["' || replace(celery_hostname, 'w', '\\u00e9') || '", null]}, "k": "' || job_type || '"}') AS payload_hash FROM jobs"""))
def p8_payload_hash_compatible(spark, sf):
    """P8, byte-compatible form, on nested payloads with keys out of order."""
    payload = F.concat(F.lit('{"k":"'), "job_type", F.lit('", "a":{"y":["'), F.replace("celery_hostname", F.lit("w"), F.lit("é")), F.lit('",null],"x":'),
                       F.col("custkey").cast("string"), F.lit("}}"))
    return A.jobs(spark, sf).select("payload_id", U.payload_hash_udf(payload).alias("payload_hash"))
