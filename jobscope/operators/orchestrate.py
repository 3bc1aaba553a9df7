"""Job specs to job rows: configuration fan-out, worker configuration,
status lookup (J16, J17, J21), and a size-checked broadcast helper.

Configuration tables are small by nature, but "small" is checked, not
assumed: ``checked_broadcast`` hints a broadcast only when a bounded
``limit(n+1).count()`` proves the side has at most ``n`` rows; otherwise
the join stays a shuffle join (and AQE may still broadcast it from runtime
statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.functions.columns import job_type_of, short_error

BROADCAST_MAX_ROWS = 100_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` when it provably holds at most ``max_rows`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def fan_out_jobs(specs: DataFrame, config: DataFrame, default_queue: str = "default",
                 orch_queue: str = "orchestrator") -> DataFrame:
    """Job spec -> job rows.

    ``specs``: spec_id, job_type, job_queue, payload.  ``config``: job_type,
    job_name, function, job_queues (array).  Each configured creator of the
    spec's type yields one job per queue (the spec's own queue when the
    creator lists none).  A type without configuration gets the catch-all
    creator (type prefix stripped).  A spec without type or payload is one
    ``job-failed`` row.
    """
    cfg = checked_broadcast(config.select("job_type", "job_name", "function", "job_queues"))
    bad = F.col("job_type").isNull() | F.col("payload").isNull()
    err_text = F.concat(F.lit(f"Error queueing job from {orch_queue}: Invalid job spec. No '"),
                        F.when(F.col("job_type").isNull(), "job_type").otherwise("payload"), F.lit("' specified."))
    failed = specs.filter(bad).select(
        "spec_id", "job_type", F.lit(None).cast("string").alias("job_name"), F.lit(None).cast("string").alias("function"),
        F.lit(None).cast("string").alias("job_queue"), F.lit("job-failed").alias("status"), err_text.alias("error"))
    ok = specs.filter(~bad).select("spec_id", "job_type", F.col("job_queue").alias("_spec_queue"))
    joined = ok.join(cfg, "job_type", "left")
    configured = joined.filter(F.col("function").isNotNull()).select(
        "spec_id", "job_type", "job_name", "function",
        F.explode(F.when(F.size(F.coalesce("job_queues", F.array())) > 0, F.col("job_queues"))
                  .otherwise(F.array(F.coalesce(F.col("_spec_queue"), F.lit(default_queue))))).alias("job_queue"))
    catch_all = joined.filter(F.col("function").isNull()).select(
        "spec_id", "job_type", job_type_of("job_type").alias("job_name"), F.lit("catch_all").alias("function"),
        F.coalesce(F.col("_spec_queue"), F.lit(default_queue)).alias("job_queue"))
    made = configured.unionByName(catch_all).withColumns(
        {"status": F.lit("job-queued"), "error": F.lit(None).cast("string")})
    return made.unionByName(failed)


def worker_config_for(jobs: DataFrame, configs: DataFrame, type_col: str = "type") -> DataFrame:
    """Each job's work configuration by job type; a type without one
    gives a ``job-failed`` row with the error."""
    cfg = checked_broadcast(configs.withColumn("_has_cfg", F.lit(True)))
    df = jobs.join(cfg, type_col, "left")
    err = F.concat(F.lit("No work configuration for type '"), F.col(type_col), F.lit("'."))
    missing = F.col("_has_cfg").isNull()
    return df.withColumns({
        "status": F.when(missing, F.lit("job-failed")),
        "error": F.when(missing, err),
        "short_error": F.when(missing, short_error(err)),
    }).drop("_has_cfg")


def lookup_status(ids: DataFrame, jobs: DataFrame, key: str = "payload_id") -> DataFrame:
    """Stored status by id; unknown ids get a null status and
    ``found = false``."""
    j = jobs.select(key, "status").withColumn("found", F.lit(True))
    return ids.join(j, key, "left").withColumn("found", F.coalesce(F.col("found"), F.lit(False)))
