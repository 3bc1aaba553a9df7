"""Session construction and cluster-shared locations.

The engine is defined in UTC: every timestamp the reference handles is UTC
text, so the session zone is pinned to UTC and no operator reads the clock.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale.  AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is under the threshold), coalesces
# small shuffle partitions and splits skewed ones; hot keys (one worker or
# payload hash holding a large share of all rows) are the expected case.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def get_spark(master: str | None = None, app_name: str = "jobscope", **conf) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    Under ``spark-submit`` the master, the memory and the number of shuffle
    partitions are the cluster's; nothing here sets them unless it is given.
    Started as a plain Python program, the master is ``local[$BENCH_CPUS]`` (or
    all cores) with 8 shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "SPARK_MASTER" in os.environ
    settings = dict(DEFAULT_CONF)
    if master is None and not submitted:
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            settings["spark.sql.shuffle.partitions"] = "8"
            settings["spark.driver.memory"] = "16g"
    if n := os.environ.get("JOBSCOPE_SHUFFLE_PARTITIONS"):
        settings["spark.sql.shuffle.partitions"] = n
    settings.setdefault("spark.ui.enabled", "false")
    settings.setdefault("spark.ui.showConsoleProgress", "false")
    settings.update(conf)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


# Runtime SQL settings the operators' semantics depend on (not tuning):
# UTC is the engine's only zone; metadata merges let the later map win.
REQUIRED_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def ensure_utc(spark: SparkSession) -> None:
    """Pin the runtime settings the engine's semantics need (UTC zone, last
    map key wins) on whatever session the caller passes in."""
    for k, v in REQUIRED_RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system; the setting is read from
    the session.  Only when it is unset (tests, local runs) a fallback is set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if fallback is None:
            import tempfile

            fallback = tempfile.mkdtemp(prefix="jobscope-ckpt-")
        spark.sparkContext.setCheckpointDir(fallback)
        spark.conf.set("spark.checkpoint.dir", fallback)
        d = fallback
    else:
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:  # already set, or read-only conf in connect mode
            pass
    return d


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: cuts the lineage
    and fixes what a repeated evaluation could deal out differently."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
