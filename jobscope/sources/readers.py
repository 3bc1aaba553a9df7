"""Readers (S1-S8).

Logs are JSON lines read with an explicit schema (no inference) in
PERMISSIVE mode; rows that fail to parse go to a ``_quarantine`` side output
instead of failing the job.  Every reader works the same with
``streaming=True`` (``readStream``), so batch and streaming operators share
one source definition.  Files are found with ``recursiveFileLookup`` and
``pathGlobFilter``; the file a row came from is ``_metadata.file_path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.functions.columns import parse_iso_utc
from jobscope.operators.metrics import kind_of_path, parse_metric_lines
from jobscope.session import ensure_utc
from jobscope.sources.listing import list_tree, read_texts
from jobscope.sources import schemas as S

RAW_STAMP = "@timestamp"


def _lines(spark: SparkSession, path: str, streaming: bool, glob: str | None = None) -> DataFrame:
    ensure_utc(spark)
    r = spark.readStream if streaming else spark.read
    r = r.format("text").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("value", F.col("_metadata.file_path").alias("file_path"))


def _raw_schema(schema: T.StructType) -> T.StructType:
    """The JSON layout of a canonical schema: timestamps are ISO text and the
    event time is ``@timestamp``."""

    def conv(dt):
        if isinstance(dt, T.TimestampType):
            return T.StringType()
        if isinstance(dt, T.StructType):
            return T.StructType([T.StructField(f.name, conv(f.dataType), True) for f in dt.fields])
        if isinstance(dt, T.ArrayType):
            return T.ArrayType(conv(dt.elementType))
        return dt

    fields = []
    for f in schema.fields:
        name = RAW_STAMP if f.name == "ts" else f.name
        fields.append(T.StructField(name, conv(f.dataType), True))
    return T.StructType(fields)


def _typed(raw: Column, schema: T.StructType) -> list[Column]:
    """Cast a parsed raw struct back to the canonical schema (ISO text -> TIMESTAMP)."""
    out = []

    def conv(c: Column, dt):
        if isinstance(dt, T.TimestampType):
            return parse_iso_utc(c)
        if isinstance(dt, T.StructType):
            return F.struct(*[conv(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields])
        return c

    for f in schema.fields:
        src = raw.getField(RAW_STAMP if f.name == "ts" else f.name)
        out.append(conv(src, f.dataType).alias(f.name))
    return out


def read_log(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False,
             glob: str | None = "*.json*", with_quarantine: bool = False):
    """Read a JSON-lines log into a canonical schema.

    Returns the parsed rows, or ``(rows, quarantine)`` with the raw lines
    that are not JSON objects."""
    lines = _lines(spark, path, streaming, glob)
    raw_schema = _raw_schema(schema)
    parsed = lines.select(F.from_json("value", raw_schema).alias("r"), F.try_parse_json("value").alias("json"), "value", "file_path")
    # a line that breaks off parses to a row of nulls: it must be whole JSON
    ok = F.col("json").isNotNull() & F.col("value").rlike(r"^\s*\{")
    rows = parsed.filter(ok).select(*_typed(F.col("r"), schema), "file_path")
    if "job" in schema.fieldNames():
        # keep the JSON token of the time limit: numbers stay numbers, quoted
        # numbers and booleans stay text (not numeric) for the watchdogs
        token = F.to_json(F.try_variant_get("json", "$.job.job_info.time_limit", "variant"))
        rows = parsed.filter(ok).select(*_typed(F.col("r"), schema), "file_path", token.alias("_tl"))
        rows = rows.withColumn("job", F.col("job").withField("job_info", F.col("job.job_info").withField("time_limit", F.col("_tl")))).drop("_tl")
    if with_quarantine:
        return rows, parsed.filter(~ok).select("value", "file_path")
    return rows


def read_job_events(spark, path, streaming=False, **kw):
    """Job status log, one row per status write."""
    return read_log(spark, path, S.JOB_EVENT, streaming, **kw)


def read_task_events(spark, path, streaming=False, **kw):
    """Task event log."""
    return read_log(spark, path, S.TASK_EVENT, streaming, **kw)


def read_worker_events(spark, path, streaming=False, **kw):
    """Worker event log."""
    return read_log(spark, path, S.WORKER_EVENT, streaming, **kw)


def read_custom_events(spark, path, streaming=False, **kw):
    """S3: custom events."""
    return read_log(spark, path, S.CUSTOM_EVENT, streaming, **kw)


def read_job_info(spark, path, streaming=False, glob="*.json*"):
    """S3: per-job metric documents projected to the allowed fields."""
    lines = _lines(spark, path, streaming, glob)
    v = F.try_parse_json(F.col("value"))

    def text(path: str) -> Column:
        """A string as it is, anything else as its JSON."""
        found = F.try_variant_get("v", path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get("v", path, "string")).otherwise(F.to_json(found))

    cols = [text(f"$.job.job_info.{f}").alias(f) for f in S.JOB_INFO_METRIC_FIELDS]
    return lines.select(v.alias("v")).select(text("$.job_type").alias("job_type"), *cols)


INSTANCE_STATS = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("@timestamp", T.StringType()),
    T.StructField("cpu", T.DoubleType()),
    T.StructField("per_cpu", T.ArrayType(T.DoubleType())),
    T.StructField("memory", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("swap", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("disk", T.StructType([T.StructField("all", T.ArrayType(T.StructType([
        T.StructField("mount_point", T.StringType()), T.StructField("total", T.LongType()),
        T.StructField("used", T.LongType()), T.StructField("free", T.LongType()),
        T.StructField("percent", T.DoubleType())])))])),
    T.StructField("disk_io", T.MapType(T.StringType(), T.LongType())),
    T.StructField("net_io", T.MapType(T.StringType(), T.LongType())),
])


def read_instance_stats(spark, path, data_mount: str = "/data", streaming: bool = False):
    """Host resource samples; the root and data disks picked out of
    ``disk.all`` by mount point."""
    r = spark.readStream if streaming else spark.read
    df = r.schema(INSTANCE_STATS).option("recursiveFileLookup", "true").json(path)
    pick = lambda m: F.get(F.filter(F.col("disk.all"), lambda d: d["mount_point"] == m), 0)
    return df.withColumns({"ts": parse_iso_utc(F.col("`@timestamp`")), "disk_root": pick("/"), "disk_data": pick(data_mount)})


METRIC_GLOBS = {"kv": "*.fullkv.sdswatch.log", "pge": "*.pge.sdswatch.log", "dict": "*.fulldict.sdswatch.log"}


def read_metric_log(spark, path, kind: str | None = None, streaming: bool = False, host: str | None = None) -> DataFrame:
    """Metric logs of the three layouts (one kind, or all kinds by file
    name) parsed into metric rows."""
    glob = METRIC_GLOBS[kind] if kind else "*.sdswatch.log"
    lines = _lines(spark, path, streaming, glob)
    lines = lines.withColumnRenamed("file_path", "log_path").withColumn("kind", kind_of_path("log_path"))
    return parse_metric_lines(lines.filter(F.col("kind").isNotNull()), host=host)


def discover_datasets(spark, root: str) -> DataFrame:
    """``X/X.dataset.json`` files below a root whose directory is named
    like the file; directories holding a ``.localized`` marker (localized
    inputs) are dropped.  Returns dir, name and the dataset JSON text.

    The tree is listed in tasks, and only the files that stay are read.
    """
    files = list_tree(spark, root)
    d = files.where(F.col("name").endswith(".dataset.json")).select(
        "path", "dir", F.regexp_extract("name", r"^(.+)\.dataset\.json$", 1).alias("name"),
    ).filter(F.col("name") == F.regexp_extract("dir", r"([^/]+)$", 1))
    markers = files.where(F.col("name") == ".localized").select("dir").distinct()
    kept = d.join(markers, "dir", "left_anti").select("path", "dir", "name")
    return read_texts(kept, name="dataset_json").select("dir", "name", "dataset_json")


def _json_files(spark, root: str, name: str, schema: T.StructType | None, fatal: bool) -> DataFrame:
    """The JSON documents in all files called ``name`` below ``root``.

    With a schema its columns, a row for each element where a file holds an
    array; without one the file's document as a VARIANT ``stats``, so that no
    file is read for its schema first.
    """
    files = read_texts(list_tree(spark, root).where(F.col("name") == name).select(F.col("path").alias("file_path")), "file_path")
    whole = F.try_parse_json("content")
    if fatal:
        files = files.withColumn("content", F.when(whole.isNull(), F.raise_error(F.concat(F.lit("unreadable: "), "file_path")).cast("string")).otherwise(F.col("content")))
    else:
        files = files.where(whole.isNotNull())
    if schema is None:
        return files.select(whole.alias("stats"), "file_path")
    return files.select(F.explode(F.from_json("content", T.ArrayType(schema))).alias("_r"), "file_path").select("_r.*", "file_path")


def read_usage_stats(spark, root: str, schema: T.StructType | None = None) -> DataFrame:
    """``_docker_stats.json`` anywhere below a root; unreadable files are skipped."""
    return _json_files(spark, root, "_docker_stats.json", schema, False)


def read_step_metrics(spark, root: str, schema: T.StructType | None = None) -> DataFrame:
    """``pge_metrics.json`` anywhere below a root; an unreadable file is fatal."""
    return _json_files(spark, root, "pge_metrics.json", schema, True)


def read_dataset_config(spark, path: str) -> DataFrame:
    """Dataset configuration ``{"datasets": [...]}``; the position of each
    entry is kept (first match wins).  A missing match pattern is an error."""
    cfg = spark.read.option("multiLine", "true").json(path)
    out = cfg.select(F.posexplode("datasets").alias("position", "d")).select("position", "d.*")
    if "alt_match_pattern" not in out.columns:
        out = out.withColumn("alt_match_pattern", F.lit(None).cast("string"))
    if "match_pattern" not in out.columns or out.filter(F.col("match_pattern").isNull()).limit(1).count():
        raise ValueError("dataset configuration entry without match_pattern")
    return out


def read_rules(spark, path: str) -> DataFrame:
    """Enabled rules only."""
    return spark.read.schema(S.RULE).json(path).filter(F.coalesce(F.col("enabled"), F.lit(False)))


def read_orchestrator_config(spark, path: str) -> DataFrame:
    """Orchestrator configuration: one row per (job type, creator, queue)."""
    cfg = spark.read.option("multiLine", "true").json(path)
    per = cfg.select(F.explode("configs").alias("c")).select(F.col("c.job_type").alias("job_type"),
                                                           F.posexplode("c.job_creators").alias("creator_pos", "jc"))
    return per.select("job_type", "creator_pos", F.col("jc.job_name").alias("job_name"),
                      F.col("jc.function").alias("function"), F.explode_outer("jc.job_queues").alias("job_queue"))
