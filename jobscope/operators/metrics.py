"""Metric-log parsing (S5 layouts, P27 numbers, T7 timestamps).

Three text layouts, told apart by file name: ``*.fullkv.sdswatch.log``
(timestamp, host, source type, source id, key, value), ``*.pge.sdswatch.log``
(timestamp, key, value; source type and id come from path parts) and
``*.fulldict.sdswatch.log`` (timestamp, host, source type, source id, then
``k=v`` pairs).  Fields are comma separated with ``'`` quoting.  A line
without an ISO-8601 timestamp is dropped; the timestamp is cut to 23
characters and parsed in six layouts, UTC.  The same expression tree is
used by the batch reader and the streaming query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.columns import metric_number

# Layouts of a metric timestamp, tried in order.  Fixed values.
METRIC_TS_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss,SSS",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
)

ISO8601_IN_LINE = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)"

KV_SCHEMA = "sdswatch_timestamp string, host string, source_type string, source_id string, metric_key string, metric_value string"
PGE_SCHEMA = "sdswatch_timestamp string, metric_key string, metric_value string"
DICT_SCHEMA = "sdswatch_timestamp string, host string, source_type string, source_id string, kv string"
CSV_OPTS = {"sep": ",", "quote": "'"}


def metric_timestamp(col) -> Column:
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    cut = F.when(F.length(c) > 23, F.substring(c, 1, 23)).otherwise(c)
    return F.coalesce(*[F.try_to_timestamp(cut, F.lit(f)) for f in METRIC_TS_FORMATS])


def kind_of_path(path_col) -> Column:
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    return (F.when(p.endswith(".fullkv.sdswatch.log"), "kv").when(p.endswith(".pge.sdswatch.log"), "pge")
            .when(p.endswith(".fulldict.sdswatch.log"), "dict"))


def parse_metric_lines(lines: DataFrame, line: str = "value", path: str = "log_path", kind: str = "kind",
                       host: str | None = None) -> DataFrame:
    """Parse raw metric-log lines into metric rows.

    kv and pge lines give one row each (``metric_value_string`` and, when
    the text is a canonical number, ``metric_value_float``); a dict line
    gives one row per ``k=v`` pair.  ``host`` fills the host of pge lines.
    """
    v = F.col(line)
    has_ts = v.rlike(ISO8601_IN_LINE)
    df = lines.filter(has_ts)
    kv = F.from_csv(v, KV_SCHEMA, CSV_OPTS)
    pge = F.from_csv(v, PGE_SCHEMA, CSV_OPTS)
    dct = F.from_csv(v, DICT_SCHEMA, CSV_OPTS)
    k = F.col(kind)
    parts = F.split(F.col(path), "/")

    def strip(c):
        return F.trim(c)

    rows = df.select(
        F.col(path).alias("log_path"), k.alias("kind"),
        strip(F.when(k == "kv", kv["sdswatch_timestamp"]).when(k == "pge", pge["sdswatch_timestamp"])
              .otherwise(dct["sdswatch_timestamp"])).alias("_ts"),
        strip(F.when(k == "kv", kv["host"]).when(k == "dict", dct["host"])
              .otherwise(F.lit(host).cast("string"))).alias("host"),
        strip(F.when(k == "kv", kv["source_type"]).when(k == "dict", dct["source_type"])
              .otherwise(F.regexp_replace(F.get(parts, 8), r"\.pge\.sdswatch\.log$", ""))).alias("source_type"),
        strip(F.when(k == "kv", kv["source_id"]).when(k == "dict", dct["source_id"])
              .otherwise(F.get(parts, 7))).alias("source_id"),
        F.when(k == "kv", F.array(F.struct(strip(kv["metric_key"]).alias("k"), strip(kv["metric_value"]).alias("v"))))
        .when(k == "pge", F.array(F.struct(strip(pge["metric_key"]).alias("k"), strip(pge["metric_value"]).alias("v"))))
        .otherwise(F.transform(F.map_entries(F.str_to_map(strip(dct["kv"]), F.lit(" "), F.lit("="))),
                               lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))).alias("_kv"),
    )
    out = rows.select("*", F.explode_outer("_kv").alias("_e")).select(
        metric_timestamp("_ts").alias("sdswatch_timestamp"), "host", "source_type", "source_id",
        F.col("_e.k").alias("metric_key"), F.col("_e.v").alias("metric_value_string"),
        metric_number(F.col("_e.v")).alias("metric_value_float"), "log_path",
    )
    return out
