"""Readers and sinks over small files written to a test folder."""

import json
import os

from pyspark.sql import functions as F

from jobscope.sources import readers as RD
from jobscope.sources import sinks as SK


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_read_job_events_quarantine_and_limit_token(spark, tmp_path):
    docs = [
        {"payload_id": "p1", "uuid": "p1", "status": "job-started", "@timestamp": "2024-01-01T00:00:00.5Z",
         "job": {"type": "t", "job_info": {"time_limit": 600, "time_start": "2024-01-01T00:00:00Z"}}},
        {"payload_id": "p2", "uuid": "p2", "status": "job-started", "@timestamp": "2024-01-01T00:00:01Z",
         "job": {"type": "t", "job_info": {"time_limit": "600"}}},
        {"payload_id": "p3", "uuid": "p3", "status": "job-queued", "@timestamp": "bad",
         "job": {"job_info": {"time_limit": True}}},
    ]
    lines = "\n".join(json.dumps(d) for d in docs) + "\nnot json at all\n"
    write(str(tmp_path / "log" / "a.json"), lines)
    rows, bad = RD.read_job_events(spark, str(tmp_path / "log"), with_quarantine=True)
    got = {r.payload_id: r for r in rows.collect()}
    assert got["p1"].job.job_info.time_limit == "600" and got["p2"].job.job_info.time_limit == '"600"'
    assert got["p3"].job.job_info.time_limit == "true" and got["p3"].ts is None
    assert str(got["p1"].ts) == "2024-01-01 00:00:00.500000"
    assert [r.value for r in bad.collect()] == ["not json at all"]


def test_discover_datasets(spark, tmp_path):
    root = tmp_path / "work"
    write(str(root / "A" / "A.dataset.json"), '{"version": "v1"}')
    write(str(root / "B" / "C.dataset.json"), '{"version": "v1"}')
    write(str(root / "D" / "D.dataset.json"), '{"version": "v1"}')
    write(str(root / "D" / ".localized"), "2024")
    got = [r.name for r in RD.discover_datasets(spark, str(root)).collect()]
    assert got == ["A"]


def test_read_metric_logs(spark, tmp_path):
    root = tmp_path / "sw"
    write(str(root / "log" / "a.fullkv.sdswatch.log"),
          "2024-01-02T03:04:05.123456Z,host1,worker,w1,cpu,'7'\n"
          "no timestamp here,host1,worker,w1,cpu,3\n"
          "2024-01-02 03:04:05.250,host1,worker,w1,mem,1.50\n")
    pge = root / "jobs" / "a" / "b" / "c" / "d" / "e" / "f" / "step.pge.sdswatch.log"
    write(str(pge), "2024-01-02T03:04:06Z,progress,0.25\n")
    write(str(root / "log" / "b.fulldict.sdswatch.log"), "2024-01-02T03:04:07.000Z,h2,svc,v1,a=1 b=x\n")
    got = sorted((r.metric_key, r.metric_value_string, r.metric_value_float, str(r.sdswatch_timestamp))
                 for r in RD.read_metric_log(spark, str(root), host="hostX").collect())
    assert ("cpu", "7", 7.0, "2024-01-02 03:04:05.123000") in got
    assert ("mem", "1.50", None, "2024-01-02 03:04:05.250000") in got
    assert ("progress", "0.25", 0.25, "2024-01-02 03:04:06") in got
    assert ("a", "1", 1.0, "2024-01-02 03:04:07") in got and ("b", "x", None, "2024-01-02 03:04:07") in got
    assert len(got) == 5


def test_upsert_all_or_nothing_and_routing(spark, tmp_path):
    table = str(tmp_path / "catalog")
    a = spark.createDataFrame([("d1", "v1"), ("d2", "v1")], "id string, version string")
    SK.upsert_all_or_nothing(a, table)
    b = spark.createDataFrame([("d2", "v2"), ("d3", "v1")], "id string, version string")
    v = SK.upsert_all_or_nothing(b, table)
    assert v.startswith("v_00000002")
    cur = {r.id: r.version for r in SK.read_current(spark, table).collect()}
    assert cur == {"d1": "v1", "d2": "v2", "d3": "v1"}
    bad = spark.createDataFrame([("d4", "x")], "id string, version string").withColumn(
        "version", F.raise_error(F.lit("boom")).cast("string"))
    try:
        SK.upsert_all_or_nothing(bad, table)
    except Exception:  # noqa: BLE001 - the failed batch must leave the old version current
        pass
    assert SK.current_version(spark, table) == v
    # the next write succeeds, and of two rows of a key one lands
    c = spark.createDataFrame([("d4", "v1"), ("d4", "v2"), ("d1", "v3")], "id string, version string")
    SK.upsert_all_or_nothing(c, table)
    cur = sorted((r.id, r.version) for r in SK.read_current(spark, table).collect())
    assert cur == [("d1", "v3"), ("d2", "v2"), ("d3", "v1"), ("d4", "v2")]
    logs = spark.createDataFrame([("job", "p1", "2024-01-02 00:00:00"), ("worker", "w1", "2024-01-03 00:00:00")],
                                 "resource string, uuid string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    SK.write_documents(logs, str(tmp_path / "routed"))
    tables = sorted(r.table for r in SK.read_documents(spark, str(tmp_path / "routed")).collect())
    assert tables == ["job_status-2024.01.02", "worker_status-2024.01.03"]
