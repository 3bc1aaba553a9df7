"""Readers S2-S4, S7, S8 and the daily metric and union sinks S10, S12 on small files."""

import json

import pytest
from pyspark.sql import functions as F

from jobscope.sources import readers as RD
from jobscope.sources import sinks as SK


def put(path, *docs):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs) + "\n")


def test_task_worker_and_custom_events(spark, tmp_path):
    put(tmp_path / "t" / "a.json", {"uuid": "t1", "status": "task-failed", "@timestamp": "2024-01-01T00:00:00Z", "event": {"exception": "E()", "traceback": "tb"}}, "{broken")
    rows, bad = RD.read_task_events(spark, str(tmp_path / "t"), with_quarantine=True)
    r = rows.first()
    assert (r.uuid, r.status, r.event.exception, str(r.ts)) == ("t1", "task-failed", "E()", "2024-01-01 00:00:00") and bad.count() == 1
    put(tmp_path / "w" / "a.json", {"celery_hostname": "h1", "status": "worker-offline", "tags": ["x"], "@timestamp": "2024-01-01T00:00:00.5Z"})
    w = RD.read_worker_events(spark, str(tmp_path / "w")).first()
    assert (w.celery_hostname, w.status, w.tags) == ("h1", "worker-offline", ["x"])
    put(tmp_path / "c" / "a.json", {"uuid": "e1", "type": "note", "status": "s", "hostname": "h", "tags": ["a"], "@timestamp": "2024-01-01T00:00:00Z"})
    c = RD.read_custom_events(spark, str(tmp_path / "c")).first()
    assert (c.uuid, c.type, c.hostname) == ("e1", "note", "h")


def test_job_info_keeps_the_allowed_fields(spark, tmp_path):
    put(tmp_path / "a.json", {"job_type": "t", "secret": 1, "job": {"job_info": {"job_queue": "q", "duration": 1.5, "facts": {"a": 1}, "cmd": "rm"}}})
    r = RD.read_job_info(spark, str(tmp_path)).first().asDict()
    assert r["job_type"] == "t" and r["job_queue"] == "q" and r["duration"] == "1.5" and json.loads(r["facts"]) == {"a": 1}
    assert "cmd" not in r and "secret" not in r and r["status"] is None


def test_instance_stats_pick_their_disks(spark, tmp_path):
    disk = {"all": [{"mount_point": "/", "total": 10, "percent": 5.0}, {"mount_point": "/data", "total": 20}, {"mount_point": "/x", "total": 1}]}
    put(tmp_path / "a.json", {"host": "h", "@timestamp": "2024-01-01T00:00:00Z", "cpu": 0.5, "disk": disk}, {"host": "g", "disk": {"all": []}})
    got = {r.host: r for r in RD.read_instance_stats(spark, str(tmp_path)).collect()}
    assert got["h"].disk_root.total == 10 and got["h"].disk_data.total == 20 and str(got["h"].ts) == "2024-01-01 00:00:00"
    assert got["g"].disk_root is None and got["g"].ts is None


def test_usage_stats_skip_what_is_unreadable_and_step_metrics_do_not(spark, tmp_path):
    schema = "name string, cpu double"
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(schema)
    put(tmp_path / "j1" / "_docker_stats.json", {"name": "a", "cpu": 1.0})
    put(tmp_path / "j2" / "deep" / "_docker_stats.json", [{"name": "b", "cpu": 2.0}, {"name": "c"}])
    put(tmp_path / "j3" / "_docker_stats.json", "{not json")
    put(tmp_path / "j3" / "other.json", {"name": "z"})
    got = sorted((r.name, r.cpu, r.file_path.split("/")[-2]) for r in RD.read_usage_stats(spark, str(tmp_path), kinds).collect())
    assert got == [("a", 1.0, "j1"), ("b", 2.0, "deep"), ("c", None, "deep")]
    free = RD.read_usage_stats(spark, str(tmp_path)).select(F.try_variant_get("stats", "$.name", "string").alias("n")).collect()
    assert {r.n for r in free} == {"a", None}
    put(tmp_path / "j1" / "pge_metrics.json", {"name": "m", "cpu": 3.0})
    assert RD.read_step_metrics(spark, str(tmp_path), kinds).first().name == "m"
    put(tmp_path / "j4" / "pge_metrics.json", "{")
    with pytest.raises(Exception, match="unreadable"):
        RD.read_step_metrics(spark, str(tmp_path), kinds).collect()


def test_configurations_and_rules(spark, tmp_path):
    put(tmp_path / "d.json", {"datasets": [{"match_pattern": "a", "ipath": "x/y"}, {"match_pattern": "b", "alt_match_pattern": "c"}]})
    got = RD.read_dataset_config(spark, str(tmp_path / "d.json")).orderBy("position").collect()
    assert [(r.position, r.match_pattern, r.alt_match_pattern) for r in got] == [(0, "a", None), (1, "b", "c")]
    put(tmp_path / "bad.json", {"datasets": [{"ipath": "x/y"}]})
    with pytest.raises(ValueError):
        RD.read_dataset_config(spark, str(tmp_path / "bad.json"))
    put(tmp_path / "r.json", {"rule_name": "on", "enabled": True}, {"rule_name": "off", "enabled": False}, {"rule_name": "unset"})
    assert [r.rule_name for r in RD.read_rules(spark, str(tmp_path / "r.json")).collect()] == ["on"]
    put(tmp_path / "o.json", {"configs": [{"job_type": "t", "job_creators": [{"job_name": "a", "function": "f", "job_queues": ["q1", "q2"]}, {"job_name": "b"}]}]})
    rows = sorted((r.job_type, r.job_name, r.job_queue or "") for r in RD.read_orchestrator_config(spark, str(tmp_path / "o.json")).collect())
    assert rows == [("t", "a", "q1"), ("t", "a", "q2"), ("t", "b", "")]


def test_daily_metrics_and_the_union_of_tables(spark, tmp_path):
    rows = spark.createDataFrame([("metrics", "2024-01-01 00:00:00", 1), ("log", "2024-01-02 03:00:00", 2)], "stream string, at string, v int")
    rows = rows.withColumn("sdswatch_timestamp", F.col("at").cast("timestamp")).drop("at")
    SK.write_metrics_daily(rows, str(tmp_path / "m"))
    one = spark.read.parquet(str(tmp_path / "m")).where("stream = 'log'")
    assert [(str(r.day), r.v) for r in one.collect()] == [("2024-01-02", 2)]
    both = SK.union_current(spark.createDataFrame([(1, "a")], "n int, x string"), spark.createDataFrame([(2, 3.0)], "n int, y double"))
    assert sorted((r.n, r.x, r.y) for r in both.collect()) == [(1, "a", None), (2, None, 3.0)]
