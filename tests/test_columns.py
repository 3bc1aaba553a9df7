"""Scalar column functions against the reference's fixed cases."""

from pyspark.sql import functions as F

from jobscope.functions import columns as C


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_failure_class_cases(spark):
    cases = {
        "SoftTimeLimitExceeded()": None,
        "billiard.exceptions.SoftTimeLimitExceeded()": None,
        "SoftTimeLimitExceeded('soft time limit exceeded')": None,
        "TimeLimitExceeded(3600,)": "TimeLimitExceeded",
        "billiard.exceptions.TimeLimitExceeded(3600,)": "TimeLimitExceeded",
        "WorkerLostError('Worker exited prematurely: signal 9 (SIGKILL).')": "WorkerLostError",
        "ConnectionError('Connection reset by peer')": "ConnectionError",
        None: None,
    }
    for text, want in cases.items():
        assert one(spark, C.failure_class, text) == want, text


def test_metric_number(spark):
    yes = {"7": 7.0, "-3": -3.0, "1.0": 1.0, "0.25": 0.25, "0": 0.0}
    no = ["007", "1.50", "1e3", "+1", "", "-0", "abc", "1."]
    for t, v in yes.items():
        assert one(spark, C.metric_number, t) == v, t
    for t in no:
        assert one(spark, C.metric_number, t) is None, t


def test_short_error(spark):
    s = "x" * 20 + "middle part" + "y" * 10
    assert one(spark, C.short_error, s) == "x" * 20 + "....." + "y" * 10
    assert one(spark, C.short_error, "short") == "short"
    assert one(spark, C.short_error, "a" * 35) == "a" * 35


def test_parse_and_format_iso(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456Z",), ("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",),
                                ("2024-01-02T03:04:05.5Z",)], "x string")
    out = df.select(C.parse_iso_utc("x").alias("t")).select(C.format_iso("t").alias("s")).collect()
    assert [r.s for r in out] == ["2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05Z", None, "2024-01-02T03:04:05.500000Z"]


def test_bytes_and_pct(spark):
    df = spark.createDataFrame([("10GB",), ("5MB",), ("3KB",)], "x string")
    got = [r.b for r in df.select(C.bytes_from_size("x").alias("b")).collect()]
    assert got == [10 * 1024**3, 5 * 1024**2, 3 * 1024]
    assert one(spark, lambda c: C.bytes_from_size(c, strict=False), "10TB") is None
    pct = spark.range(1).select(C.required_free_pct(F.lit(1000), F.lit(15)).alias("p")).first().p
    assert pct == 2


def test_valid_partition_pattern(spark):
    cases = {",a": False, "a,": False, "*": False, "**": False, "cat_*": True, "a,b": True, "": True}
    for t, want in cases.items():
        assert one(spark, C.valid_partition_pattern, t) is want, t


def test_clamp_counters(spark):
    from decimal import Decimal as D

    df = spark.createDataFrame(
        [((D(9223372036854771712), D(18446744073709551615), [D(5), D(18446744073709551615)]),)],
        "cgroups struct<limit: decimal(20,0), usage: decimal(20,0), per: array<decimal(20,0)>>",
    )
    r = C.clamp_counters(df).first().cgroups
    assert r.limit == 9223372036854771712 and r.usage == -1 and list(r.per) == [5, -1]


def test_status_ttl_and_limits(spark):
    df = spark.createDataFrame([("600",), ('"600"',), ("true",), (None,), ("100000",)], "x string")
    got = [r.t for r in df.select(C.status_ttl("x", 86400, 60).alias("t")).collect()]
    assert got == [86400, 86400, 86400, 86400, 100120]


def test_job_type_and_triage(spark):
    assert one(spark, C.job_type_of, "job:foo:bar") == "foo:bar"
    assert one(spark, C.job_type_of, "plain") == "plain"
    assert one(spark, C.data_type_of, "dataset:cat::data/L2_x") == "L2_x"
    df = spark.createDataFrame([("triaged_job-abc_task-x", "t1", None), ("j2", "t2", "id-{job_id}-{job[task_id]}"),
                                ("j3", "t3", "bad-{nope}")], "job_id string, task_id string, fmt string")
    got = [r.i for r in df.select(C.triage_id("job_id", "task_id", F.col("fmt")).alias("i")).collect()]
    assert got == ["triaged_job-abc_task-t1", "id-j2-t2", "triaged_job-j3_task-t3"]


def test_local_path(spark):
    df = spark.createDataFrame([("s3://b/k/f.h5", None), ("s3://b/k/f.h5", "in/"), ("s3://b/k/f.h5", "/abs/x.h5")],
                               "url string, lp string")
    got = [r.p for r in df.select(C.local_path("url", "lp", F.lit("/jobs/j1")).alias("p")).collect()]
    assert got == ["/jobs/j1/f.h5", "/jobs/j1/in/f.h5", "/abs/x.h5"]


def test_browse_images_order(spark):
    df = spark.createDataFrame([(["a.x.browse.png", "a.x.browse_small.png", "b.y.browse.png", "c.z.browse.png",
                                  "d.y.browse.png"],)], "names array<string>")
    imgs = df.select(C.browse_images("names", [r"\.y\.", r"\.x\."]).alias("i")).first().i
    assert [i.img for i in imgs] == ["d.y.browse.png", "a.x.browse.png", "c.z.browse.png"]
    assert imgs[1].small_img == "a.x.browse_small.png" and imgs[0].tooltip == "y"


def test_payload_hash_compatible(spark):
    import hashlib
    import json

    payload = {"b": 1, "a": "é", "_disk_usage": "1GB"}
    want = hashlib.md5(json.dumps({"a": "é", "b": 1}, sort_keys=True, ensure_ascii=True).encode()).hexdigest()
    got = one(spark, C.payload_hash_compatible, json.dumps(payload))
    assert got == want
