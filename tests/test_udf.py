"""UDF surface (U1-U3) and small library-only operators."""

import json

from pyspark.sql import functions as F

from jobscope.functions import columns as C
from jobscope.functions import udf as U
from jobscope.operators import catalog as K
from jobscope.operators import ops as O


def test_register_steps_pre_stop_and_post(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")

    def pre_odd(d):
        return d.withColumn("continue", F.col("n") % 2 == 1)

    def main(d):
        return d.withColumn("ran", F.lit(True))

    def post(d):
        return d.withColumn("post", F.col("n") * 10)

    out = {r.n: r for r in U.register_steps(df, main, pre=[pre_odd], post=[post]).collect()}
    assert out[1].ran and out[1].post == 10 and out[1]["continue"]
    assert out[2].ran is None and out[2]["continue"] is False
    off = U.register_steps(df, main, builtin_pre=[lambda d: d.withColumn("continue", F.lit(False))], disable_builtins=True)
    assert off.filter(F.col("ran")).count() == 3


def test_job_creator_rows_and_failures(spark):
    specs = spark.createDataFrame([("s1", json.dumps({"n": 2}), "t"), ("s2", "{bad json", "t")],
                                  "spec_id string, payload string, job_type string")

    def creator(payload, job_type):
        return [{"job_name": f"{job_type}-{i}", "job_queue": "q", "payload": {"i": i}} for i in range(payload["n"])]

    rows = sorted((r.spec_id, r.job_name, r.status) for r in U.job_creator(specs, creator).collect())
    assert rows[:2] == [("s1", "t-0", "job-queued"), ("s1", "t-1", "job-queued")]
    assert rows[2][0] == "s2" and rows[2][2] == "job-failed"


def test_metadata_extractor_existing_wins(spark):
    df = spark.createDataFrame([("/a/x.h5", {"k": "keep"})], "path string, metadata map<string,string>")
    out = U.metadata_extractor(df, lambda p, c: {"k": "new", "name": p.split("/")[-1]}).first().metadata
    assert out == {"k": "keep", "name": "x.h5"}
    assert U.metadata_extractor(df.drop("metadata"), None).first().metadata == {}


def test_execute_node_and_public_ip(spark):
    df = spark.createDataFrame([({"fqdn": "h.local", "ipaddress": "100.64.1.2"},),
                                ({"ec2_public_hostname": "pub", "fqdn": "h", "ec2_public_ipv4": "3.4.5.6"},)],
                               "facts map<string,string>")
    got = [(r.n, r.ip, r.cg) for r in df.select(C.execute_node().alias("n"), C.public_ip().alias("ip"),
                                                C.is_cgnat(C.public_ip()).alias("cg")).collect()]
    assert got == [("h.local", "100.64.1.2", True), ("pub", "3.4.5.6", False)]


def test_usage_rollup_and_build_catalog(spark):
    stats = spark.createDataFrame([("j1", 5, "a"), ("j1", 7, "b"), ("j2", 1, "c")], "job_id string, cpu long, name string")
    got = {r.job_id: (r.n_samples, r.sum_cpu, r.max_cpu) for r in O.usage_rollup(stats, numeric=["cpu"]).collect()}
    assert got == {"j1": (2, 12, 7), "j2": (1, 1, 1)}
    ds = spark.createDataFrame([("d1", "cat/area_of_interest", "v1", "L0", "area", "label")],
                               "id string, ipath string, version string, level string, type string, label string")
    rec = K.build_catalog(ds, index="cat_v1_area").first()
    assert rec.dataset == "area_of_interest" and rec.system_version == "v1" and rec.grq_index_result["index"] == "cat_v1_area"
