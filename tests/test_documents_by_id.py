"""Documents by id (S9) and the upsert (S11): replay, moves, and writers at the same time."""

import random
import threading

from pyspark.sql import functions as F

from jobscope.sources import sinks as SK
from jobscope.sources import versions

LOG = "resource string, payload_id string, uuid string, celery_hostname string, index string, status string, ts timestamp, seq long, note string"


def log(rows):
    """(resource, id, index, status, second, note)"""
    import datetime as dt

    return [(r, i if r == "job" else None, i, i if r == "worker" else None, idx, st, dt.datetime(2024, 1, 2, 0, 0, s), s, note) for r, i, idx, st, s, note in rows]


def documents(spark, base, **kw):
    out = SK.read_documents(spark, base, **kw)
    return sorted((r.table, r.document_id, r.status, r.note) for r in out.collect()) if out is not None else []


def test_a_document_is_there_once(spark, tmp_path):
    base = str(tmp_path / "docs")
    assert SK.read_documents(spark, base) is None
    one = log([("job", "p1", "job_status-2024.01.01", "job-queued", 1, "a"), ("job", "p1", "job_status-2024.01.01", "job-started", 2, "b"),
               ("worker", "h1", None, "worker-heartbeat", 1, "w"), ("task", "t1", "task_status-x", "task-sent", 1, None), ("event", "e1", None, "x", 3, "e")])
    two = log([("job", "p1", "job_status-2024.01.01", "job-failed", 4, "c"), ("job", "p2", "job_status-2024.01.01", "job-failed", 5, "d"),
               ("worker", "h1", None, "worker-offline", 6, "w2")])
    SK.write_documents(spark.createDataFrame(one, LOG), base, batch="0")
    assert documents(spark, base, tables=["job_status-2024.01.01"]) == [("job_status-2024.01.01", "p1", "job-started", "b")]
    SK.write_documents(spark.createDataFrame(two, LOG), base, batch="1")
    want = [("event_status-2024.01.02", "e1", "x", "e"), ("job_failed", "p1", "job-failed", "c"), ("job_failed", "p2", "job-failed", "d"),
            ("task_status-x", "t1", "task-sent", None), ("worker_status-2024.01.02", "h1", "worker-offline", "w2")]
    assert documents(spark, base) == want
    SK.write_documents(spark.createDataFrame(two, LOG), base, batch="1")  # replayed
    SK.write_documents(spark.createDataFrame(one, LOG), base, batch="0")
    assert documents(spark, base) == want
    assert len(versions.newest(spark, base)[1]["layers"]) == 2
    SK.compact(spark, base)
    assert documents(spark, base) == want and len(versions.newest(spark, base)[1]["layers"]) == 1
    # a retried job is written to its own table again; the failed copy stays there as the log says nothing of it
    SK.write_documents(spark.createDataFrame(log([("job", "p1", "job_status-2024.01.01", "job-started", 9, "again")]), LOG), base, batch="2")
    assert ("job_status-2024.01.01", "p1", "job-started", "again") in documents(spark, base, ids=["p1"])
    assert {d[1] for d in documents(spark, base, ids=["p1"])} == {"p1"}


def test_layers_against_a_dictionary(spark, tmp_path):
    rng, base, store = random.Random(5), str(tmp_path / "docs"), {}
    second = 0
    for batch in range(5):
        rows = []
        for _ in range(40):
            second += 1
            i, idx = f"p{rng.randrange(15)}", rng.choice(["i1", "i2"])
            status = rng.choice(["job-queued", "job-started", "job-failed", "job-completed"])
            rows.append(("job", i, idx, status, second % 60, f"n{second}"))
            if status == "job-failed":
                store["job_failed", i] = (status, f"n{second}")
                store.pop((idx, i), None)
            else:
                store[idx, i] = (status, f"n{second}")
        df = spark.createDataFrame([(*r[:6], r[6], 1000 * batch + k, r[8]) for k, r in enumerate(log(rows))], LOG)
        SK.write_documents(df, base, batch=str(batch), order=["seq"])
        if batch == 2:
            SK.compact(spark, base)
    assert documents(spark, base) == sorted((t, i, *v) for (t, i), v in store.items())


def test_a_stream_that_is_replayed(spark, tmp_path):
    rows = log([("job", f"p{i % 4}", "i", "job-started" if i % 3 else "job-failed", i, f"n{i}") for i in range(12)])
    src, base = str(tmp_path / "src"), str(tmp_path / "docs")
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], LOG).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    SK.write_documents_stream(read(), base, str(tmp_path / "ck")).awaitTermination()
    first = documents(spark, base)
    assert len(versions.newest(spark, base)[1]["layers"]) == 3
    SK.write_documents_stream(read(), base, str(tmp_path / "ck")).awaitTermination()
    assert documents(spark, base) == first and first


def test_upserts_at_the_same_time_both_land(spark, tmp_path):
    table, errors = str(tmp_path / "catalog"), []
    SK.upsert_all_or_nothing(spark.createDataFrame([("a", 0), ("z", 0)], "id string, v int"), table)

    def upsert(k):
        try:
            SK.upsert_all_or_nothing(spark.createDataFrame([(f"k{k}", k), ("a", k), ("shared", k)], "id string, v int"), table)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=upsert, args=(k,)) for k in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = sorted((r.id, r.v) for r in SK.read_current(spark, table).collect())
    assert [g for g in got if g[0].startswith("k")] == [(f"k{k}", k) for k in range(1, 5)]
    assert [g[0] for g in got] == ["a", "k1", "k2", "k3", "k4", "shared", "z"]
    assert dict(got)["a"] == dict(got)["shared"] and versions.newest(spark, table)[0] == 5


def test_an_upsert_between_reading_and_committing(spark, tmp_path, monkeypatch):
    table, done = str(tmp_path / "catalog"), []
    SK.upsert_all_or_nothing(spark.createDataFrame([("a", 1)], "id string, v int"), table)
    commit = versions.commit

    def late(spark_, base, number, content):
        if not done:
            done.append(1)
            SK.upsert_all_or_nothing(spark.createDataFrame([("b", 2), ("a", 5)], "id string, v int"), table)
        return commit(spark_, base, number, content)

    monkeypatch.setattr(versions, "commit", late)
    SK.upsert_all_or_nothing(spark.createDataFrame([("c", 3), ("a", 7)], "id string, v int"), table)
    assert sorted((r.id, r.v) for r in SK.read_current(spark, table).collect()) == [("a", 7), ("b", 2), ("c", 3)]


def test_empty_upserts_null_keys_and_new_columns(spark, tmp_path):
    table = str(tmp_path / "catalog")
    SK.upsert_all_or_nothing(spark.createDataFrame([], "id string, v int"), table)
    assert SK.read_current(spark, table).count() == 0
    for k in range(3):
        SK.upsert_all_or_nothing(spark.createDataFrame([(None, k)], "id string, v int"), table)
    SK.upsert_all_or_nothing(spark.createDataFrame([("a", 1)], "id string, v int").withColumn("extra", F.lit("x")), table)
    assert sorted(map(tuple, SK.read_current(spark, table).collect()), key=str) == [("a", 1, "x"), (None, 2, None)]
    assert SK.read_current(spark, str(tmp_path / "none")) is None
