import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from graphloam.schemas import DELIVERIES, WEBHOOK_EVENTS
from graphloam.streaming import jobs, webhooks, windows

SECRET, NOW = "s3cret", dt.datetime(2024, 5, 1, 12)


def delivery(number, repo="r1", event="push", ref="refs/heads/main", after="new", sign=True, did="d"):
    body = json.dumps({"ref": ref, "after": after, "repository": {"full_name": "o/r", "default_branch": "main"}, "head_commit": {"id": after, "message": "m"}}).encode()
    sig = "sha256=" + hmac.new(SECRET.encode(), body, hashlib.sha256).hexdigest() if sign else "sha256=" + "0" * 64
    return repo, body, f"{did}{number}" if did is not None else None, event, sig, NOW + dt.timedelta(seconds=number)


def repositories(spark):
    return spark.createDataFrame([("r1", SECRET, None, "main", "old"), ("r2", None, None, "main", "old"), ("r3", SECRET, "dev", "main", "old")], "id string, webhookSecret string, trackedBranch string, defaultBranch string, currentCommitHash string")


CASES = [
    (delivery(0, did=None), "missing_delivery"), (delivery(99), "duplicate"), (delivery(2, repo="zz"), "unknown_repository"), (delivery(3, repo="r2"), "unconfigured"), (delivery(4, sign=False), "bad_signature"),
    (delivery(5), "accepted"), (delivery(6, after="old"), "skipped"), (delivery(7, ref="refs/heads/x"), "skipped"), (delivery(8, event="ping"), "skipped"), (delivery(9, repo="r3"), "skipped"), (delivery(10, repo="r3", ref="refs/heads/dev"), "accepted"), (delivery(11, event="issues"), "skipped"),
]


def test_gates_in_order(spark):
    audit = spark.createDataFrame([("x", "r1", "push", "d99", NOW, None, "ACCEPTED", "h", None)], WEBHOOK_EVENTS)
    rows = webhooks.route(spark.createDataFrame([c for c, _ in CASES], DELIVERIES), repositories(spark), audit)
    assert [r["outcome"] for r in rows.orderBy("receivedAt").collect()] == [o for c, o in sorted(CASES, key=lambda x: x[0][-1])]
    written = webhooks.audit_rows(rows).collect()
    assert {r["status"] for r in written} == {"ACCEPTED", "SKIPPED"} and len(written) == 7 and all(len(r["payloadHash"]) == 64 for r in written)
    assert webhooks.job_rows(rows).count() == 2


def test_stream_is_idempotent(spark, tmp_path):
    source, audit, queue, check = (str(tmp_path / n) for n in ("in", "audit", "jobs", "ck"))

    def send(*rows):
        spark.createDataFrame(list(rows), DELIVERIES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DELIVERIES).parquet(source)
        webhooks.start(stream, repositories(spark), audit, queue, check).awaitTermination()

    send(delivery(1), delivery(1), delivery(2, after="old"))
    send(delivery(1), delivery(3))
    events = spark.read.schema(WEBHOOK_EVENTS).option("recursiveFileLookup", True).parquet(audit)
    assert sorted((r["deliveryId"], r["status"]) for r in events.collect()) == [("d1", "ACCEPTED"), ("d2", "SKIPPED"), ("d3", "ACCEPTED")]
    assert spark.read.option("recursiveFileLookup", True).parquet(queue).count() == 2


def test_latest_status(spark):
    log = spark.createDataFrame([("d1", "ACCEPTED", 1), ("d1", "PROCESSED", 2), ("d2", "FAILED", 1)], "deliveryId string, status string, at int")
    assert {r["deliveryId"]: r["status"] for r in webhooks.event_status(log).collect()} == {"d1": "PROCESSED", "d2": "FAILED"}


def test_retries():
    slept, tried = [], []

    def flaky():
        tried.append(1)
        if len(tried) < 3:
            raise ValueError

    assert jobs.with_retries(flaky, sleep=slept.append) == 3 and slept == [5.0, 10.0]
    with pytest.raises(ValueError):
        jobs.with_retries(lambda: (_ for _ in ()).throw(ValueError()), sleep=slept.append)
    count = []

    def hopeless():
        count.append(1)
        raise jobs.Unrecoverable

    with pytest.raises(jobs.Unrecoverable):
        jobs.with_retries(hopeless, sleep=slept.append)
    assert len(count) == 1


def test_worker_goes_on_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "q")
    spark.createDataFrame([("r", "j1", "t", "w"), ("r", "j2", "t", "w")], "repositoryId string, jobId string, triggeredBy string, webhookEventId string").write.parquet(path)
    done, bad = [], []

    def work(job):
        if job["jobId"] == "j1":
            raise jobs.Unrecoverable
        done.append(job["jobId"])

    stream = spark.readStream.schema("repositoryId string, jobId string, triggeredBy string, webhookEventId string").parquet(path)
    jobs.start_worker(stream, work, str(tmp_path / "c"), lambda j, e: bad.append(j["jobId"])).awaitTermination()
    assert done == ["j2"] and bad == ["j1"]


def test_pool_runs_each_job_once(spark, tmp_path):
    schema = "repositoryId string, jobId string, triggeredBy string, webhookEventId string"
    path, runs = f"file://{tmp_path}/q", tmp_path / "runs"
    runs.mkdir()
    put = lambda *names: spark.createDataFrame([("r", n, "t", "w") for n in names], schema).coalesce(1).write.mode("append").parquet(path)

    def work(job, attempt):
        (runs / f"{job['jobId']}-{attempt}-{len(list(runs.iterdir()))}").touch()
        if job["jobId"] == "bad" or attempt < 2:
            raise jobs.Unrecoverable("no") if job["jobId"] == "bad" else ValueError("again")
        return job["jobId"].upper()

    def pool(name):
        jobs.start_pool(spark.readStream.schema(schema).parquet(path), work, f"file://{tmp_path}/{name}", f"file://{tmp_path}/done", 3, pause_ms=0).awaitTermination()
        return sorted(map(tuple, spark.read.schema(jobs.RESULT).parquet(f"file://{tmp_path}/done").select("jobId", "status", "attempts", "result", "error").collect()))

    put("a", "bad", "b", "a")
    first = [("a", "DONE", 2, "A", None), ("b", "DONE", 2, "B", None), ("bad", "FAILED", 1, None, "Unrecoverable: no")]
    assert pool("one") == first and len(list(runs.iterdir())) == 5
    put("c")
    assert pool("two") == sorted([*first, ("c", "DONE", 2, "C", None)]) and len(list(runs.iterdir())) == 7  # another checkpoint, only what is left
    assert len(pool("one")) == 4 and len(list(runs.iterdir())) == 7


def test_windows(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, NOW), (1, "a", 2.0, NOW + dt.timedelta(minutes=20)), (1, "b", 4.0, NOW + dt.timedelta(minutes=70))], "user_id long, event_type string, value double, ts timestamp_ntz")
    assert sorted((r["event_type"], r["n"], r["total"]) for r in windows.tumbling(rows).collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert sorted(r["n"] for r in windows.sessions(rows).collect()) == [1, 2]
    assert windows.tumbling(rows.where(F.lit(False))).count() == 0
