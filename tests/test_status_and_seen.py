"""The status machine as a table and as a stream, and ids seen forever."""

import datetime as dt
import hashlib
import itertools
import random

from pyspark.sql import functions as F

from graphloam.streaming import status
from graphloam.streaming.seen import SeenIds

START = dt.datetime(2024, 1, 1)


def events(seed: int, deliveries: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(f"d{i}", START + dt.timedelta(minutes=rng.randrange(300)), rng.choice(["PENDING", "PENDING", "ACCEPTED", "SKIPPED", "PROCESSED", "FAILED", "STRANGE"])) for i in range(deliveries) for _ in range(rng.randrange(1, 7))]


def brute(rows: list[tuple]) -> list[tuple]:
    legal = {("", "PENDING"), ("PENDING", "SKIPPED"), ("PENDING", "ACCEPTED"), ("PENDING", "FAILED"), ("ACCEPTED", "PROCESSED"), ("ACCEPTED", "FAILED")}
    out = []
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        now = ""
        for _, at, wanted in group:
            out.append((key, at, wanted, now, (now, wanted) in legal))
            now = wanted if (now, wanted) in legal else now
    return sorted(out)


def test_transitions_of_a_table(spark):
    rows = events(1, 60)
    frame = spark.createDataFrame([*rows, (None, START, "PENDING"), ("x", None, "PENDING"), ("y", START, None)], "deliveryId string, at timestamp, status string")
    assert sorted(map(tuple, status.transitions(frame).collect())) == brute(rows)
    assert status.transitions(frame.limit(0)).count() == 0


def test_transitions_of_a_stream_out_of_order(spark, tmp_path):
    rows = events(2, 25)
    random.Random(3).shuffle(rows)  # they come in another order than they happened
    schema = "deliveryId string, at timestamp, status string"
    source, check, out = (f"file://{tmp_path}/{n}" for n in ("in", "check", "out"))
    last = [("end", START + dt.timedelta(days=n), "PENDING") for n in (30, 31)]
    for part in (rows[0::3], rows[1::3], rows[2::3], last[:1], last[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        status.transition_stream(stream, "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).where("deliveryId <> 'end'")
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert {r["accepted"] for r in got.select("accepted").distinct().collect()} == {True, False}


def test_seen_ids_read_their_buckets(spark, tmp_path):
    names = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(600)]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    seen = SeenIds(spark, f"file://{tmp_path}/seen", bucket_rows=20, additions=3)
    for batch in range(6):
        seen.add(frame(names[100 * batch : 100 * batch + 100]), batch)
    seen.add(frame(names[500:600]), 5)  # the batch again
    asked = frame([names[7], names[599], hashlib.sha256(b"new").hexdigest(), None])
    assert {r["id"] for r in seen.among(asked, 9).collect()} == {names[7], names[599]}
    assert {r["id"] for r in seen.among(asked, 5).collect()} == {names[7]}  # a batch is no repeat of itself
    assert seen.versions.manifest()["notes"]["depth"] == 2
    # a batch of one id reads one bucket, of bounded size
    one = seen.among(frame(names[:1]), 9)
    read = seen.versions.read("seen").where(F.col("bucket") == names[0][:2]).count()
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString() and read <= 20
