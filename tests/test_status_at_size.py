"""The status machine costs no call and no entry of the state for each delivery."""

from test_status_and_seen import brute, events

from graphloam.streaming import status

SCHEMA = "deliveryId string, at timestamp, status string"


def test_transitions_call_no_python(spark):
    rows = events(7, 80)
    out = status.transitions(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert "Pandas" not in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_a_stream_keeps_an_entry_for_a_bucket(spark, tmp_path):
    source, check, out = (f"file://{tmp_path}/{n}" for n in ("in", "check", "out"))
    spark.createDataFrame(events(8, 90), SCHEMA).write.parquet(source)
    stream = status.transition_stream(spark.readStream.schema(SCHEMA).parquet(source), "1 day", **({"buckets": 4} if hasattr(status, "BUCKETS") else {}))
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
