"""HMAC from built-in functions: every byte of a key, every length around a block, and no Python-like loop over the key's bytes."""

import hashlib
import hmac

from pyspark.sql import functions as F

from graphloam.functions import crypto


def test_hmac_of_all_bytes_and_lengths(spark):
    keys = [b"", b"\0", b"6", b"\\", b"\\6\\6", bytes(range(64)), bytes(range(64, 128)), bytes(range(128, 192)), bytes(range(192, 256)), bytes(range(65)), bytes(range(256)), b"k" * 63, b"\xff" * 64, None]
    rows = spark.createDataFrame([(i, None if k is None else bytearray(k), bytearray(b"body %d" % i)) for i, k in enumerate(keys)], "i int, key binary, body binary").repartition(2)
    got = {r["i"]: r["h"] for r in rows.select("i", crypto.hmac_sha256(F.col("key"), F.col("body")).alias("h")).collect()}
    assert got == {i: None if k is None else hmac.new(k, b"body %d" % i, hashlib.sha256).hexdigest() for i, k in enumerate(keys)}


def test_a_key_is_not_taken_byte_by_byte(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("k"))
    plan = rows.select(crypto.signature_ok(F.col("k"), F.col("k").cast("binary"), F.col("k")).alias("ok"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_extract") == 1
