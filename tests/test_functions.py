import hashlib
import hmac

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloam.functions import crypto, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("Where is session storage handled?", "find-ownership"), ("who handles uploads?", "find-ownership"), ("Which service is responsible for mail?", "find-ownership"),
        ("How does caching work?", "trace-flow"), ("what happens when a job fails?", "trace-flow"), ("trace the upload", "trace-flow"), ("the login flow", "trace-flow"),
        ("Explain the build", "explain-arch"), ("an overview please", "explain-arch"), ("tell me something", "explain-arch"), (None, "explain-arch"),
        ("where are tokens made?", "locate-logic"), ("find all retries", "locate-logic"), ("locate the parser", "locate-logic"),
        ("what breaks if Cache changes?", "explain-deps"), ("what  depends on Cache?", "explain-deps"), ("what imports this?", "explain-deps"),
    ],
)
def test_intent(spark, question, expected):
    assert one(spark, text.intent(F.lit(question).cast("string"))) == expected


def test_keywords_keep_order_and_repeats(spark):
    assert one(spark, text.keywords(F.lit("Where is the Cache-Store, cache of a DB2 cache?"))) == ["cachestore", "cache", "db2", "cache"]
    assert one(spark, text.keywords(F.lit(""))) == []


@pytest.mark.parametrize(("path", "expected"), [("a/b.ts", "typescript"), ("a/b.TSX", "typescript"), ("x.cjs", "javascript"), ("x.py", "python"), ("X.java", "java"), ("README.md", None), (".py", None), ("dir.ts/file", None)])
def test_language(spark, path, expected):
    assert one(spark, text.language(F.lit(path))) == expected


@pytest.mark.parametrize(("base", "source", "expected"), [("src/a/b.ts", "./c", "src/a/c"), ("src/a/b.ts", "../c.js", "src/c.js"), ("b.ts", "./x/../y", "y"), ("b.ts", "../y", "../y"), ("a/b.ts", "/c//d", "a/c/d")])
def test_resolve_import(spark, base, source, expected):
    assert one(spark, text.resolve_import(F.lit(base), F.lit(source))) == expected


def test_lines(spark):
    src = "\n".join(f"line {i}" for i in range(1, 81))
    assert one(spark, text.line_slice(F.lit(src), F.lit(2), F.lit(3))) == "line 2\nline 3"
    assert one(spark, text.line_slice(F.lit(src), F.lit(90), F.lit(95))) == ""
    assert one(spark, text.file_preview(F.lit(src))).endswith("line 50")
    assert len(one(spark, text.file_preview(F.lit("x" * 5000)))) == 2000


def test_urls_and_labels(spark):
    assert one(spark, text.pr_parts(F.lit("https://github.com/o/r/pull/12"))).asDict() == {"owner": "o", "repo": "r", "number": 12}
    assert one(spark, text.pr_parts(F.lit("https://example.org/x"))) is None
    assert one(spark, text.repo_parts(F.lit("https://github.com/o/r.git"))).asDict() == {"owner": "o", "repo": "r"}
    assert [one(spark, text.duration_label(F.lit(x).cast("long"))) for x in (999, 1234, None)] == ["999ms", "1.2s", "—"]
    assert one(spark, text.tracked_ref(F.lit(None).cast("string"), F.lit("dev"))) == "refs/heads/dev"
    assert one(spark, text.ast_name(F.lit("/a\\b/c.ts"))) == "a-b-c.ts"
    assert one(spark, text.metadata_path(F.lit('{"path":"p"}'))) == "p"
    assert one(spark, text.metadata_path(F.lit("no json"))) == ""


def test_hints(spark):
    assert [h["framework"] for h in one(spark, text.framework_hints(F.lit("java"), F.lit("import org.springframework.x; @Service @RestController")))] == ["spring"] * 3
    assert one(spark, text.framework_hints(F.lit("python"), F.lit("import os"))) == []


@pytest.mark.parametrize("key", ["k", "s" * 64, "long" * 40])
def test_signature(spark, key):
    body = "päyload"
    good = "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()
    check = lambda s: one(spark, crypto.signature_ok(F.lit(key), F.lit(body).cast("binary"), F.lit(s).cast("string")))
    assert check(good)
    assert not any(check(s) for s in (good[:-1] + ("0" if good[-1] != "0" else "1"), good[7:], "", None, "sha1=" + good[7:]))


def test_encryption_round_trip(spark):
    key = "0f" * 32
    rows = spark.createDataFrame([("tökën", key), ("tökën", key), ("", key)], "t string, k string")
    out = rows.select("t", crypto.encrypt(F.col("t"), F.col("k")).alias("e"), "k").cache()
    back = out.select("t", "e", crypto.decrypt(F.col("e"), F.col("k")).alias("p")).collect()
    assert all(r["t"] == r["p"] and r["e"].startswith("v1:") for r in back)
    assert len({r["e"] for r in back}) == 3
    for bad in (crypto.encrypt(F.col("t"), F.lit("short")), crypto.decrypt(F.lit("v0:abc"), F.lit(key))):
        with pytest.raises(PySparkException):
            rows.select(bad).collect()


def test_authenticated_url(spark):
    assert one(spark, crypto.authenticated_url(F.lit("https://github.com/o/r"), F.lit("t/k"))) == "https://x-access-token:t%2Fk@github.com/o/r"
    assert one(spark, crypto.authenticated_url(F.lit("/local/dir"), F.lit("t"))) == "/local/dir"
