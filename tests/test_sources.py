import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from graphloam.operators.vectors import EmbeddingError, embed_batches
from graphloam.sources import pr_files, providers
from graphloam.sources.paged import PagedFiles


def test_pr_files(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/1.json").write_text(json.dumps([{"filename": "a.ts", "status": "modified", "extra": 1}, {"filename": "b.ts", "status": "removed"}]))
    (tmp_path / "pages/2.json").write_text(json.dumps([{"filename": "c.ts", "status": "added"}, {"filename": "d.ts", "status": "strange"}]))
    assert {(r["filename"], r["status"]) for r in pr_files.from_files_pages(spark, str(tmp_path / "pages")).collect()} == {("a.ts", "modified"), ("b.ts", "removed"), ("c.ts", "added")}
    (tmp_path / "cmp").mkdir()
    (tmp_path / "cmp/1.json").write_text(json.dumps({"files": [{"filename": "x.py", "status": "renamed"}]}))
    (tmp_path / "cmp/2.json").write_text(json.dumps({"status": "identical"}))
    (tmp_path / "cmp/3.json").write_text("no json")
    assert [r["filename"] for r in pr_files.from_comparisons(spark, str(tmp_path / "cmp")).collect()] == ["x.py"]


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status = 500 if body["model"] == "broken" else 200
        n = len(body.get("input", [])) - (body["model"] == "short")
        out = json.dumps({"embeddings": [[0.0, 1.0]] * n, "response": body.get("prompt", "")[::-1]}).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_http_models(url):
    assert embed_batches(providers.http_embedder(url, "m"), ["x"] * 25, 2) == [[0.0, 1.0]] * 25
    for model in ("short", "broken"):
        with pytest.raises(EmbeddingError):
            providers.http_embedder(url, model)(["a", "b"])
    with pytest.raises(EmbeddingError):
        providers.http_embedder("http://127.0.0.1:9/", "m", 2)(["a"])
    assert providers.http_llm(url, "m")("abc") == "cba"


def test_paged_source_plans_pages_and_resumes(spark, tmp_path):
    spark.dataSource.register(PagedFiles)
    write = lambda n, files: (tmp_path / f"page-{n}.json").write_text(json.dumps(files))
    file = lambda n: {"filename": f"f{n}", "status": "added", "more": 1}
    for n in range(1, 5):
        write(n, [file(10 * n), file(10 * n + 1)] if n % 2 else {"files": [file(10 * n)]})
    url = f"file://{tmp_path}/page-{{page}}.json"
    got = spark.read.format("paged_files").option("url", url).load()
    assert sorted(map(tuple, got.collect())) == [(1, "f10", "added"), (1, "f11", "added"), (2, "f20", "added"), (3, "f30", "added"), (3, "f31", "added"), (4, "f40", "added")]
    assert got.rdd.getNumPartitions() == 4
    assert spark.read.format("paged_files").option("url", url).option("from", 3).option("pages", 3).load().count() == 2
    assert spark.read.format("paged_files").option("url", url).option("from", 9).load().count() == 0

    def stream() -> list:
        query = spark.readStream.format("paged_files").option("url", url).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["page"] for r in spark.read.parquet(str(tmp_path / "out")).select("page").collect())

    assert stream() == [1, 1, 2, 3, 3, 4]
    write(5, [file(50)])
    write(6, {})
    assert stream() == [1, 1, 2, 3, 3, 4, 5]  # only what came after the offset
    with pytest.raises(Exception, match="no {page}"):
        spark.read.format("paged_files").option("url", "file:///x").load().collect()
