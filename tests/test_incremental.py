"""Graphs kept by deltas against graphs built at once; tables that change together."""

import random

import pytest
from pyspark.sql import functions as F

from graphloam.functions import text
from graphloam.operators import chunks, extract, graph_build, vectors
from graphloam.plans import ingest
from graphloam.plans.incremental import GraphStore
from graphloam.plans.versions import Conflict, Versions

FILES = "repositoryId string, path string, content string"


def body(rng: random.Random, n: int) -> str:
    lines = [f"import {{ x }} from './f{rng.randrange(n)}.ts'" for _ in range(rng.randrange(4))] + [f"import {p} from '{p}'" for p in rng.sample(["react", "express", "rxjs", "lodash"], rng.randrange(3))]
    lines += [f"export class C{rng.randrange(3)} extends Base {{ m() {{}} }}" for _ in range(rng.randrange(3))] + [f"function g{rng.randrange(3)}() {{}}" for _ in range(rng.randrange(3))]
    return "\n".join(lines) + "\n"


def frame(spark, files: dict[str, str]):
    return spark.createDataFrame([("r", p, c) for p, c in files.items()], FILES).withColumn("contentHash", text.content_hash(F.col("content")))


def rows(df) -> list:
    return sorted(repr(sorted(r.asDict(True).items())) for r in df.collect())


def full(spark, files: dict[str, str]) -> tuple[list, list, list]:
    parsed = extract.parse(frame(spark, files))
    nodes, edges, _ = graph_build.build_graph(parsed, "r")
    return rows(nodes), rows(edges), rows(chunks.chunk(parsed.where(extract.has_facts()), frame(spark, files)).drop("embedding"))


def test_deltas_equal_a_full_build(spark, tmp_path):
    rng = random.Random(5)
    store, n = GraphStore(spark, f"file://{tmp_path}/g", "r"), 9
    files = {f"src/f{i}.ts": body(rng, n) for i in range(5)} | {"src/p.py": "import os\n", "README.md": "no source"}
    for step in range(4):
        if step == 1:
            files["src/f2.ts"] = body(rng, n)
        elif step > 1:
            for i in rng.sample(range(n), 3):
                path = f"src/f{i}.ts"
                if path in files and rng.random() < 0.5:
                    del files[path]
                else:
                    files[path] = body(rng, n)
            files["src/p.py"] = ["import os\n", "def (\n", "import sys\nclass A: pass\n"][step % 3]
        row = store.ingest(frame(spark, files))
        assert (rows(store.nodes()), rows(store.edges()), rows(store.chunks().drop("embedding"))) == full(spark, files), step
        assert row["errorMessage"] is None and row["newFiles"] + row["changedFiles"] + row["unchangedFiles"] == sum(p.endswith((".ts", ".py")) for p in files)
        if step == 2:
            store.compact()
            assert (rows(store.nodes()), rows(store.edges()), rows(store.chunks().drop("embedding"))) == full(spark, files)


def test_a_delta_writes_the_changed_file_and_its_importers_only(spark, tmp_path):
    files = {f"src/f{i}.ts": f"import a from './f{i + 1}.ts'\nimport r from 'react'\nexport function g{i}() {{}}\n" for i in range(12)}
    store = GraphStore(spark, f"file://{tmp_path}/g", "r")
    assert store.ingest(frame(spark, files))["written"]["edges"] == 48
    # changed: nobody else is touched
    files["src/f7.ts"] = "export function other() {}\n"
    row = store.ingest(frame(spark, files))
    assert row["written"] == {"parsed": 1, "nodes": 2, "edges": 2, "imports": 0, "externals": 1, "changes": 2, "chunks": 1}
    # new: it and its one importer
    files["src/f12.ts"] = "export const x = 1\n"
    row = store.ingest(frame(spark, files))
    assert row["written"] == {"parsed": 1, "nodes": 1, "edges": 1 + 4, "imports": 0, "externals": 0, "changes": 3, "chunks": 1}
    # gone: no rows but those of its importer
    del files["src/f9.ts"]
    row = store.ingest(frame(spark, files))
    assert row["written"] == {"parsed": 0, "nodes": 0, "edges": 4, "imports": 0, "externals": 1, "changes": 3, "chunks": 0}
    assert (rows(store.nodes()), rows(store.edges()), rows(store.chunks().drop("embedding"))) == full(spark, files)
    # nothing
    assert sum(store.ingest(frame(spark, files))["written"].values()) == 0
    # versions of the past are read whole
    assert store.nodes(2).where("id = 'r:src/f9.ts'").count() == 1 and store.edges(2).where("targetId = 'r:src/f12.ts'").count() == 0


def test_a_failed_embedding_keeps_chunks(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g", "r")
    store.ingest(frame(spark, {"a.ts": "function f() {}\n"}), vectors.hashing_embedder(8), 8)
    before = rows(store.chunks())
    row = store.ingest(frame(spark, {"a.ts": "function g() {}\n"}), lambda texts: [], 8)
    assert row["errorMessage"] and rows(store.chunks()) == before and store.nodes().where("label = 'g'").count() == 1


def test_tables_change_together(spark, tmp_path, monkeypatch):
    place = ingest.Workspace(spark, f"file://{tmp_path}/w")
    place.ingest(frame(spark, {"a.ts": "function f() {}\n"}), "r")
    one = place.state("r")
    before = {t: rows(getattr(one, t)) for t in ingest.TABLES}
    write = ingest.Versions.begin

    def failing(self):
        change = write(self)
        replace, done = change.replace, []

        def second_fails(table, df, by=None):
            if done:
                raise RuntimeError("lost between two tables")
            done.append(replace(table, df, by))

        change.replace = second_fails
        return change

    monkeypatch.setattr(ingest.Versions, "begin", failing)
    with pytest.raises(RuntimeError, match="lost"):
        place.ingest(frame(spark, {"b.ts": "class B {}\n"}), "r")
    monkeypatch.undo()
    assert {t: rows(getattr(place.state("r"), t)) for t in ingest.TABLES} == before
    place.ingest(frame(spark, {"b.ts": "class B {}\n"}), "r")
    assert sorted(r["id"] for r in place.whole("nodes").collect()) == ["r", "r:b.ts", "r:b.ts#B"]
    assert rows(one.nodes) == before["nodes"]  # a reader that began before still reads its version


def test_versions(spark, tmp_path):
    at = Versions(spark, f"file://{tmp_path}/v", {"t": "a int, b int", "u": "a int"})
    assert at.read("t").count() == 0 and at.latest() == 0
    one, late = at.begin(), at.begin()
    one.add("t", spark.createDataFrame([(1, 1), (2, 2)], "a int, b int"), by="b")
    one.commit()
    late.add("u", spark.createDataFrame([(9,)], "a int"))
    with pytest.raises(Conflict):
        late.commit()
    two = at.begin()
    two.add("t", spark.createDataFrame([(3, 1)], "a int, b int"), by="b")
    two.notes["x"] = 1
    assert two.commit() == 2 and at.manifest()["notes"] == {"x": 1}
    assert sorted(map(tuple, at.read("t").collect())) == [(1, 1), (2, 2), (3, 1)] and at.read("t", 1).count() == 2 and at.read("u").count() == 0
    assert "PartitionFilters: [isnotnull(b" in at.read("t").where("b = 2")._jdf.queryExecution().toString()
    three = at.begin()
    three.replace("t", spark.createDataFrame([(7, 7)], "a int, b int"))
    three.commit()
    at.vacuum(1)
    assert at.numbers() == [3] and list(map(tuple, at.read("t").collect())) == [(7, 7)] and not (tmp_path / "v/u").exists() or not list((tmp_path / "v/u").iterdir())


def test_many_deltas_are_put_together(spark, tmp_path, monkeypatch):
    from graphloam.plans import incremental

    monkeypatch.setattr(incremental, "DELTAS", 1)
    store, files = GraphStore(spark, f"file://{tmp_path}/g", "r"), {}
    for n in range(3):
        files[f"src/f{n}.ts"] = f"import a from './f{n + 1}.ts'\nimport r from 'react'\nexport function g{n}() {{}}\n"
        store.ingest(frame(spark, files))
    manifest = store.versions.manifest()
    assert len(manifest["tables"]["nodes"]) == 1 and store.versions.latest() > 3
    assert (rows(store.nodes()), rows(store.edges()), rows(store.chunks().drop("embedding"))) == full(spark, files)
