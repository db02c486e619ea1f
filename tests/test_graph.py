import random

from pyspark.sql import functions as F

from graphloam.operators import chunks, diff, extract, graph_build, graph_query, impact, layout, mutate, retrieval, vectors
from graphloam.schemas import EDGES, NODES, PARSED_FILE

LOC = {"filePath": "p", "startLine": 1, "endLine": 3}


def parsed(spark, *files):
    rows = []
    for f in files:
        base = {"id": f"r:{f['path']}", "repositoryId": "r", "contentHash": "h", "language": "typescript", "imports": [], "exports": [], "classes": [], "functions": [], "frameworkHints": [], "metadata": None, "error": None}
        rows.append(base | f)
    from pyspark.sql import types as T

    return spark.createDataFrame(rows, T._parse_datatype_string(PARSED_FILE))


def fn(name, start=1, end=3):
    return {"name": name, "params": [], "returnType": None, "isAsync": True, "isExported": True, "location": {"filePath": "p", "startLine": start, "endLine": end}}


def store_file():
    cls = {"name": "Store", "extends": None, "implements": ["IStore"], "methods": [fn("open")], "isAbstract": False, "location": LOC}
    return {"path": "src/store.service.ts", "imports": [{"source": "@nestjs/common", "specifiers": ["Injectable"], "isDefault": False}, {"source": "./user", "specifiers": ["User"], "isDefault": False}], "classes": [cls], "functions": [fn("hash")], "frameworkHints": [{"framework": "nestjs", "hint": "x"}]}


def test_build_graph(spark):
    nodes, edges, gone = graph_build.build_graph(parsed(spark, store_file()), "r")
    types = {r["label"]: r["type"] for r in nodes.collect()}
    assert types == {"r": "repository", "store.service.ts": "service", "Store": "class", "open": "function", "hash": "function", "@nestjs/common": "external_dependency"}
    kinds = sorted(r["type"] for r in edges.collect())
    assert kinds == ["CONTAINS"] * 4 + ["IMPORTS"]
    assert sorted(r["type"] for r in gone.collect()) == ["IMPLEMENTS", "IMPORTS"]
    ids = {r["id"] for r in nodes.collect()}
    assert "r:src/store.service.ts#Store#open" in ids and "external:@nestjs/common" in ids
    again = graph_build.build_graph(parsed(spark, store_file()), "r")[1]
    assert {r["id"] for r in again.collect()} == {r["id"] for r in edges.collect()}


def test_resolution_extensions(spark):
    iface = {"path": "src/istore.ts", "classes": [{"name": "IStore", "extends": None, "implements": [], "methods": [], "isAbstract": True, "location": LOC}]}
    _, edges, gone = graph_build.build_graph(parsed(spark, store_file(), iface, {"path": "src/user.ts"}), "r", resolve=True)
    targets = {(r["type"], r["targetId"]) for r in edges.collect()}
    assert ("IMPLEMENTS", "r:src/istore.ts#IStore") in targets and ("IMPORTS", "r:src/user.ts") in targets and gone.count() == 0


def test_same_name_twice_last_wins(spark):
    f = {"path": "a.ts", "functions": [fn("f", 1, 2), fn("f", 5, 6)]}
    nodes, edges, _ = graph_build.build_graph(parsed(spark, f), "r")
    row = nodes.where("label = 'f'").collect()
    assert len(row) == 1 and '"startLine":5' in row[0]["metadataJson"]
    assert edges.where("targetId = 'r:a.ts#f'").count() == 2


def graph(spark, pairs, types=None):
    names = sorted({x for a, b, *_ in pairs for x in (a, b)})
    nodes = spark.createDataFrame([(n, (types or {}).get(n, "file"), n.upper(), "r", f"p/{n}", '{"path":"p/%s"}' % n) for n in names], NODES)
    edges = spark.createDataFrame([(f"{a}{b}", a, b, k[0] if k else "CALLS", None) for a, b, *k in pairs], EDGES)
    return nodes, edges


def test_shortest_paths_against_a_plain_search(spark):
    """Length and, of equal ones, the path whose predecessors are smallest; from both ends, in half the levels."""
    rng = random.Random(6)
    names = [f"n{i:02}" for i in range(40)]
    links = sorted({(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(75))} | {(names[i], names[i + 1]) for i in range(8)})
    edges = spark.createDataFrame([(f"e:{a}:{b}", a, b, "X") for a, b in links], "id string, sourceId string, targetId string, type string")
    nodes = spark.createDataFrame([(n, "file", n, "r", "", "{}") for n in names], "id string, type string, label string, repositoryId string, filePath string, metadataJson string")

    def plain(source: str, target: str, most: int) -> list[str]:
        before, layer, steps = {source: None}, [source], 0
        while layer and target not in before and steps < most:
            found: dict[str, str] = {}
            for a, b in links:
                if a in layer and b not in before:
                    found[b] = min(a, found.get(b, a))
            before |= found
            layer, steps = list(found), steps + 1
        path = [target]
        while target in before and path[-1] != source:
            path.append(before[path[-1]])
        return path[::-1] if target in before and source != target else []

    for source, target, most in [(names[0], names[8], 10), (names[0], names[8], 2), *((rng.choice(names), rng.choice(names), 10) for _ in range(4))]:
        got = graph_query.shortest_path(nodes, edges, source, target, most).orderBy("position").collect()
        assert [r["nodeId"] for r in got] == plain(source, target, most)
        assert [r["edgeId"] for r in got[1:]] == [f"e:{a['nodeId']}:{b['nodeId']}" for a, b in zip(got, got[1:], strict=False)]


def test_shortest_path_in_a_cycle(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "c"), ("d", "d")])
    assert [r["nodeId"] for r in graph_query.shortest_path(nodes, edges, "a", "d").orderBy("position").collect()] == ["a", "c", "d"]
    assert graph_query.shortest_path(nodes, edges, "d", "a").count() == 0
    assert graph_query.shortest_path(nodes, edges, "a", "a").count() == 0
    assert graph_query.shortest_path(nodes, edges, "a", "d", max_hops=1).count() == 0


def test_neighbourhood_and_panel(spark):
    nodes, edges = graph(spark, [("a", "b", "CONTAINS"), ("c", "a"), ("a", "a", "USES"), ("a", "b", "CALLS")])
    rows = {(r["direction"], r["edgeType"], r["id"]) for r in graph_query.neighbourhood(nodes, edges, "a").collect()}
    assert rows == {("self", "", "a"), ("out", "CONTAINS", "b"), ("out", "CALLS", "b"), ("out", "USES", "a"), ("in", "USES", "a"), ("in", "CALLS", "c")}
    assert graph_query.neighbourhood(nodes, edges, "zz").count() == 0
    nested = graph_query.neighbourhood_nested(nodes, edges, "a").first()
    assert nested["node"]["id"] == "a" and len(nested["outgoing"]) == 3 and len(nested["incoming"]) == 2
    panel = {(r["bucket"], r["id"]) for r in graph_query.side_panel(nodes, edges, "a").collect()}
    assert panel == {("contains", "b"), ("imports", "b"), ("imports", "a"), ("usedBy", "c")}


def test_smart_load(spark):
    nodes, _ = graph(spark, [("a", "b"), ("c", "d")], {"a": "class"})
    assert graph_query.graph_nodes(nodes, "r", threshold=5).count() == 4
    assert [r["id"] for r in graph_query.graph_nodes(nodes, "r", threshold=4).collect()] == ["b", "c", "d"]
    assert graph_query.graph_nodes(nodes, "r", threshold=4, inclusive=False).count() == 4
    assert [r["id"] for r in graph_query.graph_nodes(nodes, "r", ["file"], limit=1, offset=1).collect()] == ["c"]


def test_impact_and_gate(spark):
    nodes, edges = graph(spark, [("b", "a"), ("c", "b", "IMPORTS"), ("d", "c"), ("b", "a", "IMPORTS"), ("e", "a", "CONTAINS")])
    paths = spark.createDataFrame([("p/a",)], "path string")
    rows = [(r["hop"], r["nodeId"], r["relationship"]) for r in impact.impacted_nodes(nodes, edges, paths, "r").collect()]
    assert rows == [(1, "b", "CALLS"), (2, "c", "IMPORTS")]
    assert impact.impacted_nodes(nodes, edges, paths, "r", below=2).count() == 1
    found = impact.analyse(nodes, edges, spark.createDataFrame([("p/a", "modified"), ("p/x", "removed")], "filename string, status string"), "r")
    assert found["query"].first()["text"] == "p/a A" and [r["id"] for r in found["ids"].collect()] == ["a", "b", "c"]


def test_retrieval_routes(spark):
    nodes, edges = graph(spark, [("a", "b"), ("c", "b"), ("c", "d")], {"a": "class", "b": "function", "c": "function", "d": "function"})
    ids = lambda q: {r["id"] for r in retrieval.retrieve(nodes, edges, q, "r").collect()}
    assert ids("explain everything") == {"a"} and ids("how does path work?") >= {"a", "b", "c", "d"}
    nodes = nodes.withColumn("label", F.when(F.col("id") == "b", "cache").otherwise(F.col("label"))).withColumn("metadataJson", F.lit("{}"))
    assert {r["id"] for r in retrieval.retrieve(nodes, edges, "what breaks cache", "r").collect()} == {"a", "b", "c"}
    assert {r["id"] for r in retrieval.retrieve(nodes, edges, "how does cache go", "r").collect()} == {"a", "b", "c", "d"}


def test_diff_buckets(spark):
    disk = spark.createDataFrame([("same", "1"), ("new", "2"), ("changed", "3")], "path string, contentHash string")
    registry = spark.createDataFrame([("same", "1"), ("changed", "0"), ("gone", "4")], "path string, contentHash string")
    d = diff.snapshot_diff(disk, registry)
    assert {r["path"]: r["bucket"] for r in d.collect()} == {"same": "unchanged", "new": "new", "changed": "changed", "gone": "deleted"}
    assert diff.bucket_counts(d).first().asDict() == dict.fromkeys(diff.BUCKETS, 1)
    assert {r["path"] for r in diff.stale_paths(d).collect()} == {"changed", "gone"} and {r["path"] for r in diff.parse_paths(d).collect()} == {"changed", "new"}
    assert diff.bucket_counts(diff.snapshot_diff(disk.limit(0), registry.limit(0))).first()["new"] == 0


def test_chunks(spark):
    src = {"a.ts": "function f() {\n}\nfunction g() {\n}", "b.ts": "const x = 1\n" * 300, "c.ts": "class C {\n m() {\n }\n n() {\n }\n}"}
    files = spark.createDataFrame([("r", p, c, "h") for p, c in src.items()] + [("r", "d.ts", None, "h")], "repositoryId string, path string, content string, contentHash string")
    rows = chunks.chunk(extract.parse(files), files).collect()
    by = {}
    for r in rows:
        by.setdefault(r["filePath"], []).append((r["nodeType"], r["name"], r["startLine"], r["endLine"]))
    assert sorted(by["a.ts"]) == [("function", "f", 1, 2), ("function", "g", 3, 4)]
    assert by["b.ts"] == [("file", "b.ts", 1, 50)] and sorted(by["c.ts"]) == [("class", "C", 1, 6), ("method", "C.m", 2, 3), ("method", "C.n", 4, 5)]
    assert "d.ts" not in by and len({r["id"] for r in rows}) == len(rows)
    assert next(r for r in rows if r["name"] == "C.m")["nodeId"] == "r:c.ts#C#m"


def test_vectors(spark):
    chunk_rows = spark.createDataFrame([("1", "n1", "x", "alpha beta"), ("2", "n2", "y", "gamma"), ("3", "n3", "z", "alpha")], "id string, nodeId string, name string, content string")
    embed = vectors.hashing_embedder(32)
    out = vectors.embed_chunks(chunk_rows, embed, 32).cache()
    near = vectors.cosine_topk(out, embed(["x\nalpha beta"])[0], k=2).collect()
    assert near[0]["id"] == "1" and abs(near[0]["similarity"] - 1) < 1e-6 and len(near) == 2
    only = vectors.refine(out, embed, "alpha", spark.createDataFrame([("n2",)], "id string"))
    assert [r["id"] for r in only.collect()] == ["2"]
    assert vectors.refine(out, lambda t: 1 / 0, "alpha", spark.createDataFrame([], "id string")).count() == 0
    odd = spark.createDataFrame([("1", None), ("2", [0.0, 0.0]), ("3", [1.0]), ("4", [0.0, 2.0])], "id string, embedding array<float>")
    assert [(r["id"], r["similarity"]) for r in vectors.cosine_topk(odd, [0.0, 1.0]).collect()] == [("4", 1.0)]
    for bad in (lambda t: [], lambda t: [[1.0]] * len(t)):
        try:
            vectors.embed_batches(bad, ["a"], 2)
            raise AssertionError
        except vectors.EmbeddingError:
            pass


def test_mutations(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(mutate.upsert(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(mutate.insert_absent(old, new, ["k"], [F.desc("v")])) == [(1, "a"), (2, "b"), (3, "e")]
    left, n = mutate.delete_by_keys(old, new.select("k"))
    assert rows(left) == [(1, "a")] and n.first()["deleted"] == 1
    assert rows(mutate.update_by_key(old, "k", 1, v="z")) == [(1, "z"), (2, "b")]
    assert rows(mutate.partial_update(old, spark.createDataFrame([(1, None), (2, "y")], "k int, v string"), "k")) == [(1, "a"), (2, "y")]
    assert rows(mutate.latest_by_key(new.withColumn("at", F.col("v")), "k", "at").select("k", "v")) == [(2, "c"), (3, "e")]
    path = str(tmp_path / "t")
    mutate.swap_in(spark, old, path)
    mutate.swap_in(spark, spark.read.parquet(path).where("k = 1"), path)
    assert rows(spark.read.parquet(path)) == [(1, "a")] and len(list(tmp_path.iterdir())) == 1


def test_delete_for_files_prunes_externals(spark):
    nodes, edges, _ = graph_build.build_graph(parsed(spark, store_file(), {"path": "b.ts"}), "r")
    left, links = mutate.delete_for_files(nodes, edges, spark.createDataFrame([("src/store.service.ts",)], "path string"), "r")
    assert {r["id"] for r in left.collect()} == {"r", "r:b.ts"} and links.count() == 1
    assert mutate.delete_for_files(nodes, edges, spark.createDataFrame([("src/store.service.ts",)], "path string"), "r", prune_externals=False)[0].count() == 3


def test_layout(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "c"), ("c", "zz")])
    nodes = nodes.where("id <> 'zz'")
    one, two = (layout.force_layout(nodes, edges, 60).orderBy("id").collect() for _ in range(2))
    assert one == two and len(one) == 3
    xs, ys = [r["x"] for r in one], [r["y"] for r in one]
    assert all(abs(v) < 1e4 for v in xs + ys) and max(xs) - min(xs) > 1 and max(ys) - min(ys) > 1
    assert layout.force_layout(nodes.limit(0), edges, 5).count() == 0


def test_stored_rows_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a", None), ("r", "b", "own"), ("q", "a", None)], "repositoryId string, name string, id string")
    mutate.insert(rows, str(tmp_path / "t"), ["repositoryId", "name"], ["repositoryId"])
    back = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len({r["id"] for r in back}) == 3 and "own" in {r["id"] for r in back}
    chunks.store_chunks(rows, str(tmp_path / "c"))
    assert {r["repositoryId"]: r["n"] for r in chunks.chunk_counts(spark.read.parquet(str(tmp_path / "c"))).collect()} == {"r": 2, "q": 1}
