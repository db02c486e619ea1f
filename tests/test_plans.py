import subprocess

import pytest

from graphloam.operators import metrics, vectors, workspace
from graphloam.plans import copilot, ingest, pr_analysis
from graphloam.sources import tree

FILES = {"src/store.ts": "export function open(x) {\n  return x\n}\n", "src/app.ts": "import { open } from './store.ts'\nimport fs from 'fs'\nexport function main() {\n  open(1)\n}\n", "lib/util.py": "def helper():\n    return 1\n"}


def write(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def test_ingest_then_again(spark, tmp_path):
    root, embed = tmp_path / "repo", vectors.hashing_embedder(16)
    write(root, FILES)
    stages = []
    state, row = ingest.ingest(ingest.empty_state(spark), tree.scan_tree(spark, str(root), "r"), "r", embed, 16, lambda n, p: stages.append((n, p)))
    assert row["newFiles"] == 3 and row["chunkCount"] == 3 and row["errorMessage"] is None and [p for _, p in stages] == [15, 25, 60, 80]
    assert {(r["sourceId"], r["targetId"]) for r in state.edges.where("type = 'IMPORTS'").collect()} == {("r:src/app.ts", "r:src/store.ts"), ("r:src/app.ts", "external:fs")}

    answer = copilot.ask(state.nodes, state.edges, state.chunks, "how does store work?", "r", embed)
    assert answer["intent"] == "trace-flow" and any(x["file"] == "src/store.ts" for x in answer["references"]) and "src/store.ts" in answer["prompt"]
    pr = pr_analysis.analyse(state.nodes, state.edges, state.chunks, spark.createDataFrame([("src/store.ts", "modified")], "filename string, status string"), "r", embed)
    assert pr["changedFiles"] == ["src/store.ts"] and [n["nodeId"] for n in pr["impactedNodes"]] == ["r:src/app.ts"]

    write(root, {"src/app.ts": "export function main() {}\nexport function more() {}\n", "new.js": "function n() {}\n"})
    (root / "lib/util.py").unlink()
    state, row = ingest.ingest(state, tree.scan_tree(spark, str(root), "r"), "r", embed, 16)
    assert {k: row[f"{k}Files"] for k in ("new", "changed", "deleted", "unchanged")} == {"new": 1, "changed": 1, "deleted": 1, "unchanged": 1}
    files = {r["filePath"] for r in state.nodes.collect()}
    assert files == {"", "src/store.ts", "src/app.ts", "new.js"} and state.nodes.where("type = 'external_dependency'").count() == 0
    assert {r["filePath"] for r in state.chunks.collect()} == {"src/store.ts", "src/app.ts", "new.js"} and row["chunkCount"] == 4
    assert '"fileCount":3' in state.nodes.where("type = 'repository'").first()["metadataJson"]


def test_failed_embedding_keeps_the_chunks(spark, tmp_path):
    write(tmp_path / "repo", FILES)
    state, _ = ingest.ingest(ingest.empty_state(spark), tree.scan_tree(spark, str(tmp_path / "repo"), "r"), "r", vectors.hashing_embedder(8), 8)
    write(tmp_path / "repo", {"src/store.ts": "function other() {}\n"})
    after, row = ingest.ingest(state, tree.scan_tree(spark, str(tmp_path / "repo"), "r"), "r", lambda texts: [], 8)
    assert row["errorMessage"] and after.chunks.count() == state.chunks.count() == 3
    assert after.nodes.where("label = 'other'").count() == 1


def test_acquire(tmp_path):
    origin, target = tmp_path / "origin", str(tmp_path / "clone")
    write(origin, {"a.py": "x = 1\n"})
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", ".")
    run("commit", "-qm", "one")
    one = ingest.acquire(f"file://{origin}", target)
    assert one["defaultBranch"] == "main" and (tmp_path / "clone/a.py").exists()
    write(origin, {"b.py": "y = 2\n"})
    run("add", ".")
    run("commit", "-qm", "two")
    assert ingest.acquire(f"file://{origin}", target)["commitHash"] != one["commitHash"] and (tmp_path / "clone/b.py").exists()
    with pytest.raises(ingest.IngestionError):
        ingest.acquire(str(tmp_path / "nowhere"), str(tmp_path / "x"))


def test_workspace_and_metrics(spark):
    repos = spark.createDataFrame(
        [("r1", "READY", "GITHUB", "sec", "tok", None, None, None, 2, 5, None, "2024-01-02"), ("r2", "ERROR", "ZIP", None, None, None, None, "2024-01-03", 1, None, 3, "2024-01-01")],
        "id string, status string, sourceType string, webhookSecret string, githubToken string, lastWebhookAt string, lastWebhookStatus string, deletedAt string, fileCount int, nodeCount int, edgeCount int, createdAt string",
    )
    assert [r["id"] for r in workspace.live_repositories(repos).collect()] == ["r1"]
    view = workspace.public_view(repos)
    assert not set(workspace.SECRETS) & set(view.columns) and view.orderBy("id").first()["webhookConfigured"] and view.orderBy("id").first()["status"] == "ready"
    assert workspace.secrets(repos, "r1").first()["githubToken"] == "tok"
    stats = metrics.workspace_stats(workspace.public_view(repos)).first()
    assert tuple(stats) == (1, 2, 3, 5, 3)
    assert metrics.metric_row(None, 4) == {"changedFiles": 0, "newFiles": 4, "deletedFiles": 0, "unchangedFiles": 0}
    assert [r["id"] for r in metrics.latest(repos, "createdAt", "id", 1).collect()] == ["r1"]
    ws, user = workspace.seed(spark)
    assert ws.first()["id"] == user.first()["workspaceId"]
    assert workspace.by_key(repos, id="r2").first()["status"] == "ERROR"


def test_empty_prompt_sections(spark):
    nodes = spark.createDataFrame([], "id string, name string, type string, filePath string")
    chunks = spark.createDataFrame([], "id string, filePath string, startLine int, endLine int, name string, content string, similarity double")
    text = copilot.build_prompt("why?", nodes, chunks).first()["prompt"]
    assert "(no nodes)" in text and "(no excerpts)" in text and text.endswith("Question: why?")


def test_prompts_of_a_table_equal_those_of_lists(spark):
    cases = [
        (1, ["a", "b"], [("A", "class", None), ("B", "file", "b.ts")], [("C", "c.ts", "CALLS")], [("f", "x" * 3000), ("g", "y")]),
        (2, [], [], [], []),
    ]
    rows = spark.createDataFrame(cases, "k int, changed array<string>, direct array<struct<label:string,type:string,filePath:string>>, impacted array<struct<name:string,file:string,relationship:string>>, excerpts array<struct<filePath:string,content:string>>")
    got = {r["k"]: r["prompt"] for r in pr_analysis.prompts(rows).collect()}
    for k, changed, direct, impacted, excerpts in cases:
        dicts = [[dict(zip(names, x, strict=True)) for x in part] for names, part in ((("label", "type", "filePath"), direct), (("name", "file", "relationship"), impacted), (("filePath", "content"), excerpts))]
        assert got[k] == pr_analysis.prompt(changed, *dicts)
