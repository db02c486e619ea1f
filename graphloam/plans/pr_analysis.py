"""The impact of a pull request."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.operators import impact, vectors
from graphloam.plans.copilot import offline_llm
from graphloam.schemas import ANALYSES

# Fixed values.
CONTEXT_CHARS, SUMMARY_TOKENS = 2000, 400
TASK = "Describe what this change can affect, by file names, in a few sentences."


def prompt(changed: list[str], direct: list, impacted: list, excerpts: list) -> str:
    """F27."""
    code = "\n\n".join(f"{c['filePath']}\n{c['content']}" for c in excerpts)[:CONTEXT_CHARS]
    parts = [
        ("Changed files", "\n".join(changed)),
        ("Nodes in them", "\n".join(f"{n['label']} ({n['type']}), {n['filePath'] or 'unknown file'}" for n in direct)),
        ("Nodes that depend on them", "\n".join(f"{n['name']}, {n['file']}, by {n['relationship']}" for n in impacted)),
        ("Code", code),
    ]
    return TASK + "\n\n" + "\n\n".join(f"{title}:\n{body or '(none)'}" for title, body in parts)


def prompts(rows: DataFrame) -> DataFrame:
    """F27 for a table of analyses: rows with prompt, the same text as prompt(), from the columns changed (array of paths), direct
    (array of label, type, filePath), impacted (array of name, file, relationship) and excerpts (array of filePath, content)."""
    lines = lambda column, line, joiner="\n": F.array_join(F.transform(column, line), joiner)
    parts = [
        ("Changed files", F.array_join("changed", "\n")),
        ("Nodes in them", lines("direct", lambda n: F.concat(n["label"], F.lit(" ("), n["type"], F.lit("), "), F.when(n["filePath"] != "", n["filePath"]).otherwise("unknown file")))),
        ("Nodes that depend on them", lines("impacted", lambda n: F.concat(n["name"], F.lit(", "), n["file"], F.lit(", by "), n["relationship"]))),
        ("Code", F.substring(lines("excerpts", lambda c: F.concat(c["filePath"], F.lit("\n"), c["content"]), "\n\n"), 1, CONTEXT_CHARS)),
    ]
    body = [F.concat(F.lit(f"{title}:\n"), F.when(text != "", text).otherwise("(none)")) for title, text in parts]
    return rows.withColumn("prompt", F.concat_ws("\n\n", F.lit(TASK), *body))


def store_analysis(spark: SparkSession, path: str, url: str, result: dict, at: datetime) -> None:
    """Adds an analysis to the table of all; its id comes from URL and time."""
    key = hashlib.sha256(f"{url}|{at.isoformat()}".encode()).hexdigest()
    hit = [(r["nodeId"], r["file"], r["name"], r["hop"], r["relationship"]) for r in result["impactedNodes"]]
    refs = [(r["nodeId"], r["file"], r["name"]) for r in result["references"]]
    spark.createDataFrame([(key, result["repositoryId"], url, result["changedFiles"], hit, result["summary"], refs, result["durationMs"], at)], ANALYSES).write.mode("append").parquet(path)


def analyse(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, pr_files: DataFrame, repository: str | None, embed: Callable, llm: Callable[..., str] = offline_llm) -> dict:
    """What is stored of an analysis. The lists are bounded: a page of files, 50 impacted nodes, 10 chunks."""
    begun = time.perf_counter()
    found = impact.analyse(nodes, edges, pr_files, repository)
    question = found["query"].first()["text"]
    own = chunks if repository is None else chunks.where(F.col("repositoryId") == repository)
    near = vectors.refine(own, embed, question, found["ids"])
    changed = [r["path"] for r in found["changed"].orderBy("path").limit(impact.PR_FILES).collect()]
    hit, excerpts = found["impacted"].collect(), near.collect()
    direct = found["direct"].orderBy("id").limit(impact.MAX_IMPACTED).collect()
    return {
        "repositoryId": repository, "changedFiles": changed, "impactedNodes": [r.asDict() for r in hit], "summary": llm(prompt(changed, direct, hit, excerpts), max_tokens=SUMMARY_TOKENS),
        "references": [{"nodeId": c["nodeId"], "file": c["filePath"], "name": c["name"]} for c in excerpts[: impact.REFERENCES]], "durationMs": int((time.perf_counter() - begun) * 1000),
    }
