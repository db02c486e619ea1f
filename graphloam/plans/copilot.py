"""Questions about a repository: retrieval, prompt, answer."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloam.operators import retrieval, vectors
from graphloam.operators.mutate import update_by_key
from graphloam.schemas import MESSAGES

# Fixed values.
PROMPT_NODES, PROMPT_CHUNKS, MAX_TOKENS, REFERENCES = 30, 8, 600, 5

INSTRUCTION = "Answer the question about this code base from the nodes and excerpts below, and from nothing else. Name files and functions. Keep it short."


def _section(rows: DataFrame, line, order: list, limit: int, joiner: str, placeholder: str, name: str) -> DataFrame:  # noqa: ANN001
    """One row: the lines of the first rows in order, joined; a placeholder if there are none."""
    place = F.row_number().over(Window.orderBy(*order))  # of at most `limit` rows
    first = rows.orderBy(*order).limit(limit).select(F.struct(place.alias("at"), line.alias("line")).alias("x"))
    return first.agg(F.coalesce(F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda s: s["line"]), joiner), F.lit("")), F.lit(placeholder)).alias(name))


def build_prompt(question: str, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (prompt). nodes: (id, name, type, filePath); chunks with similarity."""
    node_line = F.format_string("[%s] %s → %s", F.upper("type"), F.col("name"), F.col("filePath"))
    chunk_line = F.concat(F.format_string("%s:%d-%d (%s)\n", F.col("filePath"), F.col("startLine"), F.col("endLine"), F.col("name")), F.col("content"))
    n = _section(nodes, node_line, ["id"], PROMPT_NODES, "\n", "(no nodes)", "n")
    c = _section(chunks, chunk_line, [F.desc("similarity"), "id"], PROMPT_CHUNKS, "\n\n", "(no excerpts)", "c")
    both = n.crossJoin(c)  # one row each
    return both.select(F.concat_ws("\n\n", F.lit(INSTRUCTION), F.concat(F.lit("Nodes:\n"), "n"), F.concat(F.lit("Excerpts:\n"), "c"), F.lit(f"Question: {question}")).alias("prompt"))


def offline_llm(prompt: str, max_tokens: int = MAX_TOKENS, temperature: float = 0.0) -> str:
    """Stands in for a model: says how much it was given."""
    return f"({len(prompt)} characters of context, at most {max_tokens} tokens)"


def store_answer(spark: SparkSession, path: str, session: str, question: str, result: dict, at: datetime) -> None:
    """Adds a question and its answer to the messages of a session, with intent, references and duration. The ids come
    from session and time, so that storing again gives the same rows."""
    one = lambda role: hashlib.sha256(f"{session}|{at.isoformat()}|{role}".encode()).hexdigest()
    rows = [
        (one("user"), session, "user", question, None, [], None, None, at),
        (one("assistant"), session, "assistant", result["answer"], result["intent"], [tuple(r[k] for k in ("nodeId", "file", "name")) for r in result["references"]], result["durationMs"], None, at + timedelta(milliseconds=1)),
    ]
    spark.createDataFrame(rows, MESSAGES).write.mode("append").parquet(path)


def rate(messages: DataFrame, message: str, rating: int) -> DataFrame:
    """M4: the messages with a rating (1 or -1) of one of them."""
    if rating not in (1, -1):
        raise ValueError("a rating is 1 or -1")
    return update_by_key(messages, "id", message, rating=rating)


def ask(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, question: str, repository: str, embed: Callable, llm: Callable[..., str] = offline_llm) -> dict:
    """Intent, answer and references. Up to the prompt it is one plan of DataFrames; the model is a callable."""
    begun = time.perf_counter()
    intent, _ = retrieval.question_facts(nodes.sparkSession, question)
    found = retrieval.retrieve(nodes, edges, question, repository, intent)
    near = vectors.refine(chunks.where(F.col("repositoryId") == repository), embed, question, found.select("id"))
    prompt = build_prompt(question, found, near).first()["prompt"]
    refs = [{"nodeId": r["nodeId"], "file": r["filePath"], "name": r["name"]} for r in near.orderBy(F.desc("similarity"), "id").limit(REFERENCES).collect()]
    return {"intent": intent, "answer": llm(prompt, max_tokens=MAX_TOKENS), "references": refs, "prompt": prompt, "durationMs": int((time.perf_counter() - begun) * 1000)}
