"""Telemetry: one row for each ingestion, and what the dashboards read."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloam.functions import text

LATEST_METRICS, LATEST_ANSWERS, LATEST_ANALYSES = 20, 100, 20


class Stopwatch:
    """Milliseconds of named stages."""

    def __init__(self) -> None:
        self.ms: dict[str, int] = {}
        self._begun = time.perf_counter()

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        begun = time.perf_counter()
        try:
            yield
        finally:
            self.ms[name] = int((time.perf_counter() - begun) * 1000)

    @property
    def total(self) -> int:
        return int((time.perf_counter() - self._begun) * 1000)


def metric_row(diff_counts: DataFrame | None, parsed_count: int) -> dict[str, int]:
    """Without a diff (the first ingestion) all parsed files are new."""
    if diff_counts is None:
        return {"changedFiles": 0, "newFiles": parsed_count, "deletedFiles": 0, "unchangedFiles": 0}
    r = diff_counts.first()
    return {f"{b}Files": r[b] for b in ("changed", "new", "deleted", "unchanged")}


def latest(rows: DataFrame, time_column: str, key: str, n: int) -> DataFrame:
    """The n latest rows; ties by key."""
    return rows.orderBy(F.desc(time_column), key).limit(n)


def latest_answers(messages: DataFrame, sessions: DataFrame, repository: str | None = None, n: int = LATEST_ANSWERS) -> DataFrame:
    """The latest assistant messages of a repository's sessions."""
    own = sessions if repository is None else sessions.where(F.col("repositoryId") == repository)
    rows = messages.where(F.col("role") == "assistant").join(own.select(F.col("id").alias("sessionId")), "sessionId", "left_semi")
    return latest(rows, "createdAt", "id", n)


def answer_rows(answers: DataFrame) -> DataFrame:
    """What the dashboard shows of answers."""
    return answers.select("id", text.preview(F.col("content")).alias("preview"), text.duration_label(F.col("durationMs")).alias("latency"), "rating", "intent")


def history(messages: DataFrame, session: str) -> DataFrame:
    """A session's messages, oldest first."""
    return messages.where(F.col("sessionId") == session).orderBy("createdAt", "id")


def workspace_stats(repositories: DataFrame) -> DataFrame:
    """One row: ready and all repositories, and the sums of files, nodes and edges, nulls as 0."""
    return repositories.agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count(F.lit(1)).alias("total"), *(F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")), F.lit(0)).alias(c) for c in ("fileCount", "nodeCount", "edgeCount")))


def parsed_summary(parsed: DataFrame) -> DataFrame:
    """The registry's row of each parsed file."""
    return parsed.select("id", "repositoryId", "path", "language", "contentHash", *(F.size(a).alias(n) for a, n in (("imports", "importCount"), ("exports", "exportCount"), ("classes", "classCount"), ("functions", "functionCount"))), F.col("metadata.parserVersion").alias("parserVersion"), F.col("metadata.parsedAt").alias("parsedAt"), F.col("metadata.parseDurationMs").alias("parseDurationMs"))
