"""Job queue: retries and a worker over the jobs table."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.schemas import JOBS

# Attempts and the first pause, doubled each time.
ATTEMPTS, PAUSE_MS = 3, 5000
#: Files of the jobs table that a batch takes.
FILES_A_BATCH = 16
DONE = "jobId string, status string"
#: Tasks of a pool; what it tells of a job.
POOL = 8
RESULT = "jobId string, status string, attempts int, result string, error string"


class Unrecoverable(RuntimeError):
    """Trying again would not help."""


def with_retries(work: Callable[[], None], attempts: int = ATTEMPTS, pause_ms: int = PAUSE_MS, sleep: Callable[[float], None] = time.sleep) -> int:
    """The number of the attempt that succeeded; the last error is raised, an unrecoverable one at once."""
    for attempt in range(1, attempts + 1):
        try:
            work()
            return attempt
        except Unrecoverable:
            raise
        except Exception:
            if attempt == attempts:
                raise
            sleep(pause_ms * 2 ** (attempt - 1) / 1000)
    raise AssertionError


def job_stream(spark: SparkSession, path: str, files: int = FILES_A_BATCH) -> DataFrame:
    """The jobs table as a stream, `files` files a batch at most."""
    return spark.readStream.schema(JOBS).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)


def start_worker(jobs: DataFrame, work: Callable[[dict], None], checkpoint: str, failed: Callable[[dict, Exception], None] = lambda *_: None, once: bool = True, done: str | None = None, pause_ms: int = PAUSE_MS):  # noqa: ANN201
    """Runs the jobs of a stream one after the other; a failure is told to `failed` after the last attempt. The source
    bounds a batch (see job_stream()); its jobs are fetched row by row. done: a folder that takes a row for each finished job,
    so that a batch that runs again after a failure leaves out what was finished."""
    from graphloam.operators.mutate import delete_by_keys

    def finished() -> DataFrame:
        spark = jobs.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(done)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(DONE).parquet(done) if there else spark.createDataFrame([], DONE)

    def batch(rows: DataFrame, _: int) -> None:
        if done:
            rows = delete_by_keys(rows, finished().select("jobId"))[0]
        for row in rows.orderBy("jobId").toLocalIterator():
            job, status = row.asDict(), "DONE"
            try:
                with_retries(lambda job=job: work(job), pause_ms=pause_ms)
            except Exception as e:  # noqa: BLE001  the queue goes on with the next job
                status = "FAILED"
                failed(job, e)
            if done:
                jobs.sparkSession.createDataFrame([(job["jobId"], status)], DONE).write.mode("append").parquet(done)

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def start_pool(jobs: DataFrame, work: Callable[[dict, int], str | None], checkpoint: str, done: str, tasks: int = POOL, pause_ms: int = PAUSE_MS, once: bool = True):  # noqa: ANN201
    """Runs the jobs of a stream on the executors, `tasks` at a time. work(job, attempt) is sent to the tasks; what it returns
    and every job's status, attempts and error go to the folder `done` (RESULT), a directory for each checkpoint and batch. A batch
    that runs again after a failure replaces its own results and leaves out the jobs of others, so every job has one result;
    a job that was at work when its executor was lost is run again."""
    run_name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job in frame.to_dict("records"):
                tried: list[int] = []

                def attempt(job: dict = job, tried: list[int] = tried) -> None:
                    tried.append(len(tried) + 1)
                    told[0] = work(job, tried[-1])

                told: list[str | None] = [None]
                try:
                    with_retries(attempt, pause_ms=pause_ms)
                    out.append((job["jobId"], "DONE", len(tried), told[0], None))
                except Exception as e:  # noqa: BLE001  the pool goes on with the next job
                    out.append((job["jobId"], "FAILED", len(tried), None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["jobId", "status", "attempts", "result", "error"])

    def batch(rows: DataFrame, number: int) -> None:
        from graphloam.plans.durable import Tables

        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(done)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        with Tables(spark) as tables:
            if there:
                finished = spark.read.schema(f"{RESULT}, run string, batch long").parquet(done).where((F.col("run") != run_name) | (F.col("batch") != number)).select("jobId")
                rows = rows.join(finished, "jobId", "left_anti").select(*rows.columns)
            rows = tables.write(rows.dropDuplicates(["jobId"]))
            rows.repartition(tasks, "jobId").mapInPandas(run, RESULT).write.mode("overwrite").parquet(f"{done}/run={run_name}/batch={number}")

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def progress(query) -> dict:  # noqa: ANN001
    """What a poll of a running query shows."""
    return {"active": query.isActive, "status": query.status, "last": query.lastProgress}
