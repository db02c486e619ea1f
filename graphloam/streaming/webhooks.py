"""Webhook deliveries as a stream: deduplication, gates, routing, audit and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloam.functions import crypto, text
from graphloam.schemas import PUSH
from graphloam.streaming.seen import SeenIds

WATERMARK = "7 days"


def dedup_stream(deliveries: DataFrame, watermark: str = WATERMARK, time_column: str = "receivedAt", key: str = "deliveryId") -> DataFrame:
    """The first of equal delivery ids within the watermark; the state is bounded by it. Older repeats are caught by the
    audit table in route(). timestamp_ntz is cast, as watermarks need an instant."""
    typed = deliveries.withColumn(time_column, F.col(time_column).cast("timestamp"))
    return typed.withWatermark(time_column, watermark).dropDuplicatesWithinWatermark([key])


def skip_reason(event: Column, ref: Column, after: Column, wanted_ref: Column, current: Column) -> Column:
    """T4: why a verified delivery starts no ingestion; null if it does."""
    return (
        F.when(event == "ping", "ping").when(~F.coalesce(event == "push", F.lit(False)), "not a push")
        .when(~F.coalesce(ref == wanted_ref, F.lit(False)), "other branch").when(F.coalesce(after == current, F.lit(False)), "same commit")
    )


def route(deliveries: DataFrame, repositories: DataFrame, audit: DataFrame) -> DataFrame:
    """Deliveries with outcome and, for audited ones, status and errorMessage.

    repositories: (id, webhookSecret, trackedBranch, defaultBranch, currentCommitHash). Gates in order: missing id,
    duplicate, unknown repository, unconfigured, bad signature (no audit row for these); then ping, other events, other
    branches and the commit that is already ingested are SKIPPED, the rest is ACCEPTED.
    """
    seen = audit.select(F.col("deliveryId").alias("__seen")).distinct()
    repos = repositories.select(F.col("id").alias("__repo"), "webhookSecret", "trackedBranch", "defaultBranch", "currentCommitHash")
    rows = deliveries.join(seen, F.col("deliveryId") == F.col("__seen"), "left").join(repos, F.col("repositoryId") == F.col("__repo"), "left")
    push = F.from_json(F.decode("rawBody", "UTF-8"), PUSH)
    rows = rows.withColumn("push", push)
    ref = text.tracked_ref(F.col("trackedBranch"), F.col("defaultBranch"))
    skip = skip_reason(F.col("event"), F.col("push.ref"), F.col("push.after"), ref, F.col("currentCommitHash"))
    missing = F.col("deliveryId").isNull() | (F.col("deliveryId") == "")
    outcome = (
        F.when(missing, "missing_delivery").when(F.col("__seen").isNotNull(), "duplicate").when(F.col("__repo").isNull(), "unknown_repository")
        .when(F.col("webhookSecret").isNull(), "unconfigured").when(~crypto.signature_ok(F.col("webhookSecret"), F.col("rawBody"), F.col("signature")), "bad_signature")
        .when(F.col("skip").isNotNull(), "skipped").otherwise("accepted")
    )
    out = rows.withColumn("skip", skip).withColumn("outcome", outcome)
    status = F.when(F.col("outcome") == "skipped", "SKIPPED").when(F.col("outcome") == "accepted", "ACCEPTED")
    return out.withColumn("status", status).withColumn("errorMessage", F.when(F.col("outcome") == "skipped", F.col("skip"))).drop("__seen", "__repo", "webhookSecret", "trackedBranch", "defaultBranch", "currentCommitHash", "skip")


def audit_rows(routed: DataFrame) -> DataFrame:
    """WEBHOOK_EVENTS of the deliveries that passed the gates; the id is a hash of the delivery id, so that writing a batch
    again gives the same rows."""
    return routed.where("status is not null").select(
        F.sha2("deliveryId", 256).alias("id"), "repositoryId", F.col("event").alias("eventType"), "deliveryId", "receivedAt", F.lit(None).cast("timestamp").alias("processedAt"), "status", text.content_hash(F.col("rawBody")).alias("payloadHash"), "errorMessage",
    )


def job_rows(routed: DataFrame) -> DataFrame:
    """A job for each accepted delivery."""
    return routed.where("status = 'ACCEPTED'").select("repositoryId", F.sha2(F.concat(F.lit("job:"), "deliveryId"), 256).alias("jobId"), F.lit("webhook").alias("triggeredBy"), F.sha2("deliveryId", 256).alias("webhookEventId"))


def start(deliveries: DataFrame, repositories: DataFrame, audit_path: str, jobs_path: str, checkpoint: str, watermark: str = WATERMARK, once: bool = True):  # noqa: ANN201
    """The running query. A batch is written under its number, so a repeated batch replaces its own files: the
    sinks are exactly-once."""
    spark = deliveries.sparkSession
    seen = SeenIds(spark, f"{audit_path}/_seen")

    def batch(rows: DataFrame, number: int) -> None:
        from graphloam.plans.durable import Tables

        with Tables(spark) as tables:
            rows = tables.write(rows.withColumn("id", F.sha2("deliveryId", 256)))
            # of the history, only the buckets of this batch's ids
            known = seen.among(rows.select("id"), number).join(rows.select("id", "deliveryId"), "id").select("deliveryId")
            routed = tables.write(route(rows.drop("id"), repositories, known))
            audited = audit_rows(routed)
            audited.write.mode("overwrite").parquet(f"{audit_path}/batch={number}")
            job_rows(routed).write.mode("overwrite").parquet(f"{jobs_path}/batch={number}")
            seen.add(audited.select("id"), number)

    writer = dedup_stream(deliveries, watermark).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def event_status(events: DataFrame) -> DataFrame:
    """T5: the last status of each delivery, from an append-only log."""
    from graphloam.operators.mutate import latest_by_key

    return latest_by_key(events, "deliveryId", "at", "status")
