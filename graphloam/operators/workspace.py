"""Repositories and workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECRETS = ["githubToken", "webhookSecret"]


def live_repositories(repositories: DataFrame) -> DataFrame:
    """Not deleted, newest first."""
    return repositories.where(F.col("deletedAt").isNull()).orderBy(F.desc("createdAt"), "id")


def public_view(repositories: DataFrame) -> DataFrame:
    """Lower-case enums, derived columns, no secrets."""
    sync = F.when(F.col("lastWebhookAt").isNotNull() & F.col("lastWebhookStatus").isNotNull(), F.struct(F.col("lastWebhookAt").alias("at"), F.lower("lastWebhookStatus").alias("status")))
    rest = [c for c in repositories.columns if c not in SECRETS]
    return repositories.withColumns({"status": F.lower("status"), "sourceType": F.lower("sourceType"), "webhookConfigured": F.col("webhookSecret").isNotNull(), "syncStatus": sync}).select(*rest, "webhookConfigured", "syncStatus")


def secrets(repositories: DataFrame, repository: str) -> DataFrame:
    """The one read of the secret columns."""
    return repositories.where(F.col("id") == repository).select("id", *SECRETS)


def by_key(rows: DataFrame, **keys: object) -> DataFrame:
    """A point lookup; the first row if a key is not unique."""
    for k, v in keys.items():
        rows = rows.where(F.col(k) == F.lit(v))
    return rows.limit(1)


def registry(parsed_files: DataFrame, repository: str, columns: tuple[str, ...] = ("path", "contentHash")) -> DataFrame:
    """The registry's rows of a repository; only the columns asked for are read."""
    return parsed_files.where(F.col("repositoryId") == repository).select(*columns)


def seed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The local workspace and user."""
    return spark.createDataFrame([("local-workspace", "Local workspace")], "id string, name string"), spark.createDataFrame([("local-user", "local-workspace", "user@localhost", "Local user")], "id string, workspaceId string, email string, name string")
