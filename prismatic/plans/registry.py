"""Queries by name with the SQL that gives the same rows, and the tables that stand in for the image catalog.

Items are events (a job is a user, the status follows from the id), jobs are orders, library assets are
embeddings (a group is a label), content is documents. `ITEMS` and `ASSETS` are the same as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STATUSES = ("queued", "analyzing", "filtered", "beautify_planning", "enhancing", "enhanced", "tagging", "rejected", "selected", "failed", "not_selected", "cancelled")
STEPS = ("pending", "processing", "completed", "failed", "queued")
#: Name of a step's status column, divisor of the id and number of values: value 0 is null.
STEP_COLUMNS = (("completion_status", 12, 5), ("ai_status", 60, 5), ("plan_status", 7, 5), ("analysis_status", 11, 5), ("embedding_status", 13, 5), ("match_status", 17, 6))


def query(name: str, oracle: str | None = None):
    """Register a query; without SQL where none expresses it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    n = F.col("event_id")
    steps = [F.when(F.floor(n / d) % k > 0, pick(STEPS, F.floor(n / d) % k - 1)).alias(c) for c, d, k in STEP_COLUMNS]
    return events.select(n.alias("image_id"), F.col("user_id").alias("job_id"), F.col("ts").alias("created_at"), F.col("value").alias("score"), "event_type", "props", pick(STATUSES, n % 12).alias("status"), *steps)


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ITEMS = "items AS (SELECT event_id AS image_id, user_id AS job_id, ts AS created_at, value AS score, event_type, props, " f"({_listed(STATUSES)})[event_id % 12 + 1] AS status, " + ", ".join(
    f"CASE WHEN (event_id // {d}) % {k} > 0 THEN ({_listed(STEPS)})[(event_id // {d}) % {k}] END AS {c}" for c, d, k in STEP_COLUMNS
) + " FROM events)"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("label").alias("group_id"), F.col("embedding").cast("array<double>").alias("vector"))


ASSETS = "assets AS (SELECT vec_id AS asset_id, label AS group_id, embedding::DOUBLE[] AS vector FROM embeddings)"


def rounded(x: Column, digits: int = 4) -> Column:
    """For comparison: doubles to a fixed number of digits, no negative zero."""
    return F.round(x, digits) + F.lit(0.0)
