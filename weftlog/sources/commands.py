"""Commands and workflow definitions from JSON text, read strictly: a known shape, nothing beside it, one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a command's text at most, and its fields. Fixed values.
LARGEST = 8 << 20
FIELDS = ["kind", "request_id", "workflow_id", "task_id", "attempt_id", "at", "definition", "output", "error", "worker_id", "lease_expires_at", "fencing_token", "timer_id", "fanout", "reason"]


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """One definition a file (S1); a file that is not one JSON object of the expected shape fails the read."""
    retry = "struct<max_attempts: long, initial_backoff_millis: long, backoff_multiplier: long, max_backoff_millis: long>"
    undo = "struct<task_type: string>"
    fanout = f"struct<task_type: string, aggregate_task_id: string, max_items: long, retry: {retry}, timeout_millis: long, compensation: {undo}>"
    task = f"struct<id: string, type: string, dependencies: array<string>, retry: {retry}, timeout_millis: long, compensation: {undo}, fanout: {fanout}>"
    return spark.read.schema(f"name string, namespace string, start_at long, tasks array<{task}>").option("multiLine", True).option("mode", "FAILFAST").json(path)


def submissions(definitions: DataFrame, request: Column, now: Column) -> DataFrame:
    """Submit commands of definitions, at the time ``now`` in milliseconds."""
    return definitions.select(F.lit("submit_workflow").alias("kind"), request.alias("request_id"), now.alias("at"), F.struct(*definitions.columns).alias("definition"))


def error(text: Column) -> Column:
    """Why a text is no command: too large, no JSON object, an unknown field, or no kind; null if it is one."""
    keys = F.json_object_keys(text)
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0
    return F.when(F.octet_length(text) > LARGEST, "too_large").when(text.isNull() | F.try_parse_json(text).isNull() | keys.isNull(), "invalid_json").when(unknown, "unknown_field").when(F.get_json_object(text, "$.kind").isNull(), "no_kind")
