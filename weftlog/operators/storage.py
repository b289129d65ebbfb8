"""Reads of what a workflow store holds: point and range look-ups, receipts, task results, checks of log and snapshot.

All are filters, joins and aggregates on the key that is asked for, so a filter reaches the scan and a check needs
no order over the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["workflow_id", "task_id", "phase", "attempt_id"]


def first_events(log: DataFrame) -> DataFrame:
    """The first event of each workflow."""
    return log.groupBy("workflow_id").agg(F.min_by(F.struct("pos", "kind", "at_ms"), "sequence").alias("e")).select("workflow_id", "e.*")


def of_workflow(rows: DataFrame, workflow_id) -> DataFrame:
    """The rows of one workflow: a filter on the key, pushed to the scan."""
    return rows.where(F.col("workflow_id") == F.lit(workflow_id))


def receipts(log: DataFrame) -> DataFrame:
    """One row per request: what its first use did. A later use with the same hash gets this result again."""
    first = F.min_by(F.struct("request_hash", "workflow_id", "sequence", "pos"), "pos")
    return log.groupBy("request_id").agg(first.alias("r")).select("request_id", "r.*")


def looked_up(asked: DataFrame, outcomes: DataFrame, kept: DataFrame) -> DataFrame:
    """Each asked (request_id, request_hash) with its stored result: of the recent outcomes, or else of the receipts.

    A request known under another hash is a conflict, an unknown one missing.
    """
    recent = outcomes.select("request_id", F.col("request_hash").alias("oh"), F.col("sequence").alias("os"))
    old = kept.select("request_id", F.col("request_hash").alias("rh"), F.col("sequence").alias("rs"))
    known = F.coalesce("oh", "rh")
    answer = F.when(known.isNull(), "missing").when(known != F.col("request_hash"), "conflict").when(F.col("oh").isNotNull(), "outcome").otherwise("receipt")
    rows = asked.join(recent, "request_id", "left").join(old, "request_id", "left")
    return rows.select("request_id", "request_hash", answer.alias("answer"), F.when(known == F.col("request_hash"), F.coalesce("os", "rs")).alias("sequence"))


def active_receipts(kept: DataFrame, workflows: DataFrame, terminal: list[str]) -> DataFrame:
    """Receipts of workflows that have not ended."""
    return kept.join(workflows.where(~F.col("status").isin(*terminal)), "workflow_id", "left_semi")


def task_results(done: DataFrame, definitions: DataFrame) -> DataFrame:
    """Finished attempts with the type, phase and capability of their definition; without one the type is null."""
    return done.join(definitions, "workflow_id", "left").withColumn("capability", F.when(F.col("phase") == "compensation", F.concat(F.lit("undo-"), F.col("task_type"))).otherwise(F.col("task_type")))


def in_order(results: DataFrame) -> DataFrame:
    """Results with their turn in the workflow, by task, phase and attempt: the order of the key, made per workflow."""
    return results.withColumn("turn", F.row_number().over(Window.partitionBy("workflow_id").orderBy("task_id", "phase", "attempt_id")).cast("long"))


def repeated(results: DataFrame, identity: list[str]) -> DataFrame:
    """Identities that more than one result has; none in a sound store."""
    return results.groupBy(*identity).agg(F.count("*").alias("n")).where("n > 1")


def missing_before(index: DataFrame, column: str, after: int) -> DataFrame:
    """Indices from ``after`` + 2 on whose predecessor is missing: a dense log has none. A join on the index, no order of all."""
    have = index.select(F.col(column)).distinct()
    return have.where(F.col(column) > after + 1).join(have.select((F.col(column) + 1).alias(column)), column, "left_anti")


def unmatched(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(request_id, request_hash, side) of what a snapshot's requests or outcomes have alone; each must meet one of the other."""
    key = ["request_id", "request_hash"]
    one = requests.join(outcomes, key, "left_anti").select(*key, F.lit("request").alias("side"))
    return one.unionByName(outcomes.join(requests, key, "left_anti").select(*key, F.lit("outcome").alias("side")))


def digest(rows: DataFrame, *columns: Column) -> DataFrame:
    """(rows, digest): a fingerprint of a table that no order changes: the sum of numbers drawn from each row's hash."""
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def recovery(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many workflows a recovery lost, made up, or brought back in another state or version (workflow_id, status, version)."""
    x, y = before.alias("x"), after.alias("y")
    both = x.join(y, "workflow_id", "full")
    differs = lambda c: F.count_if(F.col(f"x.{c}").isNotNull() & F.col(f"y.{c}").isNotNull() & (F.col(f"x.{c}") != F.col(f"y.{c}")))
    return both.agg(F.count_if(F.col("y.version").isNull()).alias("lost"), F.count_if(F.col("x.version").isNull()).alias("extra"), differs("status").alias("state_mismatches"), differs("version").alias("version_mismatches"))


def expired_leases(tasks: DataFrame, now: int, millis: int) -> DataFrame:
    """Every open attempt whose lease has ended, by workflow and task; there is no limit."""
    return tasks.where("status = 'pending'").where(F.col("started") + millis <= now).select("workflow_id", "task_id", (F.col("started") + millis).alias("lease_until")).orderBy("workflow_id", "task_id")


def reconciled(inflight: DataFrame, leases: DataFrame) -> DataFrame:
    """What a session holds and still has an active lease for; vanished attempts are dropped."""
    return inflight.join(leases, ["worker", "task_id"], "left_semi")


def batch_errors(commands: DataFrame, most: int = 256) -> DataFrame:
    """(batch, n, error) of each batch of commands: 1 to ``most`` of them, each with a request of its own."""
    found = commands.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("requests"))
    return found.select("batch", "n", F.when(F.col("n") > most, "too_large").when(F.col("requests") < F.col("n"), "repeated_request").alias("error"))


#: What callers are told: error, status, code. Fixed values.
ERRORS = [
    ("not_leader", 307, "not_leader"),
    ("no_leader", 503, "unavailable"),
    ("request_conflict", 409, "conflict"),
    ("invalid_command", 400, "invalid"),
    ("capacity", 429, "capacity"),
]


def http_status(error: Column) -> tuple[Column, Column]:
    """(status, code) of an error; what is not listed is 500 and internal."""
    status, code = F.lit(500), F.lit("internal")
    for name, number, text in ERRORS:
        status, code = F.when(error == name, number).otherwise(status), F.when(error == name, text).otherwise(code)
    return status, code
