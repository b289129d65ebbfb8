"""What goes in and out of a store: ticks and dispatch, texts of events and metrics, snapshots on disk, limits of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import identity
from ..shared import place
from . import storage

#: What an entry of the log may hold: commands, events, bytes. Fixed values.
COMMANDS, EVENTS, BYTES = 256, 1 << 20, 64 << 20


def named(rows: DataFrame) -> DataFrame:
    """Submissions with the workflow that they name, or else the one that their namespace and request stand for."""
    return rows.withColumn("workflow_id", F.coalesce(F.when(F.trim("workflow_id") != "", F.col("workflow_id")), identity("workflow", F.col("namespace"), F.col("request_id"))))


def tick(timers: DataFrame, leases: DataFrame, now: int, dispatch: int = 256) -> DataFrame:
    """(kind, workflow_id, id, at_ms): the commands of one tick, the first due timers and every lease that has ended.

    A command's time is the latest of the clock, the workflow's last change (updated_at) and what was due.
    """
    at = lambda due: F.greatest(F.lit(now), "updated_at", due).alias("at_ms")
    fired = timers.where(F.col("deadline") <= now).orderBy("deadline", "workflow_id", "timer_id").limit(dispatch)
    fired = fired.select(F.lit("fire_timer").alias("kind"), "workflow_id", F.col("timer_id").alias("id"), at("deadline"))
    ended = leases.where(F.col("lease_until") <= now).select(F.lit("expire_lease").alias("kind"), "workflow_id", F.col("task_id").alias("id"), at("lease_until"))
    return fired.unionByName(ended)


def dispatched(runnable: DataFrame, workers: DataFrame) -> DataFrame:
    """(worker, workflow_id, task_id): what each worker (worker, credits, inflight) is sent of the tasks kept for it, in order, while it has credits."""
    order = Window.partitionBy("worker").orderBy("workflow_id", "task_id")
    free = workers.select("worker", F.greatest(F.col("credits") - F.col("inflight"), F.lit(0)).alias("free"))
    return runnable.withColumn("turn", F.row_number().over(order)).join(free, "worker").where("turn <= free").select("worker", "workflow_id", "task_id")


def as_of(log: DataFrame, index: int) -> DataFrame:
    """(workflow_id, kind, version) of each workflow when ``index`` was applied: a read that waits for an index sees just that."""
    return log.where(F.col("pos") <= index).groupBy("workflow_id").agg(F.max_by("kind", "sequence").alias("kind"), F.max("sequence").alias("version"))


def event_text(sequence: Column, kind: Column, data: Column) -> Column:
    """An event as the text that a stream of events sends."""
    return F.concat(F.lit("id: "), sequence.cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def parsed_events(lines: Column) -> tuple[Column, Column, Column]:
    """(sequence, kind, data) of such a text."""
    take = lambda name: F.regexp_extract(lines, rf"(?m)^{name}: (.*)$", 1)
    return take("id").cast("long"), take("event"), take("data")


def exposition(counts: DataFrame, metric: str, label: str) -> DataFrame:
    """(line) of a counter, a line a label, in the text form that scrapers read."""
    escaped = F.replace(F.replace(F.replace(F.col(label), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return counts.select(F.concat(F.lit(f'{metric}{{{label}="'), escaped, F.lit('"} '), F.col("n").cast("string")).alias("line"))


def entry_errors(entries: DataFrame) -> DataFrame:
    """(entry, commands, error) of log entries (entry, events, bytes a command): what exceeds what an entry may hold."""
    sums = entries.groupBy("entry").agg(F.count("*").alias("commands"), F.sum("events").alias("e"), F.sum("bytes").alias("b"))
    return sums.select("entry", "commands", F.when(F.col("commands") > COMMANDS, "commands").when(F.col("e") > EVENTS, "events").when(F.col("b") > BYTES, "bytes").alias("error"))


def unknown(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Requests that a store has never seen: an anti join; no filter that may err stands between."""
    return asked.join(held, "request_id", "left_anti")


def snapshot(spark: SparkSession, states: DataFrame, log: DataFrame, index: int) -> DataFrame:
    """(rows, digest, same, beyond): states written to the shared folder and read again, with their fingerprint before and after, and
    what is left of the log beyond ``index``. The files are written under a new name, so a write that is repeated replaces nothing."""
    path = place(spark, "snapshot")
    states.write.parquet(path)
    columns = [F.col(c) for c in sorted(states.columns)]
    before, after = storage.digest(states, *columns), storage.digest(spark.read.schema(states.schema).parquet(path), *columns)
    beyond = log.where(F.col("pos") > index).agg(F.count("*").alias("beyond"))
    same = F.broadcast(before.select(F.col("digest").alias("d")))
    return after.join(same).join(F.broadcast(beyond)).select("rows", "digest", (F.col("digest") == F.col("d")).alias("same"), "beyond")
