"""What a workflow's state says and how it is kept: canonical forms and fingerprints, flags, clocks, timers, retention.

All native expressions; a collected list is one workflow's tasks or one task's dependencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reducer import MOST, TERMINAL


def canonical_tasks(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, definition): tasks sorted by id, each with its dependencies sorted and none as an empty list, as JSON."""
    names = tasks.select("workflow_id", F.col("task_ord").alias("dep_ord"), F.col("task_id").alias("dep_id"))
    deps = edges.join(names, ["workflow_id", "dep_ord"]).groupBy("workflow_id", "task_ord").agg(F.array_sort(F.collect_list("dep_id")).alias("deps"))
    rows = tasks.join(deps, ["workflow_id", "task_ord"], "left")
    one = F.struct(F.col("task_id").alias("id"), F.coalesce("deps", F.array().cast("array<string>")).alias("dependencies"))
    return rows.groupBy("workflow_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("definition"))


def canonical_items(items: Column) -> Column:
    """Fan-out items (structs that begin with their key) in the order of their keys, an empty payload as none."""
    return F.array_sort(F.transform(items, lambda x: F.struct(x["key"].alias("key"), F.when(F.size(x["payload"]) > 0, x["payload"]).alias("payload"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def fingerprints(tasks: DataFrame) -> DataFrame:
    """(workflow_id, state_hash): of each task's id and status in the order of ids."""
    return tasks.groupBy("workflow_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("task_id").alias("id"), "status")))), 256).alias("state_hash"))


def terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_leased(status: Column, worker: Column) -> Column:
    """Running, or being undone by a worker."""
    return (status == "running") | ((status == "compensating") & worker.isNotNull())


def is_runnable(status: Column, worker: Column) -> Column:
    """Ready, or to be undone and not yet taken."""
    return (status == "ready") | ((status == "compensating") & worker.isNull())


def flags(tasks: DataFrame) -> DataFrame:
    """(workflow_id, active, leased, runnable, ended): whether any task is open, and how many are held, can be taken, are over."""
    s, w = F.col("status"), F.col("worker")
    return tasks.groupBy("workflow_id").agg(F.bool_or(s.isin("pending", "ready", "running", "compensating")).alias("active"), F.count_if(is_leased(s, w)).alias("leased"), F.count_if(is_runnable(s, w)).alias("runnable"), F.count_if(terminal(s)).alias("ended"))


def assignments(tasks: DataFrame) -> DataFrame:
    """What a worker is told of each task that it holds: the type is that of the undoing while it is undone."""
    kind = F.when(F.col("status") == "compensating", F.concat(F.lit("undo-"), F.col("task_type"))).otherwise(F.col("task_type"))
    held = tasks.where(is_leased(F.col("status"), F.col("worker")))
    return held.select("worker", "workflow_id", "task_id", kind.alias("capability"), (F.col("status") == "compensating").alias("compensation"))


def session_code(error: Column) -> Column:
    """What a worker's session is told of an error."""
    known = {"fenced": "fenced", "lease_expired": "expired", "request_conflict": "conflict", "invalid_command": "invalid", "invalid_transition": "invalid"}
    return F.coalesce(*[F.when(error == k, x) for k, x in known.items()], F.lit("unavailable"))


def advanced(now: Column, delta: Column) -> tuple[Column, Column]:
    """(error, now) of a clock that moves by ``delta``: not back, and not beyond its range; with an error it stays."""
    error = F.when(delta < 0, "time_regression").when(delta > F.lit(MOST) - now, "time_overflow")
    return error, F.when(error.isNull(), F.try_add(now, delta)).otherwise(now)


def clamped(log: DataFrame) -> DataFrame:
    """(workflow_id, sequence, at_ms): each command's time, never before that of an earlier one of its workflow."""
    before = Window.partitionBy("workflow_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.select("workflow_id", "sequence", F.max("at_ms").over(before).alias("at_ms"))


def next_timers(timers: DataFrame) -> DataFrame:
    """The timer of each workflow that is due first, by deadline and id."""
    return timers.groupBy("workflow_id").agg(F.min(F.struct("deadline", "timer_id")).alias("t")).select("workflow_id", "t.deadline", "t.timer_id")


def all_timers(timers: DataFrame) -> DataFrame:
    """Every timer with its turn in its workflow, by deadline and id."""
    return timers.withColumn("turn", F.row_number().over(Window.partitionBy("workflow_id").orderBy("deadline", "timer_id")).cast("long"))


def retained(workflows: DataFrame, requests: DataFrame, compact: Column) -> DataFrame:
    """(workflow_id, kept, requests): terminal workflows lose their state and requests (``evicted``), or, where ``compact`` holds,
    only their tasks, timers and stored events (``compacted``); the others stay whole."""
    kept = F.when(~terminal(F.col("status")), "whole").when(compact, "compacted").otherwise("evicted")
    n = requests.groupBy("workflow_id").agg(F.count("*").alias("n"))
    rows = workflows.withColumn("kept", kept).join(n, "workflow_id", "left")
    return rows.select("workflow_id", "kept", F.when(F.col("kept") == "evicted", 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("requests"))


def should_snapshot(applied: Column, snapshot: Column, threshold: Column) -> Column:
    """Whether enough was applied since the last snapshot; a threshold of 0 turns snapshots off."""
    return (threshold > 0) & (applied >= snapshot) & (applied - snapshot >= threshold)


def verified(segments: DataFrame) -> DataFrame:
    """(workflow_id, events, sound): whether a workflow's segments begin at 1, are whole, and follow each other without a gap."""
    order = Window.partitionBy("workflow_id").orderBy("first_sequence")
    follows = F.col("first_sequence") == F.coalesce(F.lag("last_sequence").over(order), F.lit(0)) + 1
    return segments.withColumn("fits", follows & F.col("contiguous")).groupBy("workflow_id").agg(F.sum("events").alias("events"), F.bool_and("fits").alias("sound"))


def weights_error(text: Column) -> Column:
    """Why a text of ``name=weight`` items is refused, by its first bad item: shape, weight, duplicate; null if it is fine or blank."""
    items = F.transform(F.split(text, ","), lambda x: F.split(F.trim(x), "=", 2))
    names = F.transform(items, lambda p: F.trim(F.get(p, F.lit(0))))

    def found(p: Column, i: Column) -> Column:
        weight = F.when(F.get(p, F.lit(1)).rlike(r"^[+-]?[0-9]+$"), F.get(p, F.lit(1)).try_cast("long"))
        seen = F.exists(F.slice(names, F.lit(1), i), lambda n: n == F.trim(F.get(p, F.lit(0))))
        return F.when((F.size(p) < 2) | (F.trim(F.get(p, F.lit(0))) == ""), "shape").when(weight.isNull() | (weight < 1), "weight").when(seen, "duplicate")

    return F.when(F.trim(text) != "", F.get(F.filter(F.transform(items, found), lambda e: e.isNotNull()), F.lit(0)))


def committed(entries: DataFrame) -> DataFrame:
    """(pos, outcome, index, term) of a log's commands, where a repeated request has the index and term of its first use,
    also within one entry; the same request with another hash is a conflict and has neither."""
    order = Window.partitionBy("request_id").orderBy("pos")
    first = F.first(F.struct("request_hash", "index", "term")).over(order)
    rows = entries.withColumn("first", first).withColumn("turn", F.row_number().over(order))
    same = F.col("request_hash") == F.col("first.request_hash")
    outcome = F.when(F.col("turn") == 1, "applied").when(same, "duplicate").otherwise("conflict")
    return rows.select("pos", outcome.alias("outcome"), F.when(same, F.col("first.index")).alias("index"), F.when(same, F.col("first.term")).alias("term"))


def counters(log: DataFrame) -> DataFrame:
    """(received, accepted, duplicates, conflicts): one row; requests are grouped first, so nothing is put in one order."""
    uses = log.groupBy("request_id").agg(F.min_by("request_hash", "pos").alias("h"))
    per = log.groupBy("request_id", "request_hash").agg(F.count("*").alias("m")).join(uses, "request_id")
    hit = F.col("request_hash") == F.col("h")
    return per.agg(F.sum("m").alias("received"), F.count_if(hit).alias("accepted"), F.sum(F.when(hit, F.col("m") - 1).otherwise(0)).alias("duplicates"), F.sum(F.when(hit, 0).otherwise(F.col("m"))).alias("conflicts"))


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that one of two replicas has more often than the other, with the side that has them."""
    return one.exceptAll(two).withColumn("side", F.lit("first")).unionByName(two.exceptAll(one).withColumn("side", F.lit("second")))


def allowed(kind: Column, local: Column) -> Column:
    """Whether a caller may send a command: submissions, and with local execution also starts and completions."""
    return (kind == "submit_workflow") | (local & kind.isin("start_task", "complete_task"))
