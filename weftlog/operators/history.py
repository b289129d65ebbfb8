"""Operators over workflow histories: the log, tasks and their dependencies, timers, leases and usage.

All are DataFrame compositions keyed by workflow, so one shuffle on the workflow serves a whole chain of
them. Functions take and return DataFrames with the columns that ``weftlog.plans.views`` names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_workflow():
    """Windows need a session, so this one is made when it is used."""
    return Window.partitionBy("workflow_id")


def request_outcomes(log: DataFrame) -> DataFrame:
    """First use of a request is accepted; a repeat is a duplicate when its hash is the first one's, else a conflict."""
    same = Window.partitionBy("request_id").orderBy("pos")
    first, hash_ = F.first("pos").over(same), F.first("request_hash").over(same)
    outcome = F.when(F.row_number().over(same) == 1, "accepted").when(F.col("request_hash") == hash_, "duplicate").otherwise("conflict")
    return log.select("request_id", "pos", outcome.alias("outcome"), first.alias("origin_pos"))


def gaps(log: DataFrame) -> DataFrame:
    """Rows whose sequence is not one more than the row before (or not 1 at the start)."""
    before = F.coalesce(F.lag("sequence").over(by_workflow().orderBy("pos")), F.lit(0))
    return log.withColumn("expected", (before + 1).cast("long")).where("sequence <> expected").select("workflow_id", "pos", "sequence", "expected")


def regressions(log: DataFrame) -> DataFrame:
    """Rows that are earlier in time than the row before; equal times are allowed."""
    return log.withColumn("updated_at", F.lag("at_ms").over(by_workflow().orderBy("sequence"))).where("at_ms < updated_at").select("workflow_id", "sequence", "at_ms", "updated_at")


def current_state(log: DataFrame) -> DataFrame:
    """The last event of each workflow: an aggregate with map-side combine, no window."""
    last = F.max_by(F.struct("kind", "at_ms", "request_id"), "sequence")
    return log.groupBy("workflow_id").agg(last.alias("s"), F.max("sequence").alias("version")).select("workflow_id", F.col("s.kind").alias("kind"), F.col("s.at_ms").alias("updated_at"), F.col("s.request_id").alias("request_id"), "version")


def tail(log: DataFrame, after: int, terminal: list[str]) -> DataFrame:
    """Events after a cursor, cut off behind each workflow's first terminal event."""
    end = F.min(F.when(F.col("kind").isin(terminal), F.col("sequence"))).over(by_workflow())
    return log.withColumn("end", end).where((F.col("sequence") > after) & (F.col("end").isNull() | (F.col("sequence") <= F.col("end")))).select("workflow_id", "sequence", "kind", "at_ms")


def remaining_dependencies(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per task how many direct dependencies are not completed; tasks without any keep their zero.

    ``tasks`` needs workflow_id, task_ord, task_id, status. Both joins and the aggregate are on the workflow.
    """
    deps = tasks.select("workflow_id", F.col("task_ord").alias("dep_ord"), F.col("status").alias("dep_status"))
    open_ = edges.join(deps, ["workflow_id", "dep_ord"], "left").groupBy("workflow_id", "task_ord").agg(F.count_if(F.coalesce(F.col("dep_status") != "completed", F.lit(True))).alias("remaining"))
    return tasks.join(open_, ["workflow_id", "task_ord"], "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)).cast("long"))


def ready_tasks(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks with nothing left to wait for."""
    return remaining_dependencies(tasks, edges).where((F.col("status") == "pending") & (F.col("remaining") == 0)).select("workflow_id", "task_id", "remaining")


def task_inputs(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per task and direct dependency with that one's output; a dependency without output gives null."""
    outputs = tasks.select("workflow_id", F.col("task_ord").alias("dep_ord"), F.col("task_id").alias("dep_id"), F.when(F.col("status") == "completed", F.col("part")).alias("output"))
    ids = tasks.select("workflow_id", "task_ord", "task_id")
    return edges.join(ids, ["workflow_id", "task_ord"]).join(outputs, ["workflow_id", "dep_ord"], "left").select("workflow_id", "task_id", "dep_id", "output")


def summary(tasks: DataFrame, statuses: list[str]) -> DataFrame:
    """Total and one count per status of each workflow."""
    return tasks.groupBy("workflow_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses])


def namespace_usage(workflows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Workflows, open tasks and ready work of each namespace, and of all in a row without namespace; terminal workflows hold nothing."""
    # tasks are counted per workflow before the join, so the join moves one row a workflow
    open_ = tasks.groupBy("workflow_id").agg(F.count_if(F.col("status") != "completed").alias("open"))
    live = workflows.where(~F.col("status").isin("completed", "failed", "cancelled", "compensated")).join(open_, "workflow_id", "left")
    return live.rollup("namespace").agg(F.count("*").alias("workflows"), F.sum(F.coalesce("open", F.lit(0))).cast("long").alias("tasks"), F.count_if(F.col("status") == "running").alias("running"))


def compensation_order(tasks: DataFrame) -> DataFrame:
    """Completed tasks from the last completed back, by time and then id: the order of a rollback."""
    order = by_workflow().orderBy(F.desc("started"), F.desc("task_id"))
    return tasks.where("status = 'completed'").select("workflow_id", "task_id", F.row_number().over(order).cast("long").alias("turn"))


def attempts(log: DataFrame, kind: str) -> DataFrame:
    """The starts of each workflow with their attempt number, which is also the fence."""
    n = F.row_number().over(by_workflow().orderBy("sequence")).cast("long")
    return log.where(F.col("kind") == kind).select("workflow_id", "sequence", n.alias("attempt"), n.alias("fence"))


def lease_outcomes(log: DataFrame, start: str, complete: str, millis: int) -> DataFrame:
    """Each completion against the lease of the latest start before it: none is fenced, at or after its end is expired."""
    order = by_workflow().orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("kind") == start, F.col("at_ms")), ignorenulls=True).over(order)
    used = F.last(F.when(F.col("kind").isin(start, complete), F.col("kind")), ignorenulls=True).over(order)
    rows = log.select("workflow_id", "sequence", "kind", "at_ms", (begun + millis).alias("lease_until"), used.alias("used")).where(F.col("kind") == complete)
    outcome = F.when(F.col("used").isNull() | (F.col("used") == complete), "fenced").when(F.col("at_ms") >= F.col("lease_until"), "expired").otherwise("accepted")
    return rows.select("workflow_id", "sequence", outcome.alias("outcome"))


def timeout_or_expiry(tasks: DataFrame, policies: DataFrame) -> DataFrame:
    """Which comes first for a lease that is cut at the task's timeout: the timeout wins ties."""
    lease, timeout = F.col("started") + F.col("initial") * 10, F.col("started") + F.when(F.col("cap") > 0, F.col("cap")).otherwise(F.col("initial") * 10)
    rows = tasks.join(policies, "part").select("task_id", F.least(lease, timeout).alias("lease_until"), timeout.alias("deadline"))
    return rows.select("task_id", "lease_until", "deadline", F.when(F.col("deadline") <= F.col("lease_until"), "timeout").otherwise("expiry").alias("winner"))


def due_timers(tasks: DataFrame, policies: DataFrame, limit: int = 256) -> DataFrame:
    """The timers to fire next, at most so many a dispatch: by deadline, workflow and id."""
    rows = tasks.where("status = 'pending'").join(policies, "part").select((F.col("started") + F.col("initial")).alias("deadline"), "workflow_id", F.col("task_id").alias("timer_id"))
    return rows.orderBy("deadline", "workflow_id", "timer_id").limit(limit)


def segments(log: DataFrame) -> DataFrame:
    """Events by workflow and day: first and last sequence, number, and whether they are contiguous."""
    day = F.floor(F.col("at_ms") / 86_400_000).cast("long")
    out = log.withColumn("applied_index", day).groupBy("workflow_id", "applied_index").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("events"))
    return out.withColumn("contiguous", F.col("last_sequence") - F.col("first_sequence") + 1 == F.col("events"))


def expanded_receipts(log: DataFrame) -> DataFrame:
    """Receipts (a segment's range) expanded to their events again by an equi and range join."""
    ranges = segments(log).select("workflow_id", "applied_index", "first_sequence", "last_sequence")
    e = log.select(F.col("workflow_id").alias("w"), "pos", "sequence", "kind")
    on = (F.col("workflow_id") == F.col("w")) & F.col("sequence").between(F.col("first_sequence"), F.col("last_sequence"))
    return ranges.join(e, on).select("workflow_id", "applied_index", "sequence", "kind")


def durations(log: DataFrame, start: str, end: str) -> DataFrame:
    """Seconds from a workflow's first ``start`` to its first ``end`` after it; workflows without both are left out."""
    begun = log.groupBy("workflow_id").agg(F.min(F.when(F.col("kind") == start, F.col("at_ms"))).alias("begun"))
    ended = log.where(F.col("kind") == end).join(begun, "workflow_id").where("at_ms >= begun").groupBy("workflow_id").agg(F.min("at_ms").alias("ended"), F.first("begun").alias("begun"))
    return ended.select("workflow_id", ((F.col("ended") - F.col("begun")) / 1000.0).alias("seconds"))


def histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts per upper bound: one aggregate over all bounds, then one row a bound."""
    one = values.agg(*[F.count_if(F.col(column) <= b).alias(f"b{k}") for k, b in enumerate(bounds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)])).alias("x")).select("x.le", "x.n")


def utilisation(tasks: DataFrame, credits: int) -> DataFrame:
    """Per worker the tasks in flight over its credits; without credits 0."""
    rows = tasks.groupBy("worker").agg(F.count_if(F.col("status") == "pending").alias("inflight"))
    return rows.select("worker", F.lit(credits).cast("long").alias("credits"), "inflight", F.when(F.lit(credits) > 0, F.col("inflight") / F.lit(float(credits or 1))).otherwise(0.0).alias("ratio"))


def topological(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path depth of each task and its place by depth and id.

    Rows stream by, sorted by workflow; a task holds one small graph at a time and answers many in a batch.
    """
    deps = edges.groupBy("workflow_id", "task_ord").agg(F.collect_list("dep_ord").alias("deps"))
    rows = tasks.select("workflow_id", "task_ord", "task_id").join(deps, ["workflow_id", "task_ord"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in zip(pdf["workflow_id"].tolist(), pdf["task_ord"].tolist(), pdf["task_id"], pdf["deps"]):
                if held and held[-1][0] != row[0]:
                    out += _placed(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["workflow_id", "task_id", "depth", "turn"])
        if held:
            yield pd.DataFrame(_placed(held), columns=["workflow_id", "task_id", "depth", "turn"])

    dealt = rows.repartition("workflow_id").sortWithinPartitions("workflow_id", "task_ord")
    return dealt.mapInPandas(run, "workflow_id long, task_id string, depth long, turn long")


def _placed(rows: list[tuple]) -> list[tuple]:
    """One workflow's tasks (workflow, task, id, dependencies) by waves; a cycle is an error."""
    left, depth = {r[1]: () if r[3] is None else tuple(r[3]) for r in rows}, {}
    while left:
        wave = {o: max((depth[x] + 1 for x in d), default=0) for o, d in left.items() if all(x in depth for x in d)}
        if not wave:
            raise ValueError(f"workflow {rows[0][0]} has a cycle")
        depth |= wave
        left = {o: d for o, d in left.items() if o not in wave}
    order = sorted((depth[o], name) for _, o, name, _ in rows)
    return [(rows[0][0], name, d, k) for k, (d, name) in enumerate(order, 1)]


def chosen(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """An ordered chain of conditions, the first that holds names the result."""
    out = F.lit(otherwise)
    for condition, name in reversed(cases):
        out = F.when(condition, name).otherwise(out)
    return out
