"""Admission and weighted-fair selection: rules that depend on order, folded where the order lives.

Both are sequential by nature. Admission is sequential only within a namespace; the fold there holds one
number. Selection is sequential over all namespaces; its input is one row a namespace, never the work itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admitted(queue: DataFrame, limit: int) -> DataFrame:
    """(namespace, workflow_id, tasks, admitted): in order of submission; what does not fit takes nothing.

    Rows stream by, sorted within their namespace, so a task holds no more than a batch and a counter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, used = None, 0
        for pdf in batches:
            fits = []
            for namespace, n in zip(pdf["namespace"], pdf["tasks"]):
                if namespace != name:
                    name, used = namespace, 0
                fits.append(used + n <= limit)
                used += n if fits[-1] else 0
            yield pdf[["namespace", "workflow_id", "tasks"]].assign(admitted=fits)

    dealt = queue.select("namespace", "submitted", "workflow_id", "tasks").repartition("namespace").sortWithinPartitions("namespace", "submitted", "workflow_id")
    return dealt.mapInPandas(run, "namespace string, workflow_id long, tasks long, admitted boolean")


def picks(weights: list[tuple[str, int]], n: int) -> list[str]:
    """Smooth weighted round-robin: each gains its weight, the most wins (ties: the smaller name) and pays the total."""
    current, total, out = {k: 0 for k, _ in weights}, sum(w for _, w in weights), []
    for _ in range(n):
        for k, w in weights:
            current[k] += w
        best = min(current, key=lambda k: (-current[k], k))
        current[best] -= total
        out.append(best)
    return out


def fair(namespaces: DataFrame, n: int) -> DataFrame:
    """(pick_no, namespace) of ``n`` picks; ``namespaces`` has one row (namespace, weight) each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = picks(sorted(zip(pdf["namespace"], pdf["weight"])), n)
        return pd.DataFrame({"pick_no": range(1, len(found) + 1), "namespace": found})

    return namespaces.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "pick_no long, namespace string")


LARGEST = (1 << 31) - 1
#: Limits where none are given: of all namespaces, and of one: workflows, tasks, running.
GLOBAL, EACH = (100_000, 1_000_000, 10_000), (10_000, 100_000, 1_000)


def configured(namespaces: DataFrame, config: DataFrame) -> DataFrame:
    """Each namespace with its weight and running limit, or the defaults."""
    rows = namespaces.join(F.broadcast(config), "namespace", "left")
    return rows.select("namespace", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), F.coalesce("max_running", F.lit(EACH[2])).cast("long").alias("max_running"))


def config_error(weight: Column, workflows: Column, tasks: Column, running: Column) -> Column:
    """The first thing wrong with a namespace's configuration, or null."""
    limits = F.when((workflows < 1) | (tasks < 1) | (running < 1), "limit").when(running > tasks, "running_above_tasks")
    return F.when((weight < 1) | (weight > LARGEST), "weight").otherwise(limits)


def candidates(ready: DataFrame, offered: DataFrame) -> DataFrame:
    """Ready tasks whose capability some worker offers."""
    return ready.join(offered.select("capability").distinct(), "capability", "left_semi")


def planned(found: DataFrame, usage: DataFrame, credit: DataFrame) -> DataFrame:
    """(namespace, workflow_id, task_id, credit): one step of the weighted plan.

    ``usage`` has namespace, weight, max_running, running; ``credit`` what a namespace has from the step before.
    Eligible namespaces have candidates and run less than their limit. Each gains its weight, the most wins (ties:
    the smaller name) and pays the total, and gives its first candidate. Others lose their credit and have no row.
    """
    heads = found.groupBy("namespace").agg(F.min(F.struct("workflow_id", "task_id")).alias("head"))
    able = usage.where("running < max_running").join(heads, "namespace").join(credit, "namespace", "left")
    able = able.withColumn("now", F.coalesce("credit", F.lit(0)) + F.col("weight"))
    # a row a namespace, so the one aggregate of all is small
    chosen = able.agg(F.max_by("namespace", F.struct("now", F.array_append(F.transform(F.split("namespace", ""), lambda c: -F.ascii(c)), F.lit(1)))).alias("chosen"), F.sum("weight").alias("all"))
    won = F.col("namespace") == F.col("chosen")
    rows = able.join(F.broadcast(chosen))
    return rows.select("namespace", F.when(won, F.col("head.workflow_id")).alias("workflow_id"), F.when(won, F.col("head.task_id")).alias("task_id"), F.when(won, F.col("now") - F.col("all")).otherwise(F.col("now")).alias("credit"))


def running_admitted(queue: DataFrame, whole: int, each: int) -> DataFrame:
    """Units of one: the first ``each`` of a namespace, and of those the first ``whole`` of all.

    What a namespace's limit turns away takes nothing of the global one. Only the rows that namespaces admit, at most
    ``each`` of one, are put in one order.
    """
    own = queue.withColumn("r", F.row_number().over(Window.partitionBy("namespace").orderBy("submitted", "workflow_id")))
    first = own.where(F.col("r") <= each).orderBy("submitted", "workflow_id").limit(whole).select("workflow_id", F.lit(True).alias("yes"))
    return own.join(first, "workflow_id", "left").select("namespace", "workflow_id", F.coalesce("yes", F.lit(False)).alias("admitted"))


def reserved(tasks: DataFrame) -> DataFrame:
    """(workflow_id, reserved): tasks of each workflow with the most items that their fan-outs (max_items, or null) may make."""
    return tasks.groupBy("workflow_id").agg((F.count("*") + F.sum(F.coalesce("max_items", F.lit(0)))).cast("long").alias("reserved"))


def admitted_within(queue: DataFrame, whole: int, each: int) -> DataFrame:
    """(namespace, workflow_id, tasks, admitted): first what all may hold, then what the namespace may; what does not fit takes nothing.

    Every row's fate hangs on all before it, so the fold is one ordered stream; it holds a number a namespace.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, total = {}, 0
        for pdf in batches:
            fits = []
            for namespace, n in zip(pdf["namespace"], pdf["tasks"]):
                fits.append(total + n <= whole and used.get(namespace, 0) + n <= each)
                if fits[-1]:
                    total, used[namespace] = total + n, used.get(namespace, 0) + n
            yield pdf[["namespace", "workflow_id", "tasks"]].assign(admitted=fits)

    rows = queue.select("namespace", "submitted", "workflow_id", "tasks").coalesce(1).sortWithinPartitions("submitted", "workflow_id")
    return rows.mapInPandas(run, "namespace string, workflow_id long, tasks long, admitted boolean")
