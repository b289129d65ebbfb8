"""Queries of the metrics: histograms, quantiles of their buckets, sliding rates, gauges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import history as h
from .operators import metrics as m
from .plans import views as v
from .registry import query

_LE = f"(SELECT unnest([{', '.join(f'{b!r}::DOUBLE' for b in m.DEFAULT)}, 'inf'::DOUBLE]) AS le)"
_DISPATCH = f"(SELECT kind, le, count(*) FILTER (value / 50 <= le) AS n FROM log CROSS JOIN {_LE} GROUP BY 1, 2)"


def _dispatch(s, d):
    return m.histogram(v.log(s, d).select("kind", (F.col("value") / 50).alias("seconds")), "seconds", m.DEFAULT, "kind")


@query(f"SELECT kind, le, n FROM {_DISPATCH}")
def dispatch_histogram(s, d):
    return _dispatch(s, d)


@query(f"""SELECT kind, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (0.95 * total - under) / (n - under) END, 6) AS p95 FROM
(SELECT *, row_number() OVER (PARTITION BY kind ORDER BY le) AS r FROM (SELECT *, coalesce(lag(le) OVER (PARTITION BY kind ORDER BY le), 0) AS low, coalesce(lag(n) OVER (PARTITION BY kind ORDER BY le), 0) AS under, max(n) OVER (PARTITION BY kind) AS total
FROM {_DISPATCH}) WHERE n >= 0.95 * total AND n > 0) WHERE r = 1""")
def dispatch_p95(s, d):
    """The 95th percentile that a dashboard draws from cumulative buckets."""
    return m.quantile(_dispatch(s, d), 0.95, "kind").select("kind", F.round("value", 6).alias("p95"))


_SLIDING = "(SELECT kind, start, count(*) / 300.0 AS rate FROM (SELECT kind, unnest(range(at_ms // 60000 * 60000 - 240000, at_ms // 60000 * 60000 + 1, 60000)) AS start FROM log) GROUP BY 1, 2)"


@query(f"SELECT kind, round(max(rate), 6)::DOUBLE AS rate FROM {_SLIDING} GROUP BY 1")
def peak_rate(s, d):
    """The highest rate of each kind in any window of five minutes that begins at a full minute."""
    return m.sliding_rates(v.log(s, d), "at_ms", 300_000, 60_000, "kind").groupBy("kind").agg(F.round(F.max("rate"), 6).cast("double").alias("rate"))


_SECONDS = """(SELECT CASE last WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' ELSE 'compensated' END AS status, (hi - lo) / 1000.0 AS seconds FROM (SELECT workflow_id, arg_max(kind, sequence) AS last, max(at_ms) AS hi, min(at_ms) AS lo FROM log GROUP BY 1))"""
_BOUNDS = [0.001 * 4**k for k in range(12)] + [1e5, 1e6, 1e7]


@query(f"SELECT status, le, count(*) FILTER (seconds <= le) AS n FROM {_SECONDS} CROSS JOIN (SELECT unnest([{', '.join(f'{b!r}::DOUBLE' for b in _BOUNDS)}, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2")
def duration_by_status(s, d):
    """Seconds from a workflow's first event to its last, by the status that the last kind stands for."""
    kinds = {"purchase": "workflow_completed", "error": "workflow_failed", "click": "workflow_cancelled"}
    last = F.coalesce(*[F.when(F.col("last") == k, x) for k, x in kinds.items()], F.lit("other"))
    ends = v.log(s, d).groupBy("workflow_id").agg(F.max_by("kind", "sequence").alias("last"), ((F.max("at_ms") - F.min("at_ms")) / 1000).alias("seconds"))
    return m.histogram(ends.select(m.terminal_status(last).alias("status"), "seconds"), "seconds", _BOUNDS, "status")


_READY = "SELECT t.workflow_id, namespace FROM task t JOIN wf USING (workflow_id) WHERE t.status = 'pending' AND NOT EXISTS (SELECT 1 FROM edge e JOIN task p ON p.workflow_id = e.workflow_id AND p.task_ord = e.dep_ord WHERE e.workflow_id = t.workflow_id AND e.task_ord = t.task_ord AND p.status <> 'completed')"


@query(f"SELECT namespace, count(r.workflow_id) AS ready FROM (SELECT DISTINCT namespace FROM wf) LEFT JOIN ({_READY}) r USING (namespace) GROUP BY 1 UNION ALL SELECT '_all', count(*) FROM ({_READY})")
def ready_gauge(s, d):
    t, wf = v.tasks(s, d), v.workflows(s, d)
    ready = h.ready_tasks(t, v.edges(t)).join(wf.select("workflow_id", "namespace"), "workflow_id")
    return m.queue_gauge(ready, wf.select("namespace").distinct())


@query("SELECT count(*) FILTER (status = 'running') AS leaders, max(workflow_id) AS applied_index, (SELECT count(*) FROM task WHERE status = 'pending') AS pending FROM wf")
def stat_panels(s, d):
    """The numbers of a dashboard's first row: two aggregates of one row each, side by side."""
    one = v.workflows(s, d).agg(F.count_if(F.col("status") == "running").alias("leaders"), F.max("workflow_id").alias("applied_index"))
    two = v.tasks(s, d).agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return one.join(F.broadcast(two))


@query("SELECT status, count(*) AS n FROM (SELECT status, workflow_id FROM task WHERE task_type = 'A' UNION SELECT status, workflow_id FROM task WHERE task_type = 'R') GROUP BY 1")
def distinct_union(s, d):
    """Workflows of two kinds of tasks, each counted once a status."""
    t = v.tasks(s, d)
    pick = lambda k: t.where(F.col("task_type") == k).select("status", "workflow_id")
    return pick("A").union(pick("R")).distinct().groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT part, r AS retry, CASE WHEN cap > 0 THEN least(cap, initial * multiplier ** (r - 1)) ELSE initial * multiplier ** (r - 1) END::BIGINT AS delay,
sum(CASE WHEN cap > 0 THEN least(cap, initial * multiplier ** (r - 1)) ELSE initial * multiplier ** (r - 1) END::BIGINT) OVER (PARTITION BY part ORDER BY r)::BIGINT AS due FROM policy, (SELECT unnest(range(1, 6)) AS r) WHERE r < max_attempts""")
def retry_schedule(s, d):
    """Every retry that a policy allows, with its wait and the time since the first failure when attempts take no time."""
    p = v.policies(s, d).where("max_attempts > 1").select("part", "initial", "multiplier", "cap", F.explode(F.sequence(F.lit(1).cast("long"), F.col("max_attempts").cast("long") - 1)).alias("retry"))
    raw = (F.col("initial") * F.pow(F.col("multiplier"), F.col("retry") - 1)).cast("long")
    p = p.withColumn("delay", F.when(F.col("cap") > 0, F.least("cap", raw)).otherwise(raw))
    return p.select("part", "retry", "delay", F.sum("delay").over(Window.partitionBy("part").orderBy("retry")).alias("due"))
