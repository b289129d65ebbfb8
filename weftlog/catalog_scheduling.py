"""Queries of the scheduler: candidates, plan, limits and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import history as h
from .operators import schedule
from .plans import views as v
from .registry import query


def _ready(s, d):
    t = v.tasks(s, d)
    names = t.select("workflow_id", "task_id", F.col("task_type").alias("capability"))
    return h.ready_tasks(t, v.edges(t)).join(names, ["workflow_id", "task_id"]).join(v.workflows(s, d).select("workflow_id", "namespace"), "workflow_id")


_READY = """, rdy AS (SELECT t.workflow_id, t.task_id, t.task_type AS capability, namespace FROM task t JOIN wf USING (workflow_id) WHERE t.status = 'pending' AND NOT EXISTS (SELECT 1 FROM edge e JOIN task p ON p.workflow_id = e.workflow_id
  AND p.task_ord = e.dep_ord WHERE e.workflow_id = t.workflow_id AND e.task_ord = t.task_ord AND p.status <> 'completed')) """


def _offered(s, d):
    """Workers offer what is not returned; a capability per worker."""
    return v.tasks(s, d).where("task_type <> 'R'").select("worker", F.col("task_type").alias("capability"))


@query(_READY + "SELECT namespace, workflow_id, task_id, capability FROM rdy WHERE capability IN (SELECT task_type FROM task WHERE task_type <> 'R')")
def candidates(s, d):
    return schedule.candidates(_ready(s, d), _offered(s, d)).select("namespace", "workflow_id", "task_id", "capability")


_USAGE = """, running AS (SELECT namespace, count(*) AS running FROM wf WHERE status = 'running' GROUP BY 1),
usage AS (SELECT namespace, CASE WHEN namespace = 'MACHINERY' THEN 4 ELSE 1 END AS weight, CASE WHEN namespace = 'BUILDING' THEN 1 ELSE 1000000 END AS max_running, running FROM running) """


def _usage(s, d):
    wf = v.workflows(s, d)
    running = wf.where("status = 'running'").groupBy("namespace").agg(F.count("*").alias("running"))
    config = s.createDataFrame([("MACHINERY", 4, 1_000_000), ("BUILDING", 1, 1), ("AUTOMOBILE", 1, 1_000_000), ("FURNITURE", 1, 1_000_000), ("HOUSEHOLD", 1, 1_000_000)], "namespace string, weight long, max_running long")
    return schedule.configured(running.select("namespace"), config).join(running, "namespace")


@query(_READY + _USAGE + """, able AS (SELECT u.namespace, weight, ascii(u.namespace) + weight AS now, h FROM usage u JOIN (SELECT namespace, min({'w': workflow_id, 't': task_id}) AS h FROM rdy GROUP BY 1) USING (namespace) WHERE running < max_running),
best AS (SELECT arg_max(namespace, now * 1000 - ascii(namespace)) AS chosen, sum(weight) AS every FROM able)
SELECT namespace, CASE WHEN namespace = chosen THEN h.w END AS workflow_id, CASE WHEN namespace = chosen THEN h.t END AS task_id, (now - CASE WHEN namespace = chosen THEN every ELSE 0 END)::BIGINT AS credit FROM able, best""")
def schedule_plan(s, d):
    """One step of the plan, from credits of the namespaces' first letters."""
    usage = _usage(s, d)
    return schedule.planned(_ready(s, d), usage, usage.select("namespace", F.ascii("namespace").cast("long").alias("credit")))


@query("""SELECT namespace, CASE WHEN namespace = 'MACHINERY' THEN 4 ELSE 1 END::BIGINT AS weight, CASE WHEN namespace = 'MACHINERY' THEN 7 ELSE 1000 END::BIGINT AS max_running FROM (SELECT DISTINCT namespace FROM wf)""")
def namespace_config(s, d):
    config = s.createDataFrame([("MACHINERY", 4, 7)], "namespace string, weight long, max_running long")
    return schedule.configured(v.workflows(s, d).select("namespace").distinct(), config)


@query("""SELECT p_partkey AS part, CASE WHEN p_partkey % 7 = 0 THEN 'weight' WHEN p_size % 5 = 0 THEN 'limit' WHEN p_size > 30 THEN 'running_above_tasks' END AS error FROM part""")
def config_errors(s, d):
    p = v.table(s, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    error = schedule.config_error(F.when(F.col("part") % 7 == 0, 0).otherwise(1), F.lit(5), F.when(F.col("size") % 5 == 0, 0).otherwise(30), F.col("size"))
    return p.select("part", error.alias("error"))


@query("""SELECT namespace, workflow_id, rank IS NOT NULL AND rank <= 700 AS admitted FROM (SELECT q.namespace, q.workflow_id, f.rank FROM (SELECT * FROM wf WHERE status = 'scheduled') q LEFT JOIN
(SELECT workflow_id, row_number() OVER (ORDER BY submitted, workflow_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY submitted, workflow_id) AS r FROM wf WHERE status = 'scheduled') WHERE r <= 200) f USING (workflow_id))""")
def running_limits(s, d):
    """Units against a namespace's limit of 200 and one of 700 for all."""
    return schedule.running_admitted(v.workflows(s, d).where("status = 'scheduled'"), 700, 200)


@query("SELECT workflow_id, (count(*) + sum(CASE WHEN task_ord = 1 THEN least(quantity, 3) ELSE 0 END))::BIGINT AS reserved FROM task GROUP BY 1")
def reserved_tasks(s, d):
    items = F.when(F.col("task_ord") == 1, F.least(F.col("quantity"), F.lit(3)))
    return schedule.reserved(v.tasks(s, d).withColumn("max_items", items))


_SIZES = """, q AS MATERIALIZED (SELECT namespace, workflow_id, n, row_number() OVER (ORDER BY submitted, workflow_id) AS r FROM wf JOIN (SELECT workflow_id, (count(*) + sum(CASE WHEN task_ord = 1 THEN least(quantity, 3) ELSE 0 END))::BIGINT AS n FROM task GROUP BY 1)
  USING (workflow_id) WHERE status = 'scheduled'),
g AS (SELECT 0::BIGINT AS r, ''::VARCHAR AS namespace, 0::BIGINT AS workflow_id, 0::BIGINT AS n, false AS admitted, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS f, 0::BIGINT AS h, 0::BIGINT AS m
UNION ALL SELECT r, namespace, workflow_id, n, ok, a + CASE WHEN ok AND namespace = 'AUTOMOBILE' THEN n ELSE 0 END, b + CASE WHEN ok AND namespace = 'BUILDING' THEN n ELSE 0 END, f + CASE WHEN ok AND namespace = 'FURNITURE' THEN n ELSE 0 END,
  h + CASE WHEN ok AND namespace = 'HOUSEHOLD' THEN n ELSE 0 END, m + CASE WHEN ok AND namespace = 'MACHINERY' THEN n ELSE 0 END FROM
  (SELECT q.*, a, b, f, h, m, a + b + f + h + m + q.n <= 2000 AND CASE q.namespace WHEN 'AUTOMOBILE' THEN a WHEN 'BUILDING' THEN b WHEN 'FURNITURE' THEN f WHEN 'HOUSEHOLD' THEN h ELSE m END + q.n <= 500 AS ok FROM g JOIN q ON q.r = g.r + 1)) """


@query(_SIZES + "SELECT namespace, workflow_id, n AS tasks, admitted FROM g WHERE r > 0")
def admission_limits(s, d):
    """Tasks with the items that fan-outs reserve, against 2000 for all and 500 for a namespace."""
    queue = v.workflows(s, d).where("status = 'scheduled'").join(reserved_tasks(s, d), "workflow_id")
    return schedule.admitted_within(queue.withColumnRenamed("reserved", "tasks"), 2000, 500)
