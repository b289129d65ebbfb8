"""The registered queries over workflow logs, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import catalog_flow, catalog_machine, catalog_metrics, catalog_reads, catalog_scheduling, catalog_states  # noqa: F401 - they register their queries
from .functions import identity as ids
from .operators import history as h
from .operators import schedule
from .plans import views as v
from .registry import ORACLES, QUERIES, query  # noqa: F401

def _graph(s, d):
    t = v.tasks(s, d)
    return t, v.edges(t)


_REMAINING = """, rem AS (SELECT t.workflow_id, t.task_ord, t.task_id, t.status, (SELECT count(*) FROM edge e JOIN task p ON p.workflow_id = e.workflow_id AND p.task_ord = e.dep_ord
  WHERE e.workflow_id = t.workflow_id AND e.task_ord = t.task_ord AND p.status <> 'completed') AS remaining FROM task t) """


@query(_REMAINING + "SELECT workflow_id, task_id, remaining FROM rem WHERE status = 'pending' AND remaining = 0")
def ready_tasks(s, d):
    return h.ready_tasks(*_graph(s, d))


@query(_REMAINING + "SELECT workflow_id, task_id, remaining FROM rem")
def remaining_dependencies(s, d):
    return h.remaining_dependencies(*_graph(s, d)).select("workflow_id", "task_id", "remaining")


@query("""SELECT t.workflow_id, t.task_id, p.task_id AS dep_id, CASE WHEN p.status = 'completed' THEN p.part END AS output
FROM edge e JOIN task t USING (workflow_id, task_ord) JOIN task p ON p.workflow_id = e.workflow_id AND p.task_ord = e.dep_ord""")
def task_inputs(s, d):
    return h.task_inputs(*_graph(s, d))


@query("SELECT workflow_id, count(*) AS total, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'pending') AS n_pending FROM task GROUP BY workflow_id")
def workflow_summary(s, d):
    return h.summary(v.tasks(s, d), ["completed", "pending"])


@query("""SELECT namespace, count(*) AS workflows, sum(coalesce(o, 0))::BIGINT AS tasks, count(*) FILTER (status = 'running') AS running
FROM wf LEFT JOIN (SELECT workflow_id, count(*) FILTER (status <> 'completed') AS o FROM task GROUP BY 1) USING (workflow_id)
WHERE status NOT IN ('completed', 'failed', 'cancelled', 'compensated') GROUP BY ROLLUP (namespace)""")
def namespace_usage(s, d):
    return h.namespace_usage(v.workflows(s, d), v.tasks(s, d))


@query("SELECT task_id, worker, started FROM task WHERE status = 'pending' AND task_type = 'R'")
def active_attempts(s, d):
    return v.tasks(s, d).where("status = 'pending' and task_type = 'R'").select("task_id", "worker", "started")


@query("SELECT pos, workflow_id, sequence FROM log")
def event_sequence(s, d):
    return v.log(s, d).select("pos", "workflow_id", "sequence")


_HOLED = "(SELECT * FROM log WHERE pos % 97 <> 5)"


@query(f"SELECT workflow_id, pos, sequence, expected FROM (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY workflow_id ORDER BY pos), 0) + 1 AS expected FROM {_HOLED}) WHERE sequence <> expected")
def sequence_gaps(s, d):
    """Over the log with every 97th event taken out: the gaps are the feature."""
    return h.gaps(v.log(s, d).where("pos % 97 <> 5"))


@query("""SELECT workflow_id, sequence, at_ms, updated_at FROM (SELECT workflow_id, sequence, at_ms, lag(at_ms) OVER (PARTITION BY workflow_id ORDER BY sequence) AS updated_at
FROM (SELECT workflow_id, sequence, CASE WHEN pos % 13 = 7 THEN at_ms - 3600000 ELSE at_ms END AS at_ms FROM log)) WHERE at_ms < updated_at""")
def time_regressions(s, d):
    """Over the log with every 13th clock an hour behind."""
    return h.regressions(v.log(s, d).withColumn("at_ms", F.when(F.col("pos") % 13 == 7, F.col("at_ms") - 3_600_000).otherwise(F.col("at_ms"))))


@query("""SELECT request_id, pos, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN request_hash = first_value(request_hash) OVER w THEN 'duplicate' ELSE 'conflict' END AS outcome,
first_value(pos) OVER w AS origin_pos FROM log WINDOW w AS (PARTITION BY request_id ORDER BY pos)""")
def request_outcomes(s, d):
    return h.request_outcomes(v.log(s, d))


@query("SELECT workflow_id, arg_max(kind, sequence) AS kind, arg_max(at_ms, sequence) AS updated_at, arg_max(request_id, sequence) AS request_id, max(sequence) AS version FROM log GROUP BY workflow_id")
def current_state(s, d):
    return h.current_state(v.log(s, d))


@query("SELECT kind, count(*) AS n FROM log GROUP BY kind")
def transitions_by_kind(s, d):
    return v.log(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT workflow_id, sequence, kind, at_ms FROM (SELECT *, min(CASE WHEN kind = 'error' THEN sequence END) OVER (PARTITION BY workflow_id) AS e FROM log) WHERE sequence > 2 AND (e IS NULL OR sequence <= e)""")
def event_tail(s, d):
    return h.tail(v.log(s, d), 2, ["error"])


@query("SELECT workflow_id, sequence, row_number() OVER (PARTITION BY workflow_id ORDER BY sequence) AS attempt, row_number() OVER (PARTITION BY workflow_id ORDER BY sequence) AS fence FROM log WHERE kind = 'click'")
def attempt_fence(s, d):
    return h.attempts(v.log(s, d), "click")


@query(", grow AS (SELECT part, 0 AS count, initial AS delay, multiplier, cap, max_attempts FROM policy UNION ALL SELECT part, count + 1, delay * multiplier, multiplier, cap, max_attempts FROM grow WHERE count + 1 < max_attempts) "
       "SELECT part, count::BIGINT AS count, CASE WHEN cap > 0 THEN least(delay, cap) ELSE delay END AS delay FROM grow")
def retry_delay(s, d):
    p = v.policies(s, d).withColumn("count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_attempts").cast("long") - 1)))
    return p.select("part", "count", ids.retry_delay(F.col("initial"), F.col("multiplier"), F.col("cap"), F.col("count")).alias("delay"))


@query("""SELECT workflow_id, sequence, CASE WHEN used IS NULL OR used = 'purchase' THEN 'fenced' WHEN at_ms >= begun + 7200000 THEN 'expired' ELSE 'accepted' END AS outcome FROM (
SELECT *, last_value(CASE WHEN kind = 'click' THEN at_ms END IGNORE NULLS) OVER w AS begun, last_value(CASE WHEN kind IN ('click', 'purchase') THEN kind END IGNORE NULLS) OVER w AS used FROM log
WINDOW w AS (PARTITION BY workflow_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE kind = 'purchase'""")
def lease_outcome(s, d):
    return h.lease_outcomes(v.log(s, d), "click", "purchase", 7_200_000)


@query("""SELECT task_id, least(lease, deadline) AS lease_until, deadline, CASE WHEN deadline <= least(lease, deadline) THEN 'timeout' ELSE 'expiry' END AS winner FROM (
SELECT task_id, started + initial * 10 AS lease, started + CASE WHEN cap > 0 THEN cap ELSE initial * 10 END AS deadline FROM task JOIN policy USING (part))""")
def timeout_vs_expiry(s, d):
    return h.timeout_or_expiry(v.tasks(s, d), v.policies(s, d))


@query("SELECT started + initial AS deadline, workflow_id, task_id AS timer_id FROM task JOIN policy USING (part) WHERE status = 'pending' ORDER BY 1, 2, 3 LIMIT 256")
def due_timers_topk(s, d):
    return h.due_timers(v.tasks(s, d), v.policies(s, d))


@query("SELECT workflow_id, task_id, row_number() OVER (PARTITION BY workflow_id ORDER BY started DESC, task_id DESC) AS turn FROM task WHERE status = 'completed'")
def compensation_order(s, d):
    return h.compensation_order(v.tasks(s, d))


def _fan(s, d):
    t = v.tasks(s, d)
    items = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("quantity"), F.lit(3).cast("long"))))
    return t.where("task_ord = 1").select("workflow_id", "task_id", items.alias("item")).withColumn("key", F.concat(F.lit("item-"), F.col("item").cast("string")))


@query("""SELECT workflow_id, task_id, 'item-' || i AS key, """ + ids.identity_sql("fanout_task", "workflow_id::VARCHAR", "task_id", "'item-' || i") + """ AS child_id
FROM (SELECT workflow_id, task_id, unnest(range(1, least(quantity, 3) + 1)) AS i FROM task WHERE task_ord = 1)""")
def fanout_expand(s, d):
    return _fan(s, d).select("workflow_id", "task_id", "key", ids.identity("fanout_task", F.col("workflow_id"), F.col("task_id"), F.col("key")).alias("child_id"))


@query("""SELECT t.workflow_id, t.task_id, n AS dependencies, n = done AS ready FROM (SELECT workflow_id, max(task_ord) AS last FROM task GROUP BY 1) m JOIN task t ON t.workflow_id = m.workflow_id AND t.task_ord = last
JOIN (SELECT workflow_id, count(*) + max(CASE WHEN task_ord = 1 THEN least(quantity, 3) END) AS n, count(*) FILTER (status = 'completed') + max(CASE WHEN task_ord = 1 THEN least(quantity, 3) END) AS done FROM task GROUP BY 1) c ON c.workflow_id = t.workflow_id""")
def aggregate_ready(s, d):
    """The last task of a workflow gathers its tasks and the (finished) children of the first: children are united with the edges."""
    t = v.tasks(s, d)
    last = t.groupBy("workflow_id").agg(F.max_by("task_id", "task_ord").alias("task_id"))
    deps = t.select("workflow_id", "status").unionByName(_fan(s, d).select("workflow_id", F.lit("completed").alias("status")))
    found = deps.groupBy("workflow_id").agg(F.count("*").alias("dependencies"), F.bool_and(F.col("status") == "completed").alias("ready"))
    return last.join(found, "workflow_id").select("workflow_id", "task_id", "dependencies", "ready")


@query("""SELECT workflow_id, sequence, kind AS event_kind, CASE kind WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'started' END AS status, at_ms, pos AS applied_index FROM log WHERE kind IN ('purchase', 'error', 'click')""")
def task_results(s, d):
    status = h.chosen([(F.col("kind") == "purchase", "completed"), (F.col("kind") == "error", "failed")], "started")
    return v.log(s, d).where(F.col("kind").isin("purchase", "error", "click")).select("workflow_id", "sequence", F.col("kind").alias("event_kind"), status.alias("status"), "at_ms", F.col("pos").alias("applied_index"))


_SEGMENTS = "SELECT workflow_id, at_ms // 86400000 AS applied_index, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS events FROM log GROUP BY 1, 2"


@query(f"SELECT *, last_sequence - first_sequence + 1 = events AS contiguous FROM ({_SEGMENTS})")
def event_segments(s, d):
    return h.segments(v.log(s, d))


@query(f"SELECT workflow_id, applied_index, first_sequence, last_sequence FROM ({_SEGMENTS})")
def receipt_ranges(s, d):
    return h.segments(v.log(s, d)).select("workflow_id", "applied_index", "first_sequence", "last_sequence")


@query(f"SELECT r.workflow_id, applied_index, sequence, kind FROM ({_SEGMENTS}) r JOIN log l ON l.workflow_id = r.workflow_id AND l.sequence BETWEEN first_sequence AND last_sequence")
def receipt_expand(s, d):
    return h.expanded_receipts(v.log(s, d))


_DURATION = """(SELECT l.workflow_id, (min(at_ms) - any_value(b)) / 1000.0 AS seconds FROM log l JOIN (SELECT workflow_id, min(at_ms) AS b FROM log WHERE kind = 'signup' GROUP BY 1) s ON s.workflow_id = l.workflow_id WHERE kind = 'purchase' AND at_ms >= b GROUP BY 1)"""
_BOUNDS = [0.001 * 4**k for k in range(12)] + [1e5, 1e6, 1e7]


@query(f"SELECT workflow_id, seconds::DOUBLE AS seconds FROM {_DURATION}")
def workflow_duration(s, d):
    return h.durations(v.log(s, d), "signup", "purchase").select("workflow_id", F.col("seconds").cast("double").alias("seconds"))


@query(f"SELECT le, (SELECT count(*) FROM {_DURATION} WHERE seconds <= le) AS n FROM (SELECT unnest([{', '.join(f'{b!r}::DOUBLE' for b in _BOUNDS)}]) AS le)")
def duration_histogram(s, d):
    return h.histogram(h.durations(v.log(s, d), "signup", "purchase"), "seconds", _BOUNDS)


@query("SELECT worker, 64::BIGINT AS credits, count(*) FILTER (status = 'pending') AS inflight, count(*) FILTER (status = 'pending') / 64.0::DOUBLE AS ratio FROM task GROUP BY worker")
def worker_utilization(s, d):
    return h.utilisation(v.tasks(s, d), 64)


@query("SELECT kind, at_ms // 300000 * 300000 AS bucket, count(*) AS n, round(count(*) / 300.0, 6)::DOUBLE AS rate FROM log GROUP BY 1, 2")
def rate_5m(s, d):
    start = F.floor(F.col("at_ms") / 300_000).cast("long") * 300_000
    return v.log(s, d).groupBy("kind", start.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.count("*") / 300.0, 6).cast("double").alias("rate"))


@query("SELECT at_ms // 3600000 * 3600000 AS bucket, count(*) AS increase FROM log WHERE kind = 'error' GROUP BY 1")
def increase_1h(s, d):
    return v.log(s, d).where("kind = 'error'").groupBy((F.floor(F.col("at_ms") / 3_600_000).cast("long") * 3_600_000).alias("bucket")).agg(F.count("*").alias("increase"))


@query("SELECT kind, round(quantile_cont(value, 0.95), 6) AS p95 FROM log GROUP BY kind")
def latency_p95(s, d):
    return v.log(s, d).groupBy("kind").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("SELECT workflow_id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY submitted, workflow_id) <= 500 AS admitted FROM wf WHERE status <> 'completed'")
def admission_unit(s, d):
    """Units of equal size: a prefix of each namespace's queue fits its limit."""
    turn = F.row_number().over(Window.partitionBy("namespace").orderBy("submitted", "workflow_id"))
    return v.workflows(s, d).where("status <> 'completed'").select("workflow_id", "namespace", (turn <= 500).alias("admitted"))


_QUEUE = """, q AS (SELECT namespace, workflow_id, n, row_number() OVER (PARTITION BY namespace ORDER BY submitted, workflow_id) AS r FROM wf JOIN (SELECT workflow_id, count(*) AS n FROM task GROUP BY 1) USING (workflow_id) WHERE status = 'scheduled'),
g AS (SELECT namespace, workflow_id, n, r, n <= 1000 AS admitted, CASE WHEN n <= 1000 THEN n ELSE 0 END AS used FROM q WHERE r = 1
UNION ALL SELECT q.namespace, q.workflow_id, q.n, q.r, g.used + q.n <= 1000, CASE WHEN g.used + q.n <= 1000 THEN g.used + q.n ELSE g.used END FROM g JOIN q ON q.namespace = g.namespace AND q.r = g.r + 1) """


@query(_QUEUE + "SELECT namespace, workflow_id, n AS tasks, admitted FROM g")
def admission_greedy(s, d):
    """A workflow that does not fit takes nothing, and later smaller ones still may fit."""
    size = v.tasks(s, d).groupBy("workflow_id").agg(F.count("*").alias("tasks"))
    return schedule.admitted(v.workflows(s, d).where("status = 'scheduled'").join(size, "workflow_id"), 1000)


@query(""", ns AS (SELECT list(namespace ORDER BY namespace) AS names FROM (SELECT DISTINCT namespace FROM wf)),
w AS (SELECT names, list_transform(names, lambda x, i: (2 ** (i - 1))::BIGINT) AS ws FROM ns),
turn AS (SELECT 0::BIGINT AS pick_no, list_transform(ws, lambda x: 0::BIGINT) AS cur, 0::BIGINT AS best FROM w
UNION ALL SELECT pick_no + 1, list_transform(grown, lambda c, i: CASE WHEN i = list_position(grown, list_max(grown)) THEN c - list_sum(ws)::BIGINT ELSE c END), list_position(grown, list_max(grown))::BIGINT
FROM (SELECT pick_no, ws, list_transform(cur, lambda c, i: c + ws[i]) AS grown FROM turn, w WHERE pick_no < 310))
SELECT pick_no, names[best] AS namespace FROM turn, w WHERE pick_no > 0""")
def fair_schedule(s, d):
    """Ten rounds of smooth weighted picks over the namespaces with weights 1, 2, 4 and so on by name."""
    names = v.workflows(s, d).select("namespace").distinct().withColumn("weight", F.pow(F.lit(2), F.row_number().over(Window.orderBy("namespace")) - 1).cast("long"))
    return schedule.fair(names, 310)


@query("SELECT task_id, " + ", ".join(f"{ids.identity_sql(k, 'workflow_id::VARCHAR', 'task_id', 'task_ord::VARCHAR')} AS {k}_id" for k in ids.PREFIXES) + " FROM task")
def deterministic_ids(s, d):
    parts = [F.col("workflow_id"), F.col("task_id"), F.col("task_ord")]
    return v.tasks(s, d).select("task_id", *[ids.identity(k, *parts).alias(f"{k}_id") for k in ids.PREFIXES])


@query(""", depth AS (SELECT workflow_id, task_ord, 0::BIGINT AS d FROM task WHERE task_ord = 1 UNION ALL SELECT e.workflow_id, e.task_ord, d + 1 FROM depth JOIN edge e ON e.workflow_id = depth.workflow_id AND e.dep_ord = depth.task_ord),
longest AS (SELECT workflow_id, task_ord, max(d) AS depth FROM depth GROUP BY 1, 2)
SELECT workflow_id, task_id, depth, row_number() OVER (PARTITION BY workflow_id ORDER BY depth, task_id) AS turn FROM longest JOIN task USING (workflow_id, task_ord)""")
def toposort(s, d):
    return h.topological(*_graph(s, d))


@query("""SELECT kind, (n * per)::BIGINT AS n FROM (SELECT count(*) AS n FROM supplier) CROSS JOIN (SELECT unnest(['workflow_submitted', 'task_ready', 'task_started', 'task_completed', 'workflow_completed']) AS kind, unnest([1, 8, 8, 8, 1]) AS per)""")
def bench_diamond(s, d):
    """One bench workflow per supplier, folded command by command."""
    from .operators import workload

    n = v.table(s, d, "supplier").count()
    return workload.folded(s, n).groupBy("kind").agg(F.count("*").alias("n"))


#: The events of the release trace: of each workflow, in order, kind and time.
_TRACE = {
    "release": """workflow_submitted@5 timer_scheduled@5 timer_fired@10 workflow_started@10 task_ready@10 task_started@10 task_lease_renewed@20 task_lease_expired@220 task_started@220
        task_completed@221 task_ready@221 task_started@221 task_completed@222 fanout_expanded@222 task_ready@222 task_ready@222 task_started@222 task_completed@223 task_started@223 task_completed@224
        task_ready@224 task_started@224 task_completed@225 task_ready@225 task_started@225 timer_scheduled@225 task_failed@225 timer_cancelled@225 timer_scheduled@225 task_retry_scheduled@225
        timer_fired@235 task_ready@235 task_started@235 timer_scheduled@235 timer_fired@285 task_timed_out@285 timer_scheduled@285 task_retry_scheduled@285 timer_fired@300 task_ready@300
        task_started@300 timer_scheduled@300 task_failed@300 timer_cancelled@300 workflow_compensating@300 task_started@300 task_compensated@301 workflow_compensating@301 task_started@301
        task_compensated@302 workflow_compensating@302 task_started@302 task_compensated@303 workflow_compensated@303""",
    "completed": "workflow_submitted@0 task_ready@0 task_ready@0 task_started@0 task_completed@1 task_started@1 task_completed@2 task_ready@2 task_started@2 task_completed@3 workflow_completed@3",
    "failed": "workflow_submitted@0 task_ready@0 task_started@0 task_failed@0 task_cancelled@0 workflow_failed@0",
    "cancelled": "workflow_submitted@0 timer_scheduled@0 workflow_cancellation_requested@0 task_cancelled@0 timer_cancelled@0 workflow_cancelled@0",
    "undone": """workflow_submitted@0 task_ready@0 task_started@0 task_completed@1 task_ready@1 task_started@1 workflow_cancellation_requested@1 task_cancelled@1 workflow_compensating@1
        task_started@1 task_compensated@2 workflow_compensated@2""",
}
_TRACE_ROWS = ", ".join(f"('{w}', {k}::BIGINT, '{e.split('@')[0]}', {e.split('@')[1]}::BIGINT)" for w, events in _TRACE.items() for k, e in enumerate(events.split(), 1))


@query(f"SELECT * FROM (VALUES {_TRACE_ROWS}) AS t(workflow_id, sequence, kind, at_ms)")
def fold_release_trace(s, d):
    """The release trace through the reducer: retries, timeouts, leases, timers, fan-out, cancellation and rollback, all kinds of events."""
    from .operators import workload

    return workload.trace(s).select("workflow_id", "sequence", "kind", F.col("at").alias("at_ms"))


@query("""SELECT n_nationkey::VARCHAR AS workflow_id, position::BIGINT AS position, outcome, events::BIGINT AS events, low::BIGINT AS first_sequence, high::BIGINT AS last_sequence FROM nation CROSS JOIN (VALUES
(0, 'accepted', 3, 1, 3), (1, 'duplicate', 0, 1, 3), (2, 'request_conflict', 0, NULL, NULL), (3, 'invalid_command', 0, NULL, NULL), (4, 'invalid_command', 0, NULL, NULL), (5, 'invalid_command', 0, NULL, NULL),
(6, 'invalid_transition', 0, NULL, NULL), (7, 'accepted', 1, 4, 4), (8, 'fenced', 0, NULL, NULL), (9, 'accepted', 1, 5, 5), (10, 'accepted', 1, 6, 6), (11, 'time_regression', 0, NULL, NULL),
(12, 'accepted', 2, 7, 8), (13, 'accepted', 1, 9, 9), (14, 'invalid_command', 0, NULL, NULL), (15, 'lease_expired', 0, NULL, NULL), (16, 'accepted', 1, 10, 10), (17, 'accepted', 1, 11, 11),
(18, 'accepted', 2, 12, 13), (19, 'invalid_transition', 0, NULL, NULL), (20, 'duplicate', 0, 5, 5), (21, 'workflow_exists', 0, NULL, NULL), (22, 'invalid_command', 0, NULL, NULL)) AS t(position, outcome, events, low, high)""")
def command_outcomes(s, d):
    """What becomes of repeated, conflicting, malformed, fenced, late and early commands, in a workflow per nation."""
    from .operators import workload

    numbers = v.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return workload.outcomes(workload.made(numbers, workload.disputed))

@query("SELECT '' AS workflow_id, 0::BIGINT AS sequence, '' AS kind, '' AS task_id, 0::BIGINT AS at_ms, '' AS request_id, '' AS event FROM region WHERE false")
def stream_equals_batch(s, d):
    """What a streamed fold of a bench workflow per supplier has more or less than the batch fold; no rows are right."""
    from .streaming import fold as streaming

    return streaming.difference(s, v.table(s, d, "supplier").count()).withColumnRenamed("at", "at_ms")


@query("""SELECT * FROM (VALUES ('good', NULL), ('blank_name', 'blank_name'), ('no_tasks', 'no_tasks'), ('repeated_task_id', 'repeated_task_id'), ('unknown_dependency', 'unknown_dependency'),
('self_dependency', 'self_dependency'), ('cycle', 'cycle'), ('max_attempts', 'max_attempts'), ('fanout_aggregate', 'fanout_aggregate')) AS t(name, error)""")
def validate_definitions(s, d):
    """The first error of each of a set of workflow definitions."""
    from .operators import workload

    return workload.validated(s)
