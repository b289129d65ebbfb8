"""Queries of states: canonical forms, fingerprints, flags, clocks, timers, retention, commits, replicas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import history as h
from .operators import metrics as m
from .operators import states as st
from .plans import views as v
from .registry import query

_DEPS = "(SELECT e.workflow_id, e.task_ord, list(p.task_id ORDER BY p.task_id) AS deps FROM edge e JOIN task p ON p.workflow_id = e.workflow_id AND p.task_ord = e.dep_ord GROUP BY 1, 2)"


@query(f"SELECT workflow_id, to_json(list(struct_pack(id := task_id, dependencies := coalesce(deps, []::VARCHAR[])) ORDER BY task_id))::VARCHAR AS definition FROM task LEFT JOIN {_DEPS} USING (workflow_id, task_ord) GROUP BY 1")
def canonical_definitions(s, d):
    t = v.tasks(s, d)
    return st.canonical_tasks(t, v.edges(t))


@query("""SELECT workflow_id, to_json(list(CASE WHEN quantity % 2 = 0 THEN struct_pack(key := worker::VARCHAR || ':' || task_id, payload := [part]) ELSE struct_pack(key := worker::VARCHAR || ':' || task_id, payload := NULL) END
ORDER BY worker::VARCHAR || ':' || task_id))::VARCHAR AS items FROM task GROUP BY 1""")
def canonical_items(s, d):
    """Items in the order of their keys; those with an empty payload have none."""
    payload = F.when(F.col("quantity") % 2 == 0, F.array("part")).otherwise(F.array().cast("array<bigint>"))
    rows = v.tasks(s, d).select("workflow_id", F.struct(F.concat_ws(":", F.col("worker").cast("string"), "task_id").alias("key"), payload.alias("payload")).alias("x"))
    items = rows.groupBy("workflow_id").agg(F.collect_list("x").alias("items"))
    return items.select("workflow_id", F.to_json(st.canonical_items(F.col("items")), {"ignoreNullFields": "false"}).alias("items"))


@query("SELECT workflow_id, sha256(to_json(list(struct_pack(id := task_id, status := status) ORDER BY task_id))::VARCHAR) AS state_hash FROM task GROUP BY 1")
def state_fingerprint(s, d):
    return st.fingerprints(v.tasks(s, d))


#: Tasks in all eight statuses; a third of those that are undone wait for a worker.
_ALL = ["pending", "ready", "running", "completed", "failed", "cancelled", "compensating", "compensated"]
_EIGHT = f"(SELECT workflow_id, task_id, task_type, [{', '.join(repr(x) for x in _ALL)}][quantity % 8 + 1] AS status, CASE WHEN part % 3 > 0 THEN worker END AS worker FROM task)"


def _eight(s, d):
    names = F.array(*map(F.lit, _ALL))
    return v.tasks(s, d).select("workflow_id", "task_id", "task_type", F.get(names, (F.col("quantity") % 8).cast("int")).alias("status"), F.when(F.col("part") % 3 > 0, F.col("worker")).alias("worker"))


@query("SELECT workflow_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{x}') AS n_{x}" for x in _ALL) + f" FROM {_EIGHT} GROUP BY 1")
def summary_by_status(s, d):
    return h.summary(_eight(s, d), _ALL)


@query(f"""SELECT workflow_id, bool_or(status IN ('pending', 'ready', 'running', 'compensating')) AS active, count(*) FILTER (status = 'running' OR status = 'compensating' AND worker IS NOT NULL) AS leased,
count(*) FILTER (status = 'ready' OR status = 'compensating' AND worker IS NULL) AS runnable, count(*) FILTER (status IN ('completed', 'failed', 'cancelled', 'compensated')) AS ended FROM {_EIGHT} GROUP BY 1""")
def workflow_flags(s, d):
    return st.flags(_eight(s, d))


@query(f"SELECT worker, workflow_id, task_id, CASE WHEN status = 'compensating' THEN 'undo-' ELSE '' END || task_type AS capability, status = 'compensating' AS compensation FROM {_EIGHT} WHERE status = 'running' OR status = 'compensating' AND worker IS NOT NULL")
def worker_assignments(s, d):
    return st.assignments(_eight(s, d))


@query("""SELECT pos, CASE pos % 6 WHEN 0 THEN 'fenced' WHEN 1 THEN 'expired' WHEN 2 THEN 'conflict' WHEN 3 THEN 'invalid' WHEN 4 THEN 'invalid' ELSE 'unavailable' END AS code FROM log""")
def session_codes(s, d):
    names = F.array(*map(F.lit, ["fenced", "lease_expired", "request_conflict", "invalid_command", "invalid_transition", "disk"]))
    return v.log(s, d).select("pos", st.session_code(F.get(names, (F.col("pos") % 6).cast("int"))).alias("code"))


@query("""SELECT pos, CASE pos % 5 WHEN 0 THEN 'time_regression' WHEN 1 THEN 'time_overflow' END AS error, CASE WHEN pos % 5 < 2 THEN at_ms ELSE at_ms + pos END AS now FROM log""")
def clock_steps(s, d):
    """A clock at each event's time, moved back, beyond its range, or on."""
    delta = F.when(F.col("pos") % 5 == 0, -1).when(F.col("pos") % 5 == 1, (1 << 63) - 6).otherwise(F.col("pos"))
    error, now = st.advanced(F.col("at_ms"), delta)
    return v.log(s, d).select("pos", error.alias("error"), now.alias("now"))


@query("SELECT workflow_id, sequence, max(CASE WHEN pos % 13 = 7 THEN at_ms - 3600000 ELSE at_ms END) OVER (PARTITION BY workflow_id ORDER BY sequence) AS at_ms FROM log")
def command_times(s, d):
    """Over the log with every 13th clock an hour behind."""
    return st.clamped(v.log(s, d).withColumn("at_ms", F.when(F.col("pos") % 13 == 7, F.col("at_ms") - 3_600_000).otherwise(F.col("at_ms"))))


_TIMERS = "(SELECT workflow_id, started + initial AS deadline, task_id AS timer_id FROM task JOIN policy USING (part))"


def _timers(s, d):
    return v.tasks(s, d).join(v.policies(s, d), "part").select("workflow_id", (F.col("started") + F.col("initial")).alias("deadline"), F.col("task_id").alias("timer_id"))


@query(f"SELECT workflow_id, min({{'d': deadline, 't': timer_id}}).d AS deadline, min({{'d': deadline, 't': timer_id}}).t AS timer_id FROM {_TIMERS} GROUP BY 1")
def next_timer(s, d):
    return st.next_timers(_timers(s, d))


@query(f"SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY deadline, timer_id) AS turn FROM {_TIMERS}")
def workflow_timers(s, d):
    return st.all_timers(_timers(s, d))


@query("""SELECT workflow_id, kept, CASE WHEN kept = 'evicted' THEN 0 ELSE coalesce(n, 0) END::BIGINT AS requests FROM (SELECT workflow_id, CASE WHEN status <> 'completed' THEN 'whole' WHEN workflow_id % 3 = 0 THEN 'compacted' ELSE 'evicted' END AS kept FROM wf)
LEFT JOIN (SELECT workflow_id, count(*) AS n FROM task GROUP BY 1) USING (workflow_id)""")
def retention(s, d):
    """Workflows that have ended are compacted if three divides them, else evicted; each task stands for a request."""
    return st.retained(v.workflows(s, d), v.tasks(s, d), F.col("workflow_id") % 3 == 0)


@query("SELECT pos, pos % 4 > 0 AND pos >= pos // 2 * 2 - pos % 3 AND pos - (pos // 2 * 2 - pos % 3) >= pos % 4 AS due FROM log")
def snapshot_due(s, d):
    last = F.floor(F.col("pos") / 2).cast("long") * 2 - F.col("pos") % 3
    return v.log(s, d).select("pos", st.should_snapshot(F.col("pos"), last, F.col("pos") % 4).alias("due"))


_KEPT = "(SELECT workflow_id, at_ms // 86400000 AS applied_index, min(sequence) AS f, max(sequence) AS l, count(*) AS n FROM log GROUP BY 1, 2 HAVING (workflow_id + applied_index) % 41 <> 5)"


@query(f"SELECT workflow_id, sum(n)::BIGINT AS events, bool_and(l - f + 1 = n AND f = before + 1) AS sound FROM (SELECT *, coalesce(lag(l) OVER (PARTITION BY workflow_id ORDER BY f), 0) AS before FROM {_KEPT}) GROUP BY 1")
def segment_scan(s, d):
    """Every workflow's segments read in order and checked, where one in 41 is lost."""
    return st.verified(h.segments(v.log(s, d)).where((F.col("workflow_id") + F.col("applied_index")) % 41 != 5))


_WEIGHTS = ["", "a=1,b=2", "a=1, a=2", "a", "a=0,b", " a =3,b=x", "b=+2,=1", "a=1,b=2147483648,c"]


@query("SELECT p_partkey AS part, [NULL, NULL, 'duplicate', 'shape', 'weight', 'weight', 'shape', 'shape'][p_partkey % 8 + 1] AS error FROM part")
def weights_errors(s, d):
    """Texts of namespace weights, each refused by its first bad item."""
    text = F.get(F.array(*map(F.lit, _WEIGHTS)), (F.col("p_partkey") % 8).cast("int"))
    return v.table(s, d, "part").select(F.col("p_partkey").alias("part"), st.weights_error(text).alias("error"))


@query("""SELECT pos, CASE WHEN r = 1 THEN 'applied' WHEN request_hash = h THEN 'duplicate' ELSE 'conflict' END AS outcome, CASE WHEN request_hash = h THEN p // 16 END AS index, CASE WHEN request_hash = h THEN p // 1600 END AS term FROM (
SELECT pos, request_hash, row_number() OVER w AS r, first_value(request_hash) OVER w AS h, first_value(pos) OVER w AS p FROM (SELECT pos, request_id, CASE WHEN pos % 9 < 4 THEN request_hash ELSE 'same' END AS request_hash FROM log) WINDOW w AS (PARTITION BY request_id ORDER BY pos))""")
def commit_outcomes(s, d):
    """Entries of 16 commands, terms of 100 entries; most uses of a request have one hash."""
    hash_ = F.when(F.col("pos") % 9 < 4, F.col("request_hash")).otherwise("same")
    part = lambda n: F.floor(F.col("pos") / n).cast("long")
    return st.committed(v.log(s, d).select("pos", "request_id", hash_.alias("request_hash"), part(16).alias("index"), part(1600).alias("term")))


@query("""SELECT count(*) AS received, count(*) FILTER (r = 1) AS accepted, count(*) FILTER (r > 1 AND request_hash = h) AS duplicates, count(*) FILTER (request_hash <> h) AS conflicts FROM (
SELECT request_hash, row_number() OVER w AS r, first_value(request_hash) OVER w AS h FROM (SELECT pos, request_id, CASE WHEN pos % 9 < 4 THEN request_hash ELSE 'same' END AS request_hash FROM log) WINDOW w AS (PARTITION BY request_id ORDER BY pos))""")
def engine_counters(s, d):
    hash_ = F.when(F.col("pos") % 9 < 4, F.col("request_hash")).otherwise("same")
    return st.counters(v.log(s, d).withColumn("request_hash", hash_))


@query("""SELECT pos, kind, 'second' AS side FROM log WHERE pos % 50 = 1 UNION ALL SELECT pos, kind, 'first' FROM log WHERE pos % 70 = 2 UNION ALL SELECT pos, kind, 'first' FROM log WHERE pos % 90 = 3 AND pos % 50 <> 1""")
def replica_difference(s, d):
    """One replica lacks some events and has some twice, the other lacks others."""
    rows = v.log(s, d).select("pos", "kind")
    one = rows.where("pos % 50 <> 1").unionByName(rows.where("pos % 70 = 2"))
    return st.difference(one, rows.where("pos % 90 <> 3"))


_SNAPSHOT = [0.001 * 4**k for k in range(10)]


@query(f"SELECT kind, le, count(*) FILTER (value <= le) AS n FROM log CROSS JOIN (SELECT unnest([{', '.join(f'{b!r}::DOUBLE' for b in _SNAPSHOT)}, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2")
def snapshot_seconds(s, d):
    """Seconds of snapshots by kind, in the buckets of snapshots."""
    return m.histogram(v.log(s, d), "value", _SNAPSHOT, "kind")


@query("SELECT workflow_id, task_id, row_number() OVER (PARTITION BY workflow_id ORDER BY task_id) AS turn FROM task")
def task_order(s, d):
    """Tasks in the order of their ids, the one in which rules look at them."""
    return v.tasks(s, d).select("workflow_id", "task_id", F.row_number().over(Window.partitionBy("workflow_id").orderBy("task_id")).cast("long").alias("turn"))


@query("SELECT event_id, event_type IN ('click', 'purchase') AND event_id % 2 = 0 OR event_type = 'view' AS allowed FROM events")
def allowed_kinds(s, d):
    """Which commands a caller may send: submissions always, starts and completions only where workers are local."""
    kind = F.when(F.col("event_type") == "view", "submit_workflow").when(F.col("event_type") == "click", "start_task").when(F.col("event_type") == "purchase", "complete_task").otherwise("cancel_workflow")
    local = F.col("event_id") % 2 == 0
    return v.table(s, d, "events").select("event_id", st.allowed(kind, local).alias("allowed"))
