"""Queries that read what a workflow store holds, and check it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import storage as st
from .plans import views as v
from .registry import query

_RECEIPTS = "(SELECT request_id, arg_min(request_hash, pos) AS request_hash, arg_min(workflow_id, pos) AS workflow_id, arg_min(sequence, pos) AS sequence, min(pos) AS pos FROM log GROUP BY 1)"


@query("SELECT workflow_id, pos, kind, at_ms FROM log WHERE sequence = 1")
def first_event(s, d):
    return st.first_events(v.log(s, d))


@query("SELECT sequence, kind, at_ms, request_id FROM log WHERE workflow_id = 7")
def workflow_events(s, d):
    return st.of_workflow(v.log(s, d), 7).select("sequence", "kind", "at_ms", "request_id")


@query("SELECT workflow_id, namespace, status, submitted FROM wf WHERE workflow_id = 42")
def workflow_state(s, d):
    return st.of_workflow(v.workflows(s, d), 42).select("workflow_id", "namespace", "status", "submitted")


@query(f"SELECT * FROM {_RECEIPTS}")
def stored_receipts(s, d):
    return st.receipts(v.log(s, d))


@query(f"""SELECT request_id, a.request_hash, CASE WHEN coalesce(o.request_hash, r.request_hash) IS NULL THEN 'missing' WHEN coalesce(o.request_hash, r.request_hash) <> a.request_hash THEN 'conflict'
WHEN o.request_hash IS NOT NULL THEN 'outcome' ELSE 'receipt' END AS answer, CASE WHEN coalesce(o.request_hash, r.request_hash) = a.request_hash THEN coalesce(o.sequence, r.sequence) END AS sequence
FROM (SELECT DISTINCT request_id, request_hash FROM log) a LEFT JOIN (SELECT * FROM {_RECEIPTS} WHERE pos > 5000) o USING (request_id) LEFT JOIN (SELECT * FROM {_RECEIPTS} WHERE workflow_id % 5 <> 0) r USING (request_id)""")
def outcome_lookup(s, d):
    """Every request asked for: from the outcomes of the log's later part, else from the receipts that are kept."""
    log = v.log(s, d)
    kept = st.receipts(log)
    return st.looked_up(log.select("request_id", "request_hash").distinct(), kept.where("pos > 5000"), kept.where("workflow_id % 5 <> 0"))


_DONE = """(SELECT workflow_id, task_id, task_type, worker, started, CASE WHEN task_type = 'R' THEN 'compensation' ELSE 'normal' END AS phase, task_id || '#1' AS attempt_id FROM task WHERE status = 'completed')"""


def _done(s, d):
    phase = F.when(F.col("task_type") == "R", "compensation").otherwise("normal")
    return v.tasks(s, d).where("status = 'completed'").select("workflow_id", "task_id", "task_type", "worker", "started", phase.alias("phase"), F.concat("task_id", F.lit("#1")).alias("attempt_id"))


@query(f"""SELECT r.workflow_id, task_id, phase, attempt_id, namespace, CASE WHEN phase = 'compensation' THEN 'undo-' || task_type ELSE task_type END AS capability,
row_number() OVER (PARTITION BY r.workflow_id ORDER BY task_id, phase, attempt_id) AS turn FROM {_DONE} r LEFT JOIN wf USING (workflow_id)""")
def results_with_definition(s, d):
    """Finished attempts with phase and capability, in the order of their key within each workflow."""
    made = st.task_results(_done(s, d), v.workflows(s, d).select("workflow_id", "namespace"))
    return st.in_order(made).select("workflow_id", "task_id", "phase", "attempt_id", "namespace", "capability", "turn")


@query(f"SELECT workflow_id, task_id, phase, attempt_id, 2::BIGINT AS n FROM {_DONE} WHERE worker % 50 = 1")
def repeated_results(s, d):
    """Identities that occur twice once the results of some workers are delivered again."""
    done = _done(s, d)
    return st.repeated(done.unionByName(done.where("worker % 50 = 1")), st.IDENTITY)


@query(f"SELECT r.request_id, r.workflow_id, r.sequence FROM {_RECEIPTS} r WHERE workflow_id IN (SELECT workflow_id FROM wf WHERE status NOT IN ('completed', 'failed', 'cancelled', 'compensated'))")
def active_receipts(s, d):
    return st.active_receipts(st.receipts(v.log(s, d)), v.workflows(s, d), v.TERMINAL).select("request_id", "workflow_id", "sequence")


@query("SELECT pos AS applied_index FROM log WHERE pos > 1 AND pos % 97 <> 5 AND (pos - 1) % 97 = 5")
def log_gaps(s, d):
    """Log indices whose predecessor is missing, once one in 97 is taken out."""
    return st.missing_before(v.log(s, d).where("pos % 97 <> 5").select(F.col("pos").alias("applied_index")), "applied_index", 0)


@query(f"""SELECT request_id, request_hash, 'request' AS side FROM {_RECEIPTS} WHERE workflow_id % 7 = 0 AND workflow_id % 11 <> 0 UNION ALL
SELECT request_id, request_hash, 'outcome' FROM {_RECEIPTS} WHERE workflow_id % 11 = 0 AND workflow_id % 7 <> 0""")
def snapshot_mismatches(s, d):
    """Requests without outcomes and outcomes without requests, where each side lacks other workflows."""
    kept = st.receipts(v.log(s, d))
    return st.unmatched(kept.where("workflow_id % 11 <> 0"), kept.where("workflow_id % 7 <> 0"))


@query("SELECT count(*) AS rows, sum(('0x' || substr(sha256(workflow_id || '|' || sequence || '|' || kind || '|' || at_ms), 1, 12))::BIGINT)::VARCHAR AS digest FROM log")
def snapshot_digest(s, d):
    return st.digest(v.log(s, d), F.col("workflow_id"), F.col("sequence"), F.col("kind"), F.col("at_ms"))


@query("""SELECT count(*) FILTER (workflow_id % 100 = 3) AS lost, count(*) FILTER (workflow_id % 100 = 4) AS extra, count(*) FILTER (workflow_id % 100 = 5) AS state_mismatches,
count(*) FILTER (workflow_id % 100 = 6) AS version_mismatches FROM wf""")
def recovery_report(s, d):
    """What a damaged copy of the states lost, made up and changed."""
    states = v.workflows(s, d).select("workflow_id", "status", F.lit(1).alias("version"))
    part = F.col("workflow_id") % 100
    after = states.where(part != 3).withColumn("status", F.when(part == 5, "other").otherwise(F.col("status"))).withColumn("version", F.when(part == 6, 2).otherwise(F.col("version")))
    return st.recovery(states.where(part != 4), after)


@query("SELECT workflow_id, task_id, started + 3600000 AS lease_until FROM task WHERE status = 'pending' AND started + 3600000 <= 896659200000")
def expired_leases(s, d):
    return st.expired_leases(v.tasks(s, d), 896_659_200_000, 3_600_000)


@query("SELECT worker, task_id, row_number() OVER (PARTITION BY worker ORDER BY workflow_id, task_id) AS turn FROM task WHERE status = 'pending' AND quantity > 25")
def redelivery_order(s, d):
    """What each worker's new session is given again: what it held and still has a lease for, in order."""
    held = v.tasks(s, d).select("worker", "task_id", "workflow_id", "status", "quantity")
    left = st.reconciled(held.where("status = 'pending'"), held.where("quantity > 25"))
    turn = F.row_number().over(Window.partitionBy("worker").orderBy("workflow_id", "task_id")).cast("long")
    return left.select("worker", "task_id", turn.alias("turn"))


@query("""SELECT pos // 300 AS batch, count(*) AS n, CASE WHEN count(*) > 256 THEN 'too_large' WHEN count(DISTINCT request_id) < count(*) THEN 'repeated_request' END AS error FROM log WHERE pos // 300 % 3 <> 0 OR pos % 300 < 20 GROUP BY 1""")
def batch_errors(s, d):
    batch = F.floor(F.col("pos") / 300).cast("long")
    return st.batch_errors(v.log(s, d).where((batch % 3 != 0) | (F.col("pos") % 300 < 20)).withColumn("batch", batch))


@query("""SELECT error, CASE error WHEN 'not_leader' THEN 307 WHEN 'no_leader' THEN 503 WHEN 'request_conflict' THEN 409 WHEN 'invalid_command' THEN 400 WHEN 'capacity' THEN 429 ELSE 500 END AS status, count(*) AS n
FROM (SELECT CASE kind WHEN 'click' THEN 'not_leader' WHEN 'view' THEN 'no_leader' WHEN 'purchase' THEN 'request_conflict' WHEN 'signup' THEN 'invalid_command' ELSE 'disk' END AS error FROM log) GROUP BY 1, 2""")
def error_status(s, d):
    error = F.when(F.col("kind") == "click", "not_leader").when(F.col("kind") == "view", "no_leader").when(F.col("kind") == "purchase", "request_conflict").when(F.col("kind") == "signup", "invalid_command").otherwise("disk")
    return v.log(s, d).select(error.alias("error")).groupBy("error").agg(F.count("*").alias("n")).select("error", st.http_status(F.col("error"))[0].alias("status"), "n")


@query("SELECT DISTINCT workflow_id, workflow_id IN (SELECT workflow_id FROM wf WHERE status NOT IN ('completed', 'failed', 'cancelled', 'compensated')) AS active FROM log")
def workflow_ids(s, d):
    """Every workflow of the log once, and whether it is active."""
    active = v.workflows(s, d).where(~F.col("status").isin(*v.TERMINAL)).select("workflow_id", F.lit(True).alias("yes")).distinct()
    return v.log(s, d).select("workflow_id").distinct().join(active, "workflow_id", "left").select("workflow_id", F.coalesce("yes", F.lit(False)).alias("active"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'invalid_json' WHEN event_id % 5 = 1 THEN 'unknown_field' WHEN event_id % 5 = 2 THEN 'no_kind' END AS error FROM events""")
def command_errors(s, d):
    """Texts that are no commands, told apart by a strict reader."""
    from .sources import commands

    k, kind = F.col("event_id") % 5, F.concat(F.lit('{"kind": "'), "event_type", F.lit('"'))
    text = F.when(k == 0, kind).when(k == 1, F.concat(kind, F.lit(', "extra": 1}'))).when(k == 2, F.lit('{"at": 1}')).otherwise(F.concat(kind, F.lit(', "at": 1}')))
    return v.table(s, d, "events").select("event_id", commands.error(text).alias("error"))
