"""Queries of what goes in and out: submissions, ticks, dispatch, event texts, metric lines, snapshots, streamed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import identity as ids
from .operators import flow
from .plans import views as v
from .registry import query


@query("SELECT o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'own-' || o_orderkey ELSE " + ids.identity_sql("workflow", "o_orderpriority", "'req-' || o_orderkey") + " END AS workflow_id FROM orders")
def submitted_workflows(s, d):
    """Submissions, of which one in three names its workflow and one in three a blank."""
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("own-"), key.cast("string"))).when(key % 3 == 1, " ")
    rows = v.table(s, d, "orders").select(key.alias("number"), F.col("o_orderpriority").alias("namespace"), F.concat(F.lit("req-"), key.cast("string")).alias("request_id"), name.alias("workflow_id"))
    return flow.named(rows).select("number", "workflow_id")


_NOW = 872_000_000_000


@query(f"""SELECT 'fire_timer' AS kind, workflow_id, timer_id AS id, greatest({_NOW}, submitted, deadline) AS at_ms FROM (SELECT t.workflow_id, task_id AS timer_id, started + initial AS deadline, submitted FROM task t JOIN policy USING (part) JOIN wf USING (workflow_id)
WHERE t.status = 'pending' AND started + initial <= {_NOW} ORDER BY 3, 1, 2 LIMIT 256) UNION ALL SELECT 'expire_lease', t.workflow_id, task_id, greatest({_NOW}, submitted, started + 3600000) FROM task t JOIN wf USING (workflow_id) WHERE t.status = 'pending' AND started + 3600000 <= {_NOW}""")
def tick_commands(s, d):
    """The commands of a tick: at most 256 timers, and all leases that have ended."""
    open_ = v.tasks(s, d).where("status = 'pending'").join(v.workflows(s, d).select("workflow_id", F.col("submitted").alias("updated_at")), "workflow_id")
    timers = open_.join(v.policies(s, d), "part").select("workflow_id", F.col("task_id").alias("timer_id"), (F.col("started") + F.col("initial")).alias("deadline"), "updated_at")
    return flow.tick(timers, open_.select("workflow_id", "task_id", (F.col("started") + 3_600_000).alias("lease_until"), "updated_at"), _NOW)


@query("""SELECT worker, workflow_id, task_id FROM (SELECT worker, workflow_id, task_id, row_number() OVER (PARTITION BY worker ORDER BY workflow_id, task_id) AS turn FROM task WHERE status = 'pending')
JOIN (SELECT worker, greatest(320 - count(*) FILTER (status = 'completed'), 0) AS free FROM task GROUP BY 1) USING (worker) WHERE turn <= free""")
def credit_dispatch(s, d):
    """What workers with 320 credits are sent while their finished tasks still hold some."""
    t = v.tasks(s, d)
    workers = t.groupBy("worker").agg(F.lit(320).alias("credits"), F.count_if(F.col("status") == "completed").alias("inflight"))
    return flow.dispatched(t.where("status = 'pending'").select("worker", "workflow_id", "task_id"), workers)


@query("SELECT workflow_id, arg_max(kind, sequence) AS kind, max(sequence) AS version FROM log WHERE pos <= 5000 GROUP BY 1")
def state_as_of(s, d):
    return flow.as_of(v.log(s, d), 5000)


_DATA = """'{"at":' || at_ms || ',"kind":"' || kind || '"}'"""


@query(f"SELECT pos, 'id: ' || sequence || chr(10) || 'event: ' || kind || chr(10) || 'data: ' || {_DATA} || chr(10) || chr(10) AS text FROM log")
def event_texts(s, d):
    return v.log(s, d).select("pos", flow.event_text(F.col("sequence"), F.col("kind"), F.to_json(F.struct(F.col("at_ms").alias("at"), "kind"))).alias("text"))


@query(f"SELECT pos, sequence, kind, {_DATA} AS data FROM log WHERE sequence > 3")
def event_texts_read(s, d):
    """Event texts read again by a client that has the first three of each workflow."""
    sequence, kind, data = flow.parsed_events(F.col("text"))
    return event_texts(s, d).select("pos", sequence.alias("sequence"), kind.alias("kind"), data.alias("data")).where("sequence > 3")


@query("""SELECT 'transitions_total{kind="' || kind || '"} ' || count(*) AS line FROM log GROUP BY kind""")
def metric_lines(s, d):
    return flow.exposition(v.log(s, d).groupBy("kind").agg(F.count("*").alias("n")), "transitions_total", "kind")


@query("""SELECT pos // 300 AS entry, count(*) AS commands, CASE WHEN count(*) > 256 THEN 'commands' WHEN sum(CASE WHEN pos // 300 % 4 = 1 THEN 10000 ELSE 1 END) > 1048576 THEN 'events' WHEN sum(CASE WHEN pos // 300 % 4 = 2 THEN 1000000 ELSE 9 END) > 67108864 THEN 'bytes' END AS error
FROM log WHERE pos // 300 % 4 = 0 OR pos % 300 < 200 GROUP BY 1""")
def entry_errors(s, d):
    """Entries that hold too many commands, events or bytes."""
    entry = F.floor(F.col("pos") / 300).cast("long")
    rows = v.log(s, d).where((entry % 4 == 0) | (F.col("pos") % 300 < 200)).select(entry.alias("entry"))
    return flow.entry_errors(rows.withColumn("events", F.when(F.col("entry") % 4 == 1, 10_000).otherwise(1)).withColumn("bytes", F.when(F.col("entry") % 4 == 2, 1_000_000).otherwise(9)))


@query("SELECT DISTINCT request_id FROM log WHERE request_id NOT IN (SELECT request_id FROM log WHERE workflow_id % 2 = 0)")
def unknown_requests(s, d):
    log = v.log(s, d)
    return flow.unknown(log.select("request_id").distinct(), log.where("workflow_id % 2 = 0").select("request_id"))


@query("""SELECT count(*) AS rows, sum(('0x' || substr(sha256(namespace || '|' || status || '|' || submitted || '|' || workflow_id), 1, 12))::BIGINT)::VARCHAR AS digest, true AS same, (SELECT count(*) FROM log WHERE pos > 5000) AS beyond FROM wf""")
def snapshot_written(s, d):
    """The states as a snapshot on disk, and what of the log it does not cover."""
    return flow.snapshot(s, v.workflows(s, d).drop("price"), v.log(s, d), 5000)


@query("SELECT event_type AS kind, epoch_us(date_trunc('hour', ts)) // 1000 AS start_ms, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    """Events by kind and hour, counted by a stream over the files of the table; the table is one batch, so none is late."""
    from .streaming import windows

    events = v.table(s, d, "events")
    # a pattern, as a stream takes a plain path for a folder
    return windows.run(s, f"{d}/events.parquet*", events.schema).select("kind", F.unix_millis("start").alias("start_ms"), "n")
