"""The workflow machine and catalogue: goldens, an independent model, replay, and oracles in DuckDB."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftlog import catalog
from weftlog.functions import identity as ids
from weftlog.operators import reducer, schedule, workload

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {
    "workflow_submitted", "task_ready", "task_started", "task_completed", "task_failed", "task_lease_renewed", "task_lease_expired", "workflow_completed", "workflow_failed", "timer_scheduled", "timer_fired",
    "timer_cancelled", "workflow_started", "fanout_expanded", "task_retry_scheduled", "task_timed_out", "task_cancelled", "workflow_cancellation_requested", "workflow_compensating", "task_compensated", "workflow_cancelled", "workflow_compensated",
}


def cell(x):
    if x is None or x != x:
        return ""
    if isinstance(x, str):
        return x
    return repr(round(float(x), 6))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, small)
    cols = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in found.select(cols).collect()]
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in want)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_identity_golden(spark):
    want = "wf_044a741fd3b7366e5f3c585d"
    assert reducer.identity("workflow", "test", "request") == want
    row = spark.range(1).select(ids.identity("workflow", F.lit("test"), F.lit("request")).alias("a"), ids.identity("attempt", F.lit("ü"), F.lit(3)).alias("b")).first()
    assert row["a"] == want and row["b"] == reducer.identity("attempt", "ü", 3)


def test_delay_is_the_same_in_both_forms(spark):
    cases = [(10, 2, 15, 0), (10, 2, 15, 1), (10, 2, 0, 5), (7, 10, 0, 60), (0, 3, 0, 4), (5, 1, 0, 9)]
    df = spark.createDataFrame(cases, "initial long, multiplier long, cap long, n long")
    got = [r[0] for r in df.select(ids.retry_delay(F.col("initial"), F.col("multiplier"), F.col("cap"), F.col("n"))).collect()]
    assert got == [reducer.delay({"initial": a, "multiplier": b, "cap": c}, n) for a, b, c, n in cases] == [10, 15, 320, reducer.MOST, 0, 5]


def test_fairness():
    found = schedule.picks([("a", 1), ("b", 2), ("c", 4)], 70_000)
    assert "".join(found[:7]) == "cbcacbc"
    assert [found.count(k) for k in "abc"] == [10_000, 20_000, 40_000]


def test_bench_and_replay(spark):
    events = workload.folded(spark, 5).collect()
    assert len(events) == 130
    state = reducer.replay([json.loads(r["event"]) for r in sorted((r for r in events if r["workflow_id"] == events[0]["workflow_id"]), key=lambda r: r["sequence"])])
    assert state["status"] == "completed" and state["version"] == 26


def test_release_trace_has_every_kind_and_replays(spark):
    rows = workload.trace(spark).collect()
    assert {r["kind"] for r in rows} == KINDS
    last = {}
    for w in {r["workflow_id"] for r in rows}:
        last[w] = reducer.replay([json.loads(r["event"]) for r in sorted((r for r in rows if r["workflow_id"] == w), key=lambda r: r["sequence"])])["status"]
    assert last == {"release": "compensated", "completed": "completed", "failed": "failed", "cancelled": "cancelled", "undone": "compensated"}


def test_dedup_conflict_and_rejection():
    commands = workload.diamond(0)
    engine = reducer.Engine()
    assert [engine.handle(c)[0] for c in commands] == ["accepted"] * 17
    assert [engine.handle(c)[0] for c in commands] == ["duplicate"] * 17
    assert engine.handle(commands[2] | {"output": {"x": "y"}})[0] == "request_conflict"
    late = commands[3] | {"request_id": "other"}
    assert engine.handle(late)[0] in ("time_regression", "invalid_transition") and "other" not in engine.requests


def test_retry_deadlines():
    retry = {"max_attempts": 3, "initial": 10, "multiplier": 2, "cap": 15}
    t = workload.Trace("w", {"name": "n", "namespace": "s", "tasks": [{"id": "a", "type": "t", "retry": retry}]})
    deadlines = []
    for _ in range(3):
        t.at += 1
        lease = t.start("a")
        t.at += 1
        events = t.send("fail_task", **lease, error="no")
        deadlines += [e["timer"]["deadline"] for e in events if e["kind"] == "timer_scheduled"]
        if t.engine.state["status"] == "running":
            t.fire()
    assert deadlines == [12, 29] and t.engine.state["status"] == "failed"


def test_timeout_wins_ties():
    t = workload.Trace("w", {"name": "n", "namespace": "s", "tasks": [{"id": "a", "type": "t", "timeout": 100}]})
    lease = t.start("a", 100)
    t.at = 100
    assert t.engine.handle({"kind": "expire_lease", "request_id": "x", "workflow_id": "w", "at": 100, **lease})[0] == "invalid_transition"
    t.fire()
    assert t.engine.state["status"] == "failed"
    t = workload.Trace("v", {"name": "n", "namespace": "s", "tasks": [{"id": "a", "type": "t", "timeout": 100}]})
    lease = t.start("a", 50)
    t.at = 50
    t.send("expire_lease", **lease)
    assert t.engine.state["tasks"]["a"]["status"] == "ready"


@pytest.mark.parametrize("seed", range(40))
def test_random_graphs_against_a_plain_model(seed):
    rng = random.Random(seed)
    n = 2 + seed % 11
    deps = {f"t{k:02d}": [f"t{j:02d}" for j in range(k) if rng.random() < 0.25] for k in range(n)}
    order = list(deps)
    rng.shuffle(order)
    t = workload.Trace("w", {"name": "n", "namespace": "s", "tasks": [{"id": k, "type": "t", "dependencies": deps[k]} for k in order]})
    ran = []
    while t.engine.state["status"] == "running":
        wave = sorted(k for k, x in t.engine.state["tasks"].items() if x["status"] == "ready")
        for k in wave:
            t.run(k)
        ran += wave
    plain, done = [], set()
    while len(done) < n:
        wave = sorted(k for k in deps if k not in done and set(deps[k]) <= done)
        plain += wave
        done |= set(wave)
    assert ran == plain and t.engine.state["status"] == "completed"


def test_stream_equals_batch(spark, small):
    assert catalog.QUERIES["stream_equals_batch"](spark, small).count() == 0


def test_definitions(spark):
    got = {r["name"]: r["error"] for r in workload.validated(spark).collect()}
    assert got == {k: None if k == "good" else k for k in workload.bad_definitions()}


def test_disputed_commands_and_identity():
    engine = reducer.Engine()
    got = [engine.handle(c)[0] for c in workload.disputed(1)]
    assert [got.count(k) for k in ("accepted", "duplicate", "invalid_command")] == [9, 2, 5]
    assert engine.result("req-1") == (1, 3) and engine.result("req-1-3") is None
    made = reducer.normalised({"kind": "submit_workflow", "request_id": "request", "definition": {"namespace": "test"}})
    assert made["workflow_id"] == "wf_044a741fd3b7366e5f3c585d"
    for odd in (None, [], {"kind": "stop", "request_id": "r", "at": 1}, {"kind": "submit_workflow", "request_id": "r", "at": "1"}, {"kind": "submit_workflow", "request_id": "r", "at": 1, "definition": {"name": "n", "tasks": [1]}}):
        before = json.dumps([engine.state, engine.requests])
        assert engine.handle(odd)[0] in ("invalid_command", "invalid_definition") and json.dumps([engine.state, engine.requests]) == before


def test_batches_go_all_or_not_at_all():
    commands = workload.diamond(2)
    engine = reducer.Engine()
    assert engine.batch(commands[:5], keep=False)[:2] == (5, None) and engine.state is None and not engine.requests
    assert engine.batch([*commands[:3], commands[9]])[:2] == (3, "invalid_transition") and engine.state is None
    passed, error, events = engine.batch(commands)
    assert (passed, error, len(events)) == (17, None, 26) and engine.state["status"] == "completed"


def test_restore_checks_receipts():
    engine, events = reducer.Engine(), []
    for c in workload.diamond(3):
        events += engine.handle(c)[1]
    again = reducer.restored(events, engine.requests)
    assert reducer.state_hash(again.state) == reducer.state_hash(engine.state) and again.handle(workload.diamond(3)[4])[0] == "duplicate"
    broken = {k: list(x) for k, x in engine.requests.items()}
    broken["bench-3-submit"][2] += 1
    for receipts in (broken, {k: x for k, x in engine.requests.items() if k != "bench-3-submit"}):
        with pytest.raises(reducer.Rejected):
            reducer.restored(events, receipts)


def test_definition_files_are_read_strictly(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftlog.sources import commands

    (tmp_path / "one.json").write_text(json.dumps({"name": "n", "namespace": "s", "tasks": [{"id": "a", "type": "t", "dependencies": []}]}, indent=1))
    found = commands.submissions(commands.definitions(spark, str(tmp_path)), F.lit("r"), F.lit(5)).first()
    assert (found["kind"], found["at"], found["definition"]["tasks"][0]["id"]) == ("submit_workflow", 5, "a")
    (tmp_path / "two.json").write_text("{broken")
    with pytest.raises(Exception):
        commands.definitions(spark, str(tmp_path)).collect()


def test_the_plan_prefers_the_smaller_name(spark):
    found = spark.createDataFrame([("ab", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "namespace string, workflow_id long, task_id string")
    usage = spark.createDataFrame([("ab", 2, 5, 0), ("a", 2, 5, 0), ("b", 2, 5, 5)], "namespace string, weight long, max_running long, running long")
    got = {r["namespace"]: (r["workflow_id"], r["credit"]) for r in schedule.planned(found, usage, spark.createDataFrame([], "namespace string, credit long")).collect()}
    assert got == {"a": (2, -2), "ab": (None, 2)}
