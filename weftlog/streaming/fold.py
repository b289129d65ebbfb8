"""The same fold over a stream of commands: one keyed state per workflow, events appended per micro-batch.

State is the workflow and its requests as JSON. The sink writes each micro-batch under its own number and overwrites
it on a retry, so a batch that runs twice counts once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import workload
from ..operators.reducer import TERMINAL, Engine
from ..shared import place


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A workflow's commands of one micro-batch, in order of position, from where the last batch left it."""
    kept = json.loads(state.get[0]) if state.exists else {"state": None, "requests": {}}
    engine, out = Engine(kept["state"], kept["requests"]), []
    commands = pd.concat(list(batches)).sort_values("position")["command"]
    for text in commands:
        out += engine.handle(json.loads(text))[1]
    if engine.state and engine.state["status"] in TERMINAL:
        engine.state = {k: v for k, v in engine.state.items() if k not in ("tasks", "timers")} | {"tasks": {}, "timers": {}}
    state.update((json.dumps({"state": engine.state, "requests": engine.requests}),))
    yield workload.rows(out)


def streamed(commands: DataFrame) -> DataFrame:
    """Events of a streaming command log."""
    return commands.groupBy("workflow_id").applyInPandasWithState(advance, workload.EVENTS, "state string", "append", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, source: str, sink: str, checkpoint: str) -> DataFrame:
    """Folds the Parquet command files under ``source``, one a micro-batch, and returns what the sink then holds."""
    commands = spark.readStream.schema("workflow_id string, position long, command string").option("maxFilesPerTrigger", 1).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = streamed(commands).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(workload.EVENTS).parquet(f"{sink}/batch=*")


def difference(spark: SparkSession, workflows: int) -> DataFrame:
    """Events that the streamed or the batch fold of the bench workload has and the other has not."""
    root = place(spark, "stream")
    commands = workload.bench_commands(spark, workflows)
    for low, high in ((0, 5), (6, 11), (12, 16)):
        commands.where(f"position between {low} and {high}").coalesce(1).write.mode("append").parquet(f"{root}/commands")
    batch, stream = workload.fold(commands), run(spark, f"{root}/commands", f"{root}/events", f"{root}/checkpoint")
    return batch.exceptAll(stream).unionByName(stream.exceptAll(batch))
