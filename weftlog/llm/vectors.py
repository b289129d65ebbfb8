"""Sums of fixed-size vectors over all tasks, and bounded samples by hash; what the trained operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in a row of a vector on its way, and tasks that share a row's first merge.
ROW, SHARES = 1 << 10, 64


def merged(rows: DataFrame, kind: type, join: Callable = np.add) -> dict[int, np.ndarray]:
    """The arrays of equal ``chunk`` of ``rows`` (chunk int, blob binary) joined: in shares of the tasks they come from, then in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(blob.as_buffer(), kind)
                held[k] = join(held[k], one, out=held[k]) if k in held else one.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["chunk", "blob"])

    shared = rows.withColumn("share", F.spark_partition_id() % SHARES).repartition("chunk", "share").select("chunk", "blob").mapInArrow(run, "chunk int, blob binary")
    out: dict[int, np.ndarray] = {}
    for k, blob in shared.repartition("chunk").mapInArrow(run, "chunk int, blob binary").collect():
        out[k] = join(out[k], np.frombuffer(blob, kind)) if k in out else np.frombuffer(blob, kind)
    return out


def total(df: DataFrame, size: int, each: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``each(batch)``, float64 vectors of ``size``. A task sends one vector; rows of it are summed apart."""
    wide = -(-size // ROW) * ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(wide)
        for batch in batches:
            if batch.num_rows:
                sums[:size] += each(batch)
        rows = sums.reshape(-1, ROW)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[k].tobytes() for k in some], pa.binary())], ["chunk", "blob"])

    out = np.zeros((wide // ROW, ROW))
    for k, sums in merged(df.mapInArrow(run, "chunk int, blob binary"), np.float64).items():
        out[k] = sums
    return out.reshape(-1)[:size]


def sampled(df: DataFrame, key: Column, most: int, rows: int) -> DataFrame:
    """About ``most`` of the ``rows`` rows of ``df``, at most, chosen by a hash of ``key`` so that runs agree."""
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / rows))
