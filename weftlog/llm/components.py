"""Connected components of a link table by label spreading with pointer jumping, all in joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Links that a task closes on its own at a time.
LINKS = 200_000


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars for links: of each run of links in a task, every node with the smallest of its component there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def out() -> pa.RecordBatch:
        nodes = [x for x in root if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > LINKS:
            yield out()
            root = {}
    if root:
        yield out()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node reachable.

    Tasks first close the links they hold, a bounded number at a time. Then a turn gives each node the
    least label among itself and its neighbours, and then the label of that label, until nothing changes. A
    path of length n takes about log n turns. Each turn is a written table, so a lost executor costs
    one turn. No links give an empty table.
    """
    with scratch.temporary(links.sparkSession) as own:
        return own.spare(_spread(links)).select("node", "component")


def _spread(links: DataFrame) -> DataFrame:
    rows = links.count()
    stars = links.select("a", "b").coalesce(-(-rows // LINKS) or 1).mapInArrow(_closed, "a long, b long")
    stars = scratch.keep(stars, "stars")
    both = scratch.keep(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", 2 * rows)
    label = scratch.keep(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels", rows)
    while True:
        far = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("low"))
        near = label.join(far, label["node"] == far["a"]).select("node", F.least("component", "low").alias("next"), F.col("component").alias("was"))
        near = scratch.keep(near, "labels", rows)
        hop = near.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        after = scratch.keep(near.join(hop, "next").select("node", F.least("next", "jump").alias("component"), "was"), "labels", rows)
        if after.where("component <> was").isEmpty():
            return after
        label = after.select("node", "component")


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after further ``links`` (a, b): only the components that they join are gone through again."""
    with scratch.temporary(links.sparkSession) as own:
        return own.spare(_joined(label, links))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti")
    every = scratch.keep(label.unionByName(ends.select("node", F.col("node").alias("component"))), "labels", label.count())
    one, two = every.toDF("a", "ca"), every.toDF("b", "cb")
    joined = links.join(one, "a").join(two, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    merged = connected(scratch.keep(joined, "joined", links.count())).toDF("component", "merged")
    return scratch.keep(every.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component")), "labels", label.count())
