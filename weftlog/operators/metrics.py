"""Metrics of workflow histories as aggregates: histograms and their quantiles, rates over sliding windows, queue gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds, in seconds, of latencies without bounds of their own. Fixed values.
DEFAULT = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def histogram(rows: DataFrame, seconds: str, bounds: list[float], *by: str) -> DataFrame:
    """(by, le, n): how many values are at most each bound; one aggregate with a count a bound, then a row a bound."""
    counts = rows.groupBy(*by).agg(*[F.count_if(F.col(seconds) <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count(seconds).alias("total"))
    cells = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n"))))
    return counts.select(*by, cells.alias("c")).select(*by, "c.le", "c.n")


def quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """(by, value): the quantile that cumulative buckets give by interpolation; beyond the last bound, that bound."""
    order = Window.partitionBy(*by).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*by))
    rows = buckets.withColumn("rank", q * total).withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("under", F.coalesce(F.lag("n").over(order), F.lit(0)))
    rows = rows.where((F.col("n") >= F.col("rank")) & (F.col("n") > 0))
    first = rows.groupBy(*by).agg(F.min_by(F.struct("le", "n", "low", "under", "rank"), "le").alias("b"))
    inside = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * (F.col("b.rank") - F.col("b.under")) / (F.col("b.n") - F.col("b.under"))
    return first.select(*by, F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(inside).alias("value"))


def sliding_rates(rows: DataFrame, at_ms: str, width: int, step: int, *by: str) -> DataFrame:
    """(by, start, rate): events a second in windows of ``width`` milliseconds that begin every ``step``."""
    last = F.floor(F.col(at_ms) / step).cast("long") * step
    starts = F.explode(F.sequence(last - width + step, last, F.lit(step).cast("long")))
    return rows.select(*by, starts.alias("start")).groupBy(*by, "start").agg((F.count("*") / (width / 1000)).alias("rate"))


def queue_gauge(ready: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(namespace, ready) of every namespace, none left out, and of all under ``_all``."""
    counts = ready.groupBy("namespace").agg(F.count("*").alias("n"))
    each = namespaces.join(counts, "namespace", "left").select("namespace", F.coalesce("n", F.lit(0)).cast("long").alias("ready"))
    return each.unionByName(ready.agg(F.lit("_all").alias("namespace"), F.count("*").alias("ready")))


def terminal_status(kind: Column) -> Column:
    """The status that a workflow's last event kind stands for; what is not told otherwise is compensated."""
    return F.when(kind == "workflow_completed", "completed").when(kind == "workflow_failed", "failed").when(kind == "workflow_cancelled", "cancelled").otherwise("compensated")
