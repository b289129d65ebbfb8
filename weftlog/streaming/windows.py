"""Counts of events by kind and hour over a stream, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import place


def counted(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(kind, start, n) by hour; state of hours that the watermark has passed is dropped, and events later than that do not count."""
    hours = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 hour"))
    return hours.count().select(F.col("event_type").alias("kind"), F.col("window.start").alias("start"), F.col("count").alias("n"))


def run(spark: SparkSession, source: str, schema: StructType) -> DataFrame:
    """Counts of the files under ``source``: each micro-batch writes the hours that it changed under its own number, so that one
    that runs twice counts once; an hour's count is that of the last batch that changed it."""
    root = place(spark, "windows")
    events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    query = counted(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.option("basePath", f"{root}/counts").schema("kind string, start timestamp, n long, batch long").parquet(f"{root}/counts/batch=*")
    return got.groupBy("kind", "start").agg(F.max_by("n", "batch").alias("n"))
