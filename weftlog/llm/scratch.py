"""Intermediate tables in the folder that every executor shares.

A written table cuts lineage: it survives the loss of the executors that made it, and later jobs read
it instead of repeating the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import folder, place

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Narrow rows in a file of a table whose size is known.
ROWS = 250_000


class temporary:
    """Tables that are kept inside are deleted at the end, but for those that are spared, which belong to the scope around, if any."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> temporary:
        _OPEN.append(self)
        return self

    def spare(self, df: DataFrame) -> DataFrame:
        self.paths.remove(path := df._kept_at)
        if len(_OPEN) > 1:
            _OPEN[-2].paths.append(path)
        return df

    def __exit__(self, *error) -> None:
        _OPEN.pop()
        for path in self.paths:
            _delete(self.spark, path)


_OPEN: list[temporary] = []


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the scratch folder and returns a frame that reads it; about ``rows`` rows, if given, set the number of files."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(8, rows // ROWS))
    # the frame is run this once: its shuffle files can go as soon as the table is written
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _OPEN:
        _OPEN[-1].paths.append(path)
    return out


def drop(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; call it once results have been written."""
    _delete(spark, f"{folder(spark)}/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
