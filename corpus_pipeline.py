"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Quality classification (rejected documents go), near duplicates (of each group the smallest doc_id stays),
benchmark decontamination (documents with hits go), secret scan (spans become a mark), packing. A stage's result is
written as Parquet and read again, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import leaks, near, packing, quality, scratch, secrets
from weftlog.shipping import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, labels)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; a repeated row stays once."""
    ship(spark)
    groups = scratch.keep(near.near_duplicates(docs, count=False), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = near.without(docs, gone)
    twice = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(again)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    ship(spark)
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    ship(spark)
    return secrets.redacted(docs, secrets.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", good), ("near_duplicates", distinct), ("decontamination", unseen), ("secrets", redacted), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the field are trained; SQL cannot express them.
ORACLE_SQL = None
