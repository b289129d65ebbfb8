"""The workflow model over the driver's tables: a log, workflows, tasks, dependency edges and retry policies.

Each view is a lazy DataFrame; the DuckDB text of the same rule stands beside it in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

TERMINAL = ["completed", "failed", "cancelled", "compensated"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    """Whole milliseconds, rounded down, of a timestamp without zone read as UTC."""
    return F.expr(f"unix_millis(cast({column} as timestamp))")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, at_ms, workflow_id, kind, request_id, request_hash, value, sequence; ``sequence`` is dense per workflow."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("pos"),
        millis("ts").alias("at_ms"),
        F.col("user_id").alias("workflow_id"),
        F.col("event_type").alias("kind"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("request_id"),
        F.sha2("props", 256).alias("request_hash"),
        "value",
    )
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy("workflow_id").orderBy("pos")).cast("long"))


def workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("scheduled")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.select(F.col("o_orderkey").alias("workflow_id"), F.col("c_mktsegment").alias("namespace"), status.alias("status"), millis("o_orderdate").alias("submitted"), F.col("o_totalprice").alias("price"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = line.withColumn("task_ord", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("l_orderkey").alias("workflow_id"),
        "task_ord",
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.lpad(F.col("task_ord").cast("string"), 2, "0")).alias("task_id"),
        F.col("l_returnflag").alias("task_type"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"),
        F.col("l_suppkey").alias("worker"),
        millis("l_shipdate").alias("started"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )


def edges(tasks: DataFrame) -> DataFrame:
    """(workflow_id, task_ord, dep_ord): each task waits for the one before it and, from the third on, for the first."""
    deps = F.when(F.col("task_ord") >= 3, F.array(F.col("task_ord") - 1, F.lit(1).cast("long"))).when(F.col("task_ord") == 2, F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return tasks.select("workflow_id", "task_ord", F.explode(deps).alias("dep_ord"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return p.select(key.alias("part"), size.alias("initial"), (1 + key % 4).alias("multiplier"), F.when(size % 3 == 0, 0).otherwise(size * 10).cast("long").alias("cap"), (1 + key % 5).alias("max_attempts"))


#: The same views for DuckDB.
SQL = """log AS (SELECT event_id AS pos, epoch_us(ts) // 1000 AS at_ms, user_id AS workflow_id, event_type AS kind,
  user_id::VARCHAR || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS request_id, sha256(props) AS request_hash, value,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
wf AS (SELECT o_orderkey AS workflow_id, c_mktsegment AS namespace, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'scheduled' END AS status,
  epoch_us(o_orderdate) // 1000 AS submitted, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey),
task AS (SELECT l_orderkey AS workflow_id, ord AS task_ord, l_orderkey::VARCHAR || '-' || lpad(ord::VARCHAR, 2, '0') AS task_id, l_returnflag AS task_type,
  CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'pending' END AS status, l_suppkey AS worker, epoch_us(l_shipdate) // 1000 AS started, l_partkey AS part, l_quantity::BIGINT AS quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem)),
edge AS (SELECT workflow_id, task_ord, task_ord - 1 AS dep_ord FROM task WHERE task_ord >= 2 UNION ALL SELECT workflow_id, task_ord, 1 FROM task WHERE task_ord >= 3),
policy AS (SELECT p_partkey AS part, p_size::BIGINT AS initial, 1 + p_partkey % 4 AS multiplier, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size::BIGINT * 10 END AS cap, 1 + p_partkey % 5 AS max_attempts FROM part)"""
