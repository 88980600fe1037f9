"""The driver's tables, and the graph, telemetry, journal and evaluation tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Evidence from strongest to weakest, and kinds of edges as derived here (fixed values).
EVIDENCE = ("resolved", "declared", "inferred", "observed", "unknown")
KIND_BASE = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "orders": 5}
BASE = 10**9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.lit(KIND_BASE[kind] * BASE) + F.col(key).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, kind, fqn) of regions, nations, customers, suppliers and orders."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
    parts = [table(spark, sf_dir, k).select(_id(k, c).alias("node_id"), F.lit(k).alias("kind"), F.concat(F.lit(f"{k}:"), F.col(c).cast("string")).alias("fqn")) for k, c in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, rank) from consumer to consumed; rank counts EVIDENCE."""
    links = (("nation", "n_nationkey", "region", "n_regionkey", "depends_on"), ("customer", "c_custkey", "nation", "c_nationkey", "uses_type"), ("supplier", "s_suppkey", "nation", "s_nationkey", "references"), ("orders", "o_orderkey", "customer", "o_custkey", "calls"))
    out = None
    for a, ka, b, kb, kind in links:
        part = table(spark, sf_dir, a).select(_id(a, ka).alias("src"), _id(b, kb).alias("dst"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank", ((F.col("src") + F.col("dst")) % len(EVIDENCE)).cast("int"))


GRAPH_SQL = """
nodes AS (
  SELECT 1000000000 + r_regionkey AS node_id, 'region' AS kind, 'region:' || r_regionkey AS fqn FROM region
  UNION ALL SELECT 2000000000 + n_nationkey, 'nation', 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 3000000000 + c_custkey, 'customer', 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 4000000000 + s_suppkey, 'supplier', 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 5000000000 + o_orderkey, 'orders', 'orders:' || o_orderkey FROM orders
), edges AS (
  SELECT *, CAST((src + dst) % 5 AS INTEGER) AS rank FROM (
  SELECT 2000000000 + n_nationkey AS src, 1000000000 + n_regionkey AS dst, 'depends_on' AS kind FROM nation
  UNION ALL SELECT 3000000000 + c_custkey, 2000000000 + c_nationkey, 'uses_type' FROM customer
  UNION ALL SELECT 4000000000 + s_suppkey, 2000000000 + s_nationkey, 'references' FROM supplier
  UNION ALL SELECT 5000000000 + o_orderkey, 3000000000 + o_custkey, 'calls' FROM orders)
)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workspace_id, kind, name, ts, duration_ms, n) from events; name is k of props modulo 10."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("workspace_id"), F.col("event_type").alias("kind"), F.concat(F.lit("k"), (k % 10).cast("string")).alias("name"),
        "ts", F.floor("value").cast("long").alias("duration_ms"), F.lit(1).cast("long").alias("n"),
    )


TELEMETRY_SQL = """
telemetry AS (
  SELECT user_id % 4 AS workspace_id, event_type AS kind, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS name, ts,
         CAST(floor(value) AS BIGINT) AS duration_ms, CAST(1 AS BIGINT) AS n FROM events
)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, task_id, category, solved, claimed, repetition) from documents and their labels."""
    from pyspark.sql import Window

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    order = Window.partitionBy("arm", "task_id").orderBy("doc_id")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("lang").alias("arm"), F.col("source").alias("task_id"), F.when(F.col("n_chars") < 1000, "small").otherwise("large").alias("category"),
        (F.col("quality") == 1).alias("solved"), (F.col("toxic") == 0).alias("claimed"),
    ).withColumn("repetition", F.row_number().over(order).cast("long"))


OUTCOMES_SQL = """
outcomes AS (
  SELECT d.doc_id, lang AS arm, source AS task_id, CASE WHEN n_chars < 1000 THEN 'small' ELSE 'large' END AS category, quality = 1 AS solved, toxic = 0 AS claimed,
         row_number() OVER (PARTITION BY lang, source ORDER BY d.doc_id) AS repetition
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """outcomes() as runs of an evaluation: two runs a repetition, some of which erred, timed out, were tampered with or not graded."""
    i = F.col("doc_id")
    return outcomes(spark, sf_dir).select(
        F.concat(F.lit("r"), i).alias("run_id"), "task_id", "category", "arm", F.when(i % 11 == 0, "environment_failed").when(i % 11 == 1, "timeout").when(i % 11 == 2, "completed").alias("status"),
        "solved", "claimed", (i % 17 == 0).alias("tampered"), F.expr("CAST(repetition div 2 AS INT)").alias("repetition"), (i % 1000).alias("tokens_used"), F.when(i % 13 == 0, "lost").alias("error"),
        F.when(i % 4 > 0, F.round(i % 6 / 5, 1)).alias("score"), i.alias("doc_id"),
    )


RUNS_SQL = OUTCOMES_SQL + """, runs AS (
  SELECT 'r' || doc_id AS run_id, task_id, category, arm, CASE doc_id % 11 WHEN 0 THEN 'environment_failed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'completed' END AS status, solved, claimed, doc_id % 17 = 0 AS tampered,
         repetition // 2 AS repetition, doc_id % 1000 AS tokens_used, CASE WHEN doc_id % 13 = 0 THEN 'lost' END AS error, CASE WHEN doc_id % 4 > 0 THEN doc_id % 6 / 5::DOUBLE END AS score, doc_id FROM outcomes
)"""
