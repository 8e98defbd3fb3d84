"""Queries on the section and symbol trees of ``chunks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators.hierarchy import descendants, faulty_links, hierarchy
from sparquill.session import table


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty_links(_tree(spark, sf_dir)).withColumnRenamed("id", "chunk_id")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select(
        F.col("id").alias("chunk_id"), "status", "root_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"),
    )


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_tree(spark, sf_dir))


_WALK = """
WITH RECURSIVE n AS (
  SELECT chunk_id AS id, min(parent_chunk_id) AS parent FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1
), w AS (
  SELECT id, parent AS at, CAST([] AS BIGINT[]) AS chain FROM n
  UNION ALL
  SELECT w.id, n.parent, list_append(w.chain, n.id) FROM w JOIN n ON n.id = w.at WHERE NOT list_contains(w.chain, n.id)
), e AS (
  SELECT w.id, w.chain, CASE WHEN w.at IS NULL THEN 'ok' WHEN NOT list_contains(w.chain, w.at) THEN 'orphan'
    WHEN list_contains(w.chain, w.id) THEN 'cycle' ELSE 'below_cycle' END AS status
  FROM w WHERE w.at IS NULL OR list_contains(w.chain, w.at) OR w.at NOT IN (SELECT id FROM n)
), t AS (SELECT id, status, list_filter(chain, lambda x: x <> id) AS up FROM e)
"""

QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants}

SQL = {
    "p5_found": _WALK + "SELECT id AS chunk_id, status AS defect FROM t WHERE status <> 'ok'",
    "p5_hierarchy": _WALK + """
SELECT id AS chunk_id, status, CASE WHEN status = 'ok' THEN COALESCE(up[len(up)], id) END AS root_id, CAST(len(up) AS INT) AS depth,
  array_to_string(list_append(list_reverse(up), id), '/') AS path FROM t""",
    "p5_descendants": _WALK + "SELECT unnest(up) AS ancestor_id, id AS descendant_id, unnest(range(1, len(up) + 1))::INT AS distance FROM t",
}
