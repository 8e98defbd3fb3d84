"""Expansion over foreign-key edges of the star schema, from the orders whose key is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import graph
from sparquill.session import table

# a node is its key plus a thousand billions for each table before it
_ORDER, _CUSTOMER, _NATION, _REGION, _PART, _SUPPLIER = (i * 1_000_000_000_000 for i in range(6))
_EDGES = (
    ("orders", "o_orderkey", _ORDER, "o_custkey", _CUSTOMER), ("customer", "c_custkey", _CUSTOMER, "c_nationkey", _NATION), ("nation", "n_nationkey", _NATION, "n_regionkey", _REGION),
    ("supplier", "s_suppkey", _SUPPLIER, "s_nationkey", _NATION), ("lineitem", "l_orderkey", _ORDER, "l_partkey", _PART), ("lineitem", "l_orderkey", _ORDER, "l_suppkey", _SUPPLIER),
)


def edges(spark, sf_dir):
    """Each foreign key once; suppliers of orders are soft."""
    out = None
    for name, key, at, ref, to in _EDGES:
        rows = table(spark, sf_dir, name).select((F.col(key) + at).cast("bigint").alias("source"), (F.col(ref) + to).cast("bigint").alias("target")).filter("source IS NOT NULL AND target IS NOT NULL").distinct()
        rows = rows.select("source", "target", F.lit("fk_references" if ref != "l_suppkey" else "inferred").alias("relation_type"), F.lit(ref != "l_suppkey").alias("is_hard"))
        out = rows if out is None else out.unionByName(rows)
    digest = F.substring(F.md5(F.concat_ws("-", "source", "target")), 1, 15)
    return out.withColumn("edge_id", F.conv(digest, 16, 10).cast("bigint")).withColumn("direction", F.lit("out"))


def _seeds(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("qid")).distinct()
    return keys.select("qid", F.lit(0).alias("scope"), (F.col("qid") + _ORDER).alias("doc"))


def _expand(spark, sf_dir, hops, direction="out", relations=None):
    directed = graph.directed_edges(edges(spark, sf_dir), direction, relations)
    out = graph.expand(_seeds(spark, sf_dir), directed, hops)
    return out.select("qid", "doc", "start", "hop", F.round("weight", 6).alias("weight"), "is_hard", F.array_join(F.transform("path", lambda e: e["edge_id"].cast("string")), ",").alias("edges"))


def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("source", "target", "edge_id", "relation_type", "is_hard")


def graph_directed_edges(spark, sf_dir):
    return graph.directed_edges(edges(spark, sf_dir)).drop("scope")


def graph_default_relations(spark, sf_dir):
    """What an expansion without named relations may walk: the stored edges of the default relations, each way."""
    both = graph.directed_edges(edges(spark, sf_dir), relations=graph.DEFAULT_RELATIONS)
    return both.groupBy("relation_type", "direction").agg(F.count("*").alias("edges"))


def graph_expand_1hop(spark, sf_dir):
    return _expand(spark, sf_dir, 1, "bidirectional")


def graph_expand_2hop(spark, sf_dir):
    return _expand(spark, sf_dir, 2)


def graph_expand_2hop_bidirectional(spark, sf_dir):
    return _expand(spark, sf_dir, 2, "bidirectional", ("fk_references",))


def graph_expand_3hop_bidirectional(spark, sf_dir):
    """The default expansion: every relation, both ways, three hops, through hubs as customers, parts and suppliers are, within the budget."""
    out = graph.reach(_seeds(spark, sf_dir), graph.directed_edges(edges(spark, sf_dir), relations=graph.DEFAULT_RELATIONS), 3, 10)
    return out.select("qid", "doc", "hop", F.round("weight", 6).alias("weight"), "graph_rank")


def graph_expand_hard_only(spark, sf_dir):
    return _expand(spark, sf_dir, 3, relations=("fk_references",))


def graph_expand_3hop_budget(spark, sf_dir):
    out = graph.expand(_seeds(spark, sf_dir), graph.directed_edges(edges(spark, sf_dir), "out"), 3, budget=10)
    return graph.within_budget(out, 10).select("qid", "doc", "hop", F.round("weight", 6).alias("weight"), "graph_rank")


def graph_neighbours(spark, sf_dir):
    out = graph.neighbours(_seeds(spark, sf_dir), graph.directed_edges(edges(spark, sf_dir), "out"), 3)
    return out.select("qid", "doc", F.round("weight", 6).alias("weight"), "graph_rank")


def graph_path_steps(spark, sf_dir):
    out = graph.expand(_seeds(spark, sf_dir), graph.directed_edges(edges(spark, sf_dir), "out"), 2)
    return graph.path_rows(out)


def graph_same_part(spark, sf_dir):
    """Orders that share a part with a seed: one hop out, one back."""
    parts = edges(spark, sf_dir).filter(F.col("target").between(_PART, _SUPPLIER - 1))
    out = graph.expand(_seeds(spark, sf_dir), graph.directed_edges(parts), 2)
    return out.groupBy("qid").agg(F.count_if(F.col("hop") == 1).alias("parts"), F.count_if(F.col("hop") == 2).alias("orders"))


def _soft(spark, sf_dir):
    """Inferred relations: a part and its supplier, as often as they were delivered together, with discount as confidence."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("inferred").alias("relation_type"), F.round(F.col("l_discount") * 10, 3).cast("decimal(6,3)").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("edge_id"), F.array(F.col("l_orderkey").cast("string")).alias("evidence"))
    return rows.withColumn("lifecycle_state", graph.soft_state(F.col("confidence"), F.col("evidence")))


def soft_states(spark, sf_dir):
    return _soft(spark, sf_dir).select("edge_id", "source", "target", "lifecycle_state")


def soft_supersede(spark, sf_dir):
    out = graph.supersede(_soft(spark, sf_dir))
    return out.select("edge_id", "lifecycle_state", "superseded_by")


QUERIES = {
    f.__name__: f
    for f in (graph_edges, graph_directed_edges, graph_default_relations, graph_expand_1hop, graph_expand_2hop, graph_expand_2hop_bidirectional, graph_expand_3hop_bidirectional, graph_expand_hard_only, graph_expand_3hop_budget, graph_neighbours, graph_path_steps, graph_same_part, soft_states, soft_supersede)
}

_E = "WITH RECURSIVE e AS (SELECT source, target, relation_type, is_hard, CAST('0x' || substr(md5(source || '-' || target), 1, 15) AS BIGINT) AS edge_id FROM (" + " UNION ALL ".join(
    f"SELECT DISTINCT ({key} + {at})::BIGINT AS source, ({ref} + {to})::BIGINT AS target, '{'inferred' if ref == 'l_suppkey' else 'fk_references'}' AS relation_type, {ref != 'l_suppkey'} AS is_hard FROM {name} WHERE {key} IS NOT NULL AND {ref} IS NOT NULL"
    for name, key, at, ref, to in _EDGES
) + "))"
_BACK = "SELECT target AS f, source AS t, edge_id, CASE WHEN is_hard THEN 'fk_referenced_by' ELSE relation_type END AS relation_type, 'in' AS direction, is_hard FROM e"
_AHEAD = "SELECT source AS f, target AS t, edge_id, relation_type, 'out' AS direction, is_hard FROM e"


def _walk(directed: str, hops: int) -> str:
    return _E + f""", d AS ({directed}), x AS (
  SELECT o_orderkey AS qid, t AS doc, f AS start, 1 AS hop, CASE WHEN is_hard THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS weight, is_hard, edge_id::VARCHAR AS edges, [f] AS visited
  FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 50 = 0) JOIN d ON f = o_orderkey
  UNION ALL
  SELECT qid, t, start, hop + 1, CASE WHEN d.is_hard THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * pow(0.5::DOUBLE, hop), d.is_hard, edges || ',' || d.edge_id::VARCHAR, list_append(visited, f)
  FROM x JOIN d ON d.f = x.doc WHERE hop < {hops} AND NOT list_contains(visited, t)
), b AS (SELECT qid, doc, start, hop, round(weight, 6) AS weight, is_hard, edges FROM x QUALIFY row_number() OVER (PARTITION BY qid, doc ORDER BY weight DESC, hop, start, edges) = 1)
"""


_SOFT = "WITH s AS (SELECT l_partkey AS source, l_suppkey AS target, round(l_discount * 10, 3)::DECIMAL(6,3) AS confidence, l_orderkey * 10 + l_linenumber AS edge_id FROM lineitem), t AS (SELECT *, CASE WHEN confidence >= 0.6 THEN 'active' ELSE 'inferred' END AS state FROM s)"
SQL = {
    "graph_edges": _E + " SELECT source, target, edge_id, relation_type, is_hard FROM e",
    "graph_directed_edges": _E + f""" SELECT f AS "from", t AS "to", edge_id, relation_type, direction, is_hard FROM ({_AHEAD} UNION ALL {_BACK})""",
    "graph_default_relations": _E + f" SELECT relation_type, direction, count(*) AS edges FROM ({_AHEAD} UNION ALL {_BACK}) GROUP BY ALL",
    "graph_expand_2hop_bidirectional": _walk(f"{_AHEAD} WHERE relation_type = 'fk_references' UNION ALL {_BACK} WHERE relation_type = 'fk_references'", 2) + "SELECT * FROM b",
    "graph_expand_3hop_bidirectional": _walk(f"{_AHEAD} UNION ALL {_BACK}", 3) + "SELECT qid, doc, hop, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, hop, doc) AS graph_rank FROM b QUALIFY graph_rank <= 10",
    "graph_expand_1hop": _walk(f"{_AHEAD} UNION ALL {_BACK}", 1) + "SELECT * FROM b",
    "graph_expand_2hop": _walk(_AHEAD, 2) + "SELECT * FROM b",
    "graph_expand_hard_only": _walk(_AHEAD + " WHERE relation_type = 'fk_references'", 3) + "SELECT * FROM b",
    "graph_expand_3hop_budget": _walk(_AHEAD, 3) + "SELECT qid, doc, hop, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, hop, doc) AS graph_rank FROM b QUALIFY graph_rank <= 10",
    "graph_neighbours": _walk(_AHEAD, 1) + "SELECT qid, doc, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, hop, doc) AS graph_rank FROM b QUALIFY graph_rank <= 3",
    "graph_path_steps": _walk(_AHEAD, 2) + """, p AS (SELECT qid, doc, CAST(unnest(string_split(edges, ',')) AS BIGINT) AS edge_id, unnest(range(1, len(string_split(edges, ',')) + 1)) AS hop FROM b)
SELECT qid, doc, hop::INT AS hop, edge_id, relation_type, 'out' AS direction, is_hard FROM p JOIN (SELECT DISTINCT edge_id, relation_type, is_hard FROM e) USING (edge_id)""",
    "graph_same_part": _E + f""", p AS (SELECT o_orderkey AS qid, target FROM orders JOIN e ON source = o_orderkey WHERE o_orderkey % 50 = 0 AND target BETWEEN {_PART} AND {_SUPPLIER - 1})
SELECT qid, count(DISTINCT target) AS parts, count(DISTINCT source) FILTER (source <> qid) AS orders FROM p LEFT JOIN e USING (target) GROUP BY 1""",
    "soft_states": _SOFT + " SELECT edge_id, source, target, state AS lifecycle_state FROM t",
    "soft_supersede": _SOFT + """, m AS (SELECT *, max({'confidence': confidence, 'edge_id': edge_id}) FILTER (state = 'active') OVER (PARTITION BY source, target) AS b FROM t)
SELECT edge_id, CASE WHEN state = 'active' AND b.confidence > confidence THEN 'superseded' ELSE state END AS lifecycle_state, CASE WHEN state = 'active' AND b.confidence > confidence THEN b.edge_id END AS superseded_by FROM m""",
}
