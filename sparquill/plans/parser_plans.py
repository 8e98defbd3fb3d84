"""Parsers and relations on sources whose answer is known: texts in six formats written from regions and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import extraction
from sparquill.session import table
from sparquill.sources.parsers import parse_sources, with_ids

_FORMATS = ("java", "ddl", "go", "python", "openapi")


def written_sources(spark, sf_dir):
    """(source_id, format, filename, text): per region and format one source, a class, schema or API with a part per nation, each referring to the next or the one before."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("r")).agg(F.sort_array(F.collect_set(F.col("n_nationkey").cast("string").cast("int"))).alias("n"))  # five nations each
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    after = lambda i: F.try_element_at("n", i + 2)
    call = lambda i, prefix: F.when(after(i).isNotNull(), F.concat(name(prefix, after(i)), F.lit("() + 1"))).otherwise("1")
    up = lambda i: F.when(i == 0, name("region", F.col("r"))).otherwise(name("nation", F.try_element_at("n", F.greatest(i, F.lit(1)))))
    parts = {
        "java": ("package shop.r{r};\n\npublic class Region{r} {\n", lambda x, i: F.concat(F.lit("  public int "), name("nation", x), F.lit("() {\n    return "), call(i, "nation"), F.lit(";\n  }\n")), "\n", "}\n"),
        "ddl": ("CREATE TABLE region{r} (\n  id INT PRIMARY KEY\n);\n\n", lambda x, i: F.concat(F.lit("CREATE TABLE "), name("nation", x), F.lit(" (\n  id INT PRIMARY KEY,\n  up INT,\n  FOREIGN KEY (up) REFERENCES "), up(i), F.lit(" (id)\n);\n")), "\n", ""),
        "go": ("package r{r}\n\n", lambda x, i: F.concat(F.lit("func "), name("Nation", x), F.lit("() int {\n\treturn "), call(i, "Nation"), F.lit("\n}\n")), "\n", ""),
        "python": ("class Region{r}:\n", lambda x, i: F.concat(F.lit("    def "), name("nation", x), F.lit("(self):\n        return 1\n")), "\n", ""),
        "openapi": ('{"openapi": "3.0.0", "info": {"title": "R{r}", "version": "1"}, "paths": {', lambda x, i: F.concat(F.lit('"/'), name("nation", x), F.lit('": {"get": {"summary": "one", "responses": {}}}')), ", ", "}}"),
    }
    out = None
    for k, fmt in enumerate(_FORMATS):
        head, part, joiner, tail = parts[fmt]
        text = F.concat(F.replace(F.lit(head), F.lit("{r}"), F.col("r").cast("string")), F.array_join(F.transform("n", part), joiner), F.lit(tail))
        rows = nations.select((F.col("r") * 10 + k).alias("source_id"), F.lit(fmt).alias("format"), F.lit("x").alias("filename"), text.alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def parsed_written(spark, sf_dir):
    pieces = parse_sources(written_sources(spark, sf_dir))
    return pieces.select("source_id", "ord", "chunk_type", "position_path", "parent_path", "start_line", "end_line", "error")


def _named(edges, pieces):
    """Edges with the paths of their ends in place of hashed ids."""
    paths = pieces.select("source_id", "chunk_id", "position_path")
    a, b = paths.select(F.col("chunk_id").alias("source"), "source_id", F.col("position_path").alias("from_path")), paths.select(F.col("chunk_id").alias("target"), F.col("position_path").alias("to_path"))
    return edges.join(a, "source").join(b, "target").select("source_id", "from_path", "to_path", "relation_type", "direction", "is_hard")


def written_calls(spark, sf_dir):
    sources = written_sources(spark, sf_dir)
    pieces = with_ids(parse_sources(sources))
    return _named(extraction.call_edges(sources, pieces), pieces)


def written_foreign_keys(spark, sf_dir):
    sources = written_sources(spark, sf_dir)
    pieces = with_ids(parse_sources(sources))
    return _named(extraction.foreign_key_edges(sources, pieces), pieces)


def written_parents(spark, sf_dir):
    """Each piece's parent by its path."""
    pieces = with_ids(parse_sources(written_sources(spark, sf_dir)))
    parents = pieces.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("position_path").alias("parent"))
    return pieces.filter("parent_chunk_id IS NOT NULL").join(parents, "parent_chunk_id").select("source_id", "position_path", "parent")


QUERIES = {f.__name__: f for f in (parsed_written, written_calls, written_foreign_keys, written_parents)}

_N = """WITH n AS (SELECT n_regionkey::BIGINT AS r, n_nationkey AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS y,
  lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS z FROM nation), g AS (SELECT r, count(*) AS m FROM n GROUP BY 1),
p AS (SELECT r * 10 AS source_id, 0 AS ord, 'symbol' AS chunk_type, 'shop.r' || r || '.Region' || r AS position_path, '' AS parent_path, 3 AS start_line, 4 * m + 3 AS end_line FROM g
UNION ALL SELECT r * 10, i + 1, 'symbol', 'shop.r' || r || '.Region' || r || '#nation' || x, 'shop.r' || r || '.Region' || r, 4 + 4 * i, 6 + 4 * i FROM n
UNION ALL SELECT r * 10 + 1, 0, 'table', 'table:region' || r, '', 1, 3 FROM g UNION ALL SELECT r * 10 + 1, 1, 'column', 'table:region' || r || '.column:id', 'table:region' || r, 2, 2 FROM g
UNION ALL SELECT r * 10 + 1, 2 + 3 * i, 'table', 'table:nation' || x, '', 5 + 6 * i, 9 + 6 * i FROM n
UNION ALL SELECT r * 10 + 1, 3 + 3 * i, 'column', 'table:nation' || x || '.column:id', 'table:nation' || x, 6 + 6 * i, 6 + 6 * i FROM n
UNION ALL SELECT r * 10 + 1, 4 + 3 * i, 'column', 'table:nation' || x || '.column:up', 'table:nation' || x, 7 + 6 * i, 7 + 6 * i FROM n
UNION ALL SELECT r * 10 + 2, i, 'function', 'r' || r || '.Nation' || x, '', 3 + 4 * i, 5 + 4 * i FROM n
UNION ALL SELECT r * 10 + 3, 0, 'class', 'x.Region' || r, 'x', 1, 3 * m FROM g
UNION ALL SELECT r * 10 + 3, i + 1, 'method', 'x.Region' || r || '.nation' || x, 'x.Region' || r, 2 + 3 * i, 3 + 3 * i FROM n
UNION ALL SELECT r * 10 + 4, i, 'endpoint', 'GET /nation' || x, '', 0, 0 FROM n)
"""
_BOTH = """SELECT source_id, a AS from_path, b AS to_path, '{0}' AS relation_type, 'out' AS direction, true AS is_hard FROM e UNION ALL SELECT source_id, b, a, '{1}', 'in', true FROM e"""
SQL = {
    "parsed_written": _N + "SELECT source_id, ord::INT AS ord, chunk_type, position_path, parent_path, start_line::INT AS start_line, end_line::INT AS end_line, NULL::VARCHAR AS error FROM p",
    "written_calls": _N + ", e AS (SELECT r * 10 AS source_id, 'shop.r' || r || '.Region' || r || '#nation' || x AS a, 'shop.r' || r || '.Region' || r || '#nation' || y AS b FROM n WHERE y IS NOT NULL) " + _BOTH.format("calls", "called_by"),
    "written_foreign_keys": _N + ", e AS (SELECT r * 10 + 1 AS source_id, 'table:nation' || x AS a, CASE WHEN z IS NULL THEN 'table:region' || r ELSE 'table:nation' || z END AS b FROM n) " + _BOTH.format("fk_references", "fk_referenced_by"),
    "written_parents": _N + "SELECT source_id, position_path, parent_path AS parent FROM p WHERE parent_path <> '' AND parent_path <> 'x'",
}
