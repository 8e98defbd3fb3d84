"""Relations read from source texts: calls between Java methods, foreign keys between tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.sources.parsers.code import java_calls
from sparquill.sources.parsers.schemas import foreign_keys

_FOUND = "source_id bigint, source_name string, target_name string, line int"


def _mentions(sources: DataFrame, fmt: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["source_id"], pdf["text"]):
                found = java_calls(text) if fmt == "java" else [(a, b, 0) for a, b in foreign_keys(text)]
                out += [(key, a, b, line) for a, b, line in found]
            yield pd.DataFrame(out, columns=["source_id", "source_name", "target_name", "line"])

    return sources.filter((F.col("format") == fmt) & F.col("text").isNotNull()).select("source_id", "text").mapInPandas(run, _FOUND)


def _linked(mentions: DataFrame, pieces: DataFrame, name, forward: str, backward: str, extractor: str) -> DataFrame:
    """Edges both ways between the pieces of the names; of several pieces of a name the first counts, no piece links to itself."""
    first = pieces.withColumn("name", name).filter("name <> ''").groupBy("source_id", "name").agg(F.min_by("chunk_id", "ord").alias("chunk"))
    a = first.select("source_id", F.col("name").alias("source_name"), F.col("chunk").alias("source"))
    b = first.select("source_id", F.col("name").alias("target_name"), F.col("chunk").alias("target"))
    pairs = mentions.join(a, ["source_id", "source_name"]).join(b, ["source_id", "target_name"]).filter("source <> target")
    evidence = F.struct(F.lit(extractor).alias("extractor"), F.concat_ws(":", "source_id", "line").alias("locator"))
    out = pairs.select("source", "target", F.lit(forward).alias("relation_type"), F.lit("out").alias("direction"), evidence.alias("parse_evidence"))
    back = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(backward).alias("relation_type"), F.lit("in").alias("direction"), evidence.alias("parse_evidence"))
    both = out.unionByName(back).dropDuplicates(["source", "target", "relation_type"])
    return both.withColumn("is_hard", F.lit(True)).withColumn("edge_id", F.xxhash64("source", "target", "relation_type"))


def call_edges(sources: DataFrame, pieces: DataFrame) -> DataFrame:
    """calls and called_by between the method pieces of each Java source, sources (source_id, format, text)."""
    return _linked(_mentions(sources, "java"), pieces, F.regexp_extract("position_path", "#([^#]+)$", 1), "calls", "called_by", "java_calls")


def foreign_key_edges(sources: DataFrame, pieces: DataFrame) -> DataFrame:
    """fk_references and fk_referenced_by between the table pieces of each DDL source; both tables must be there."""
    return _linked(_mentions(sources, "ddl"), pieces.filter("chunk_type = 'table'"), F.regexp_extract("position_path", "^table:(.+)$", 1), "fk_references", "fk_referenced_by", "ddl_keys")
