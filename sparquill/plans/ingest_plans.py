"""Whole sources, put together from their chunks, through detection, redaction, parsing, ids, parents and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import text as txt
from sparquill.operators import catalog, extraction
from sparquill.session import table
from sparquill.sources import files
from sparquill.sources.parsers import parse_sources, with_ids


def source_texts(spark, sf_dir):
    """(source_id, format, filename, text) of every source with chunks; a source's chunks are one row's worth of text."""
    chunks = table(spark, sf_dir, "chunks").select("source_id", "chunk_id", "content_text").dropDuplicates(["chunk_id"])
    texts = chunks.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "content_text"))).alias("c"))
    texts = texts.select("source_id", F.array_join(F.transform("c", lambda x: x["content_text"]), "\n\n").alias("text"))
    return catalog.latest_sources(table(spark, sf_dir, "knowledge_sources")).join(texts, "source_id").select("source_id", "format", "filename", txt.redact(F.col("text")).alias("text"))


def _pieces(spark, sf_dir):
    return parse_sources(source_texts(spark, sf_dir))


def parsed_pieces(spark, sf_dir):
    return with_ids(_pieces(spark, sf_dir)).select("source_id", "ord", "chunk_id", "parent_chunk_id", "position_path", "chunk_type", "start_line", "end_line", "token_count")


def parse_failures(spark, sf_dir):
    return _pieces(spark, sf_dir).filter("error IS NOT NULL").select("source_id", "error")


def call_graph(spark, sf_dir):
    return extraction.call_edges(source_texts(spark, sf_dir), with_ids(_pieces(spark, sf_dir))).select("edge_id", "source", "target", "relation_type", "direction", "is_hard")


def foreign_key_graph(spark, sf_dir):
    return extraction.foreign_key_edges(source_texts(spark, sf_dir), with_ids(_pieces(spark, sf_dir))).select("edge_id", "source", "target", "relation_type", "direction", "is_hard")


def detected_formats(spark, sf_dir):
    """The format by file name and text against the one recorded."""
    texts = source_texts(spark, sf_dir)
    return texts.groupBy("format", files.detect_format(F.col("filename"), F.col("text")).alias("detected")).agg(F.count("*").alias("sources"))


def parent_backfill(spark, sf_dir):
    """Parents found by path: the last chunk of the source whose path is the chunk's path without its last part."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "source_id", "position_path").dropDuplicates(["chunk_id"])
    above = F.regexp_extract("position_path", "^(.*) > ", 1)
    heads = chunks.filter("position_path <> ''").groupBy("source_id", F.col("position_path").alias("above")).agg(F.max("chunk_id").alias("parent_by_path"))
    return chunks.withColumn("above", above).join(heads, ["source_id", "above"]).filter("parent_by_path <> chunk_id").select("chunk_id", "parent_by_path")


def line_blocks(spark, sf_dir):
    """Blocks of 50 lines of every text, as the fallback for sources that do not parse."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    blocks = docs.groupBy("doc_id", F.floor(F.col("pos") / 50).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return blocks.select("doc_id", "block", (F.col("block") * 50 + 1).alias("start_line"), (F.col("block") * 50 + F.size("l")).alias("end_line"), F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text_md5"))


def packed_sentences(spark, sf_dir):
    """Greedy packing of each text's sentences into groups of at most 64 words, by a fold over the array."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    units = F.transform(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != ""), lambda x: F.size(F.split(F.trim(x), r"\s+")))
    start = F.struct(F.array().cast("array<int>").alias("sizes"), F.lit(0).alias("held"))
    step = lambda acc, n: F.when((acc["held"] + n > 64) & (acc["held"] > 0), F.struct(F.concat(acc["sizes"], F.array(acc["held"])).alias("sizes"), n.alias("held"))).otherwise(F.struct(acc["sizes"].alias("sizes"), (acc["held"] + n).alias("held")))
    done = F.aggregate(units, start, step, lambda acc: F.concat(acc["sizes"], F.when(acc["held"] > 0, F.array(acc["held"])).otherwise(F.array().cast("array<int>"))))
    return docs.select("doc_id", F.posexplode(done).alias("group", "words"))


QUERIES = {f.__name__: f for f in (parsed_pieces, parse_failures, call_graph, foreign_key_graph, detected_formats, parent_backfill, line_blocks, packed_sentences)}

SQL = {
    "parent_backfill": r"""WITH c AS (SELECT chunk_id, min(source_id) AS source_id, min(position_path) AS position_path FROM chunks GROUP BY 1),
h AS (SELECT source_id, position_path AS above, max(chunk_id) AS parent_by_path FROM c WHERE position_path <> '' GROUP BY ALL)
SELECT chunk_id, parent_by_path FROM (SELECT *, regexp_extract(position_path, '^(.*) > ', 1) AS above FROM c) JOIN h USING (source_id, above) WHERE parent_by_path <> chunk_id""",
    "line_blocks": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, pos // 50 AS block, min(pos) + 1 AS start_line, max(pos) + 1 AS end_line, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM l GROUP BY ALL""",
}
