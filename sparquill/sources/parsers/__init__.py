"""Texts of eight formats to structure-aware pieces, one function per format, and the operator that runs them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Piece(NamedTuple):
    content: str
    path: str
    parent_path: str
    kind: str
    start_line: int
    end_line: int
    tokens: int


MAX_TOKENS = 1024


def estimate(text: str) -> int:
    return max(1, -(-len(text) // 4))


def pack(units: list[str], joiner: str, most: int = MAX_TOKENS, size: Callable[[str], int] = estimate) -> list[str]:
    """Units in order, joined into groups of at most ``most`` tokens; a unit above that is a group of its own."""
    groups: list[list[str]] = []
    held = 0
    for unit in units:
        n = size(unit)
        if not groups or held + n > most:
            groups.append([])
            held = 0
        groups[-1].append(unit)
        held += n
    return [joiner.join(g) for g in groups]


def parse(text: str, fmt: str, filename: str = "") -> list[Piece]:
    """Pieces of a text; blank texts have none. Raises ValueError for an unknown format or a text the format refuses."""
    from sparquill.sources.parsers import code, documents, schemas

    by_format: dict[str, Callable[[str, str], list[Piece]]] = {
        "markdown": documents.markdown, "word": documents.word, "pdf": documents.pdf, "java": code.java, "go": code.go, "python": code.python,
        "openapi": schemas.openapi, "ddl": schemas.ddl,
    }
    if fmt not in by_format:
        raise ValueError(f"no parser for the format {fmt!r}")
    return by_format[fmt](text, filename) if text.strip() else []


SCHEMA = "source_id bigint, ord int, content_text string, position_path string, parent_path string, chunk_type string, start_line int, end_line int, token_count int, error string"


def parse_sources(sources: DataFrame) -> DataFrame:
    """Pieces of sources (source_id, format, filename, text), in order; a source that fails has one row with its error.

    A null or blank text fails as empty, as nothing could be published from it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for key, fmt, name, text in zip(pdf["source_id"], pdf["format"], pdf["filename"], pdf["text"]):
                try:
                    pieces = parse(text or "", fmt, name or "")
                    if not pieces:
                        raise ValueError("no pieces: the text is empty or holds nothing of its format")
                    out += [(key, i, p.content, p.path, p.parent_path, p.kind, p.start_line, p.end_line, p.tokens, None) for i, p in enumerate(pieces)]
                except (ValueError, RecursionError) as e:
                    out.append((key, 0, None, None, None, None, None, None, None, str(e)[:500]))
            frame = pd.DataFrame(out, columns=names)
            for c in ("ord", "start_line", "end_line", "token_count"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return sources.select("source_id", "format", "filename", "text").mapInPandas(run, SCHEMA)


def with_ids(pieces: DataFrame) -> DataFrame:
    """Adds chunk_id, a hash of source, path and order (so that a second run gives the same ids), and parent_chunk_id.

    The parent is the last piece of the source whose path is the piece's parent
    path, never the piece itself.
    """
    good = pieces.filter("error IS NULL").withColumn("chunk_id", F.xxhash64("source_id", "position_path", "ord"))
    heads = good.groupBy("source_id", F.col("position_path").alias("parent_path")).agg(F.max_by("chunk_id", "ord").alias("parent_chunk_id"))
    joined = good.join(heads, ["source_id", "parent_path"], "left")
    own = (F.col("parent_path") == "") | (F.col("parent_chunk_id") == F.col("chunk_id"))
    return joined.withColumn("parent_chunk_id", F.when(~F.coalesce(own, F.lit(True)), F.col("parent_chunk_id")))
