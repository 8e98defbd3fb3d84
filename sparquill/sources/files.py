"""Files in: raw bytes, formats, text extraction, evaluation sets. Tables out: appends and keyed inserts."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: file name endings by format
ENDINGS = {"markdown": ("md", "markdown"), "java": ("java",), "ddl": ("sql", "ddl"), "go": ("go",), "python": ("py",), "word": ("docx",), "pdf": ("pdf",)}
SPEC_ENDINGS = ("json", "yaml", "yml")


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, filename, scope, source, size_bytes, content, content_hash) of files below root/{scope}/{source}/{filename}; empty files have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    parts = F.split("path", "/")
    return files.select(
        "path", F.element_at(parts, -1).alias("filename"), F.try_element_at(parts, F.lit(-3)).alias("scope"), F.try_element_at(parts, F.lit(-2)).alias("source"),
        F.col("length").alias("size_bytes"), "content", F.sha2("content", 256).alias("content_hash"),
    )


def safe_part(name: str) -> str:
    """A path component as given, if it stays within its folder; ValueError otherwise."""
    if not name or name in (".", "..") or re.search(r"[/\\\x00]", name):
        raise ValueError(f"not a plain file name: {name!r}")
    return name


def decode(content) -> F.Column:
    """UTF-8 text; what is not UTF-8 becomes a replacement character."""
    return F.decode(content, "UTF-8")


def detect_format(filename, text) -> F.Column:
    """The format by file name ending, null if none fits.

    JSON and YAML must have an openapi or swagger version at their top level,
    Go files a package clause among the first five lines that are not comments.
    """
    ending = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    spec = text.rlike(r'(?m)^\s*\{?\s*"(?:openapi|swagger)"\s*:|^(?:openapi|swagger)\s*:')
    code = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(?://.*|/\*.*|\*.*)?$"))
    package = F.exists(F.slice(code, 1, 5), lambda x: x.rlike(r"^\s*package\s+\w+"))
    out = F.when(ending.isin(*SPEC_ENDINGS), F.when(spec, "openapi"))
    for fmt, endings in ENDINGS.items():
        out = out.when(ending.isin(*endings), F.when(package, fmt) if fmt == "go" else F.lit(fmt))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Headings as '#' lines, list items as '- ' lines, then the tables' rows as '| a | b |'. ValueError for no or an empty document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ValueError(f"not a Word document: {e}") from e
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    lines: list[str] = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        if not (text := said(p)):
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val") if style is not None else "") or ""
        level = re.fullmatch(r"(?i)heading\s*(\d)", name)
        listed = p.find(f"{_W}pPr/{_W}numPr") is not None or name.lower().startswith("list")
        lines.append(f"{'#' * int(level.group(1))} {text}" if level else f"# {text}" if name.lower() == "title" else f"- {text}" if listed else text)
    for table in body.findall(f"{_W}tbl") if body is not None else ():
        lines += ["| " + " | ".join(said(c) for c in row.findall(f"{_W}tc")) + " |" for row in table.findall(f"{_W}tr")]
    if not lines:
        raise ValueError("the Word document has no text")
    return "\n\n".join(lines)


def extract_docx(files: DataFrame) -> DataFrame:
    """files (path, content, ..) with text and error of Word documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((path, docx_text(content), None))
                except ValueError as e:
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def insert_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table does not hold; of new rows with one key any one is kept."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    try:
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:  # the first write makes the table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries from a JSON list: query, project_scope, expected_evidence_ids and what else there is."""
    return spark.read.option("multiLine", "true").json(path)


def combined_dataset(spark: SparkSession, *paths: str) -> DataFrame:
    sets = [read_dataset(spark, p).withColumn("dataset", F.lit(i)) for i, p in enumerate(paths)]
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write_report(df: DataFrame, path: str) -> None:
    """One JSON list, as ``read_dataset`` reads it; for evaluation sets and reports, which fit a row."""
    df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
