"""Words on PDF pages to text in reading order: columns are told apart by the gutters between them.

Input: doc, page, page_width, text, x0, x1, top, one row per word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_GUTTER, MIN_GUTTER_SHARE, MIN_WORDS, LINE_HEIGHT = 12.0, 0.03, 2, 3.0


def columns_of(words: DataFrame) -> DataFrame:
    """Adds col, from 0: a column begins where a word starts at least a gutter behind the end of all words before it, and has two words at least."""
    page = Window.partitionBy("doc", "page").orderBy("x0", "x1", "top", "text")
    before = F.max("x1").over(page.rowsBetween(Window.unboundedPreceding, -1))
    gutter = F.greatest(F.lit(MIN_GUTTER), F.col("page_width") * MIN_GUTTER_SHARE)
    starts = words.withColumn("new", F.coalesce(F.col("x0") - before >= gutter, F.lit(False)).cast("int"))
    islands = starts.withColumn("island", F.sum("new").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    sized = islands.withColumn("least", F.count("*").over(Window.partitionBy("doc", "page", "island")))
    fits = F.min("least").over(Window.partitionBy("doc", "page")) >= MIN_WORDS
    return sized.withColumn("col", F.when(fits, F.col("island")).otherwise(0).cast("int")).drop("new", "island", "least")


def page_texts(words: DataFrame) -> DataFrame:
    """(doc, page, text): lines from top to bottom, column by column; words within three points of the line above are one line."""
    placed = columns_of(words)
    down = Window.partitionBy("doc", "page", "col").orderBy("top", "x0", "text")
    gap = F.coalesce(F.col("top") - F.lag("top").over(down) > LINE_HEIGHT, F.lit(False)).cast("int")
    lined = placed.withColumn("gap", gap).withColumn("line", F.sum("gap").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lined.groupBy("doc", "page", "col", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("s"))
    pages = lines.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("col", "line", "s"))).alias("l"))
    return pages.select("doc", "page", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("text"))


def document_texts(words: DataFrame) -> DataFrame:
    """(doc, text): the pages in order, each after its marker line."""
    pages = page_texts(words).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return pages.select("doc", F.array_join(F.transform("p", lambda x: F.concat(F.lit("=== PAGE "), x["page"].cast("string"), F.lit(" ===\n"), x["text"])), "\n").alias("text"))
