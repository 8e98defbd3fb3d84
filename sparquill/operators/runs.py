"""The run log: one row per run, and the metrics over a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the names under which a timing is logged, and the one it is reported by
TIMING_NAMES = {
    "total": "total", "total_ms": "total", "dense": "dense", "dense_ms": "dense", "dense_recall_ms": "dense", "sparse": "sparse", "sparse_ms": "sparse",
    "sparse_recall_ms": "sparse", "fusion": "fusion", "fusion_ms": "fusion", "rerank": "rerank", "rerank_ms": "rerank", "graph": "graph", "graph_ms": "graph",
    "graph_expansion_ms": "graph", "graph_recall_ms": "graph",
}
USAGE = ("embedding_calls", "rerank_calls", "llm_calls", "llm_prompt_chars", "llm_completion_chars")


def delivered_once(runs: DataFrame) -> DataFrame:
    """Each run as logged first; copies of a run differ in logged_at only."""
    w = Window.partitionBy("run_id").orderBy("logged_at")
    return runs.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def between(runs: DataFrame, start, end) -> DataFrame:
    """Runs created in [start, end)."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return runs.filter((F.col("created_at") >= at(start)) & (F.col("created_at") < at(end)))


def request_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("instance_mode", "tool").agg(F.count("*").alias("requests"))


def status_distribution(runs: DataFrame) -> DataFrame:
    return runs.groupBy("instance_mode", "completion_status").agg(F.count("*").alias("requests"))


def histogram_percentiles(counts: DataFrame, by: list[str], value: str = "v", count: str = "c", points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by.., p50, p95, ...): interpolated percentiles of values that are given with how often they occur.

    Histograms add up, and no list of values is held: the two values around a
    rank are those whose running counts enclose it.
    """
    w = Window.partitionBy(*by)
    upto = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("upto", upto).withColumn("n", F.sum(count).over(w))
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col(count) <= rank), F.col(value)))
    out = []
    for p in points:
        rank = (F.col("n") - 1) * F.lit(p)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        out.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"p{round(p * 100)}"))
    return rows.groupBy(*by).agg(*out)


def latency(runs: DataFrame) -> DataFrame:
    """Interpolated p50 and p95 of usable durations by tool, rounded half to even."""
    counts = runs.filter("duration_ms >= 0 AND duration_ms < 2147483647").groupBy("tool", F.col("duration_ms").alias("v")).agg(F.count("*").alias("c"))
    return histogram_percentiles(counts, ["tool"]).select("tool", *(F.bround(p, 0).cast("bigint").alias(f"{p}_ms") for p in ("p50", "p95")))


def timing_medians(runs: DataFrame) -> DataFrame:
    """The upper median of each timing by tool: the value at position floor(n / 2) of the sorted values.

    A histogram of values stands for the list, so that a tool with very many
    runs is not gathered in one row.
    """
    names = F.create_map(*(F.lit(x) for pair in TIMING_NAMES.items() for x in pair))
    each = runs.select("tool", F.explode("subpath_timings").alias("k", "v")).select("tool", names[F.col("k")].alias("subpath"), "v").filter("subpath IS NOT NULL AND v IS NOT NULL")
    counts = each.groupBy("tool", "subpath", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("tool", "subpath")
    upto = F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    return ranked.filter((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") / 2))).select("tool", "subpath", F.bround("v", 0).cast("bigint").alias("p50_ms"))


def usage_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(*(F.coalesce(F.sum(f"provider_usage.{c}"), F.lit(0)).alias(c) for c in USAGE))


def timing_totals(runs: DataFrame) -> DataFrame:
    """Summed milliseconds of each timing over all runs."""
    return runs.select(F.explode("subpath_timings").alias("k", "v")).groupBy("k").agg(F.round(F.sum("v"), 3).alias("total_ms"), F.count("v").alias("runs"))


def late_arrivals(runs: DataFrame) -> DataFrame:
    """Deliveries by whole days between creation and arrival."""
    days = F.floor((F.unix_micros(F.col("logged_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86_400_000_000)).cast("int")
    return runs.groupBy(days.alias("days_late")).agg(F.count("*").alias("deliveries"), F.countDistinct("run_id").alias("runs"))


def evidence_usage(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, runs, first_places, known): how often each chunk was evidence, and whether it is in ``chunks``."""
    used = runs.select("run_id", F.posexplode("evidence_ref_ids").alias("pos", "ref")).select("run_id", "pos", F.expr("try_cast(ref AS bigint)").alias("chunk_id")).filter("chunk_id IS NOT NULL")
    counted = used.groupBy("chunk_id").agg(F.count("*").alias("runs"), F.count_if(F.col("pos") == 0).alias("first_places"))
    there = chunks.select("chunk_id").distinct().withColumn("known", F.lit(True))
    return counted.join(there, "chunk_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def without_body(runs: DataFrame, keep: bool = False) -> DataFrame:
    """The trace with its ids and without the query's text, unless ``keep``."""
    return runs.withColumn("query_text", F.when(F.lit(keep), F.col("query_text"))).withColumn("trace_body_recorded", F.lit(keep))


def scope_check(entries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of entries (chunk_id, knowledge_scope_id, ..): accepted are those whose chunk is of that scope."""
    own = chunks.select("chunk_id", "knowledge_scope_id").distinct()
    keys = ["chunk_id", "knowledge_scope_id"]
    return entries.join(own, keys, "left_semi"), entries.join(own, keys, "left_anti")
