"""Rank lists: reciprocal-rank fusion, tie-breaks, caps per source, merging of rounds, reranking order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIEVERS = ("dense", "sparse", "graph")


def rrf(ranked: DataFrame, k: int = 60, key: str = "qid") -> DataFrame:
    """One row per (key, doc) of rows (key, doc, retriever, rank): the ranks, fused_score = sum 1 / (k + rank), retrievers, final_rank.

    A union and one grouping do what a full outer join of the lists would, with
    one shuffle. Ties: dense, sparse and graph rank, missing ones last, then
    the id as a string.
    """
    ranks = [F.min(F.when(F.col("retriever") == r, F.col("rank"))).alias(f"{r}_rank") for r in RETRIEVERS]
    fused = ranked.groupBy(key, "doc").agg(*ranks)
    total = sum((F.coalesce(1.0 / (F.lit(k) + F.col(f"{r}_rank")), F.lit(0.0)) for r in RETRIEVERS), F.lit(0.0))
    names = F.array_compact(F.array(*(F.when(F.col(f"{r}_rank").isNotNull(), F.lit(r)) for r in RETRIEVERS)))
    w = Window.partitionBy(key).orderBy(F.col("fused_score").desc(), *(F.col(f"{r}_rank").asc_nulls_last() for r in RETRIEVERS), F.col("doc").cast("string"))
    return fused.withColumn("fused_score", F.round(total, 9)).withColumn("retrievers", names).withColumn("final_rank", F.row_number().over(w))


def per_source_cap(ranked: DataFrame, most: int, key: str = "qid", source: str = "source_id", rank: str = "rank") -> DataFrame:
    """The first ``most`` rows of each source in rank order; Catalyst turns this into a group limit."""
    w = Window.partitionBy(key, source).orderBy(rank)
    return ranked.withColumn("in_source", F.row_number().over(w)).filter(F.col("in_source") <= most)


def rerank_order(candidates: DataFrame, key: str = "qid", budget: int = 20) -> DataFrame:
    """Reranks the first ``budget`` of final_rank by rerank_score, fused_score (falling) and the id as a string; the rest is left out."""
    w = Window.partitionBy(key).orderBy(F.col("rerank_score").desc(), F.col("fused_score").desc(), F.col("doc").cast("string"))
    return candidates.filter(F.col("final_rank") <= budget).withColumn("rerank_rank", F.row_number().over(w))


def final_score(dense: Column, sparse: Column, rerank: Column, fused: Column, structure: Column) -> Column:
    """The score for the record: rerank, else min(1, 15 * fused), else the better of dense and sparse, else structure, else 0."""
    return F.coalesce(rerank, F.when(fused > 0, F.least(F.lit(1.0), fused * 15)), F.greatest(dense, sparse), structure, F.lit(0.0))


def retriever_label(retrievers: Column, reranked: Column) -> Column:
    return F.when(reranked, "rerank").when(F.size(retrievers) > 1, "fusion").otherwise(F.coalesce(F.try_element_at(retrievers, F.lit(1)), F.lit("dense")))


def merge_rounds(candidates: DataFrame, key: str = "qid") -> DataFrame:
    """One row per (key, doc) of candidates (key, doc, score, dense_score, sparse_score, sub_problem_id, retrievers).

    The best score's row gives the scores (ties: larger dense, then sparse
    score); sub-problems and retrievers are united; merge_rank orders by score,
    dense and sparse score (falling, missing last) and the id as a string.
    """
    best = F.max(F.struct("score", "dense_score", "sparse_score")).alias("b")
    merged = candidates.groupBy(key, "doc").agg(best, F.sort_array(F.collect_set("sub_problem_id")).alias("sub_problem_ids"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("retrievers")))).alias("retrievers"))
    merged = merged.select(key, "doc", "b.score", "b.dense_score", "b.sparse_score", "sub_problem_ids", "retrievers")
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("dense_score").desc_nulls_last(), F.col("sparse_score").desc_nulls_last(), F.col("doc").cast("string"))
    return merged.withColumn("merge_rank", F.row_number().over(w))


def select_context(candidates: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """Adds decision: the best row of each doc is selected up to k, truncated beyond; its other rows are deduped."""
    mine = Window.partitionBy(key, "doc").orderBy(F.col("score").desc(), "sub_problem_id")
    rows = candidates.withColumn("nth", F.row_number().over(mine))
    among = Window.partitionBy(key, F.col("nth") == 1).orderBy(F.col("score").desc(), F.col("doc").cast("string"))
    place = F.row_number().over(among)
    return rows.withColumn("decision", F.when(F.col("nth") > 1, "deduped").when(place <= k, "selected").otherwise("truncated")).drop("nth")
