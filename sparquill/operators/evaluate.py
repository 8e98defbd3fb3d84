"""Quality of rankings: recall, MRR and nDCG at k, interpolated percentiles, groups, deltas and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F


def per_query(truth: DataFrame, ranked: DataFrame, k: int = 5, empty_recall: float = 1.0) -> DataFrame:
    """(qid, recall, mrr, ndcg) of truth (qid, doc) and ranked (qid, doc, rank); the queries are those of ``truth``.

    A query without expected documents (a single row with a null doc) has
    ``empty_recall``. MRR looks at all ranks, recall and nDCG at the first k;
    relevance is binary.
    """
    wanted = truth.select("qid", "doc").distinct().withColumn("rel", F.col("doc").isNotNull())
    hits = wanted.join(ranked.select("qid", "doc", "rank"), ["qid", "doc"], "left")
    gain = lambda r: F.log(F.lit(2.0)) / F.log(r + 1)
    each = hits.groupBy("qid").agg(
        F.count_if("rel").alias("n"),
        F.count_if(F.col("rank") <= k).alias("found"),
        F.min("rank").alias("first_rank"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n", F.lit(k))).cast("int")), F.lit(0.0), lambda acc, r: acc + gain(r))
    return each.select(
        "qid", "first_rank",
        F.when(F.col("n") == 0, F.lit(empty_recall)).otherwise(F.col("found") / F.col("n")).alias("recall"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("dcg") / ideal).alias("ndcg"),
    )


def summarise(metrics: DataFrame | GroupedData) -> DataFrame:
    cols = [f(c).alias(f"{n}_{c}") for c in ("recall", "mrr", "ndcg") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return metrics.agg(F.count("*").alias("queries"), *(c for c in cols))


def summarise_by(metrics: DataFrame, column: str) -> DataFrame:
    """All queries (null) and each value of the column, in one pass."""
    grouped = metrics.groupingSets([[], [column]], column)
    return summarise(grouped)


def rank_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, doc, rank_a, rank_b, delta) over the documents of either ranking; delta > 0: better in b."""
    x, y = a.select("qid", "doc", F.col("rank").alias("rank_a")), b.select("qid", "doc", F.col("rank").alias("rank_b"))
    return x.join(y, ["qid", "doc"], "fullouter").withColumn("delta", F.col("rank_a") - F.col("rank_b"))


def gate(baseline: DataFrame, candidate: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row per metric: its means, relative change, non_inferior (not worse by more than the tolerance) and reproducible (within it)."""
    means = lambda df, n: df.agg(*(F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg"))).selectExpr(f"stack(3, 'recall', recall, 'mrr', mrr, 'ndcg', ndcg) as (metric, {n})")
    both = means(baseline, "baseline").join(means(candidate, "candidate"), "metric")
    change = F.try_divide(F.col("candidate") - F.col("baseline"), F.abs("baseline"))
    return both.select("metric", "baseline", "candidate", change.alias("change"), (F.col("candidate") >= F.col("baseline") * (1 - tolerance)).alias("non_inferior"), (F.abs(F.col("candidate") - F.col("baseline")) <= F.abs("baseline") * tolerance).alias("reproducible"))


def leakage(ranked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of ranked (qid, doc, scope) outside the scopes of allowed (qid, scope)."""
    return ranked.join(allowed, ["qid", "scope"], "left_anti")


def first_expected_rank(truth: DataFrame, ranked: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("rank")
    return truth.join(ranked, ["qid", "doc"]).withColumn("n", F.row_number().over(w)).filter("n = 1").select("qid", "doc", "rank")


def subset_comparison(baseline: DataFrame, candidate: DataFrame, subsets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row per subset of subsets (qid, subset), of two ``per_query`` results.

    queries, the means of both sides, mrr and ndcg improvement in per cent of
    the baseline (0 where that is 0), recall_kept (the mean has not fallen), and
    how many queries changed_recall, lost_recall or regressed (MRR or nDCG
    fallen by more than the tolerance).
    """
    a = baseline.select("qid", *(F.col(c).alias(f"b_{c}") for c in ("recall", "mrr", "ndcg")))
    b = candidate.select("qid", *(F.col(c).alias(f"c_{c}") for c in ("recall", "mrr", "ndcg")))
    rows = subsets.select("qid", "subset").distinct().join(a, "qid").join(b, "qid")
    mean = [F.avg(f"{s}_{c}").alias(f"{s}_{c}") for c in ("recall", "mrr", "ndcg") for s in ("b", "c")]
    fell = lambda c, by: F.col(f"c_{c}") < F.col(f"b_{c}") - by
    out = rows.groupBy("subset").agg(
        F.count("*").alias("queries"), F.count_if(F.abs(F.col("c_recall") - F.col("b_recall")) > 1e-9).alias("changed_recall"), F.count_if(fell("recall", 1e-9)).alias("lost_recall"),
        F.count_if(fell("mrr", tolerance) | fell("ndcg", tolerance)).alias("regressed"), *mean,
    )
    gain = lambda c: F.when(F.col(f"b_{c}") > 0, F.round((F.col(f"c_{c}") - F.col(f"b_{c}")) / F.col(f"b_{c}") * 100, 4)).otherwise(F.lit(0.0))
    return out.withColumns({"mrr_gain_pct": gain("mrr"), "ndcg_gain_pct": gain("ndcg"), "recall_kept": F.col("c_recall") >= F.col("b_recall") - 1e-9})


def hard_constraints(evidence: DataFrame, leaked: DataFrame) -> DataFrame:
    """One row: items, leakage_events, schema_validity_rate, source_locatability_rate, all_passed.

    evidence: evidence_id, content_excerpt, source_version, source_position,
    knowledge_scope_id, score, relevance_score. An item is valid if none of its
    fields but the position is null and its scores lie within 0 and 1; it is
    locatable with a version from 1 up and a position. Rates are 0 without
    items, and nothing passes then.
    """
    fields = ("evidence_id", "content_excerpt", "source_version", "knowledge_scope_id", "score", "relevance_score")
    valid = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in fields)) & F.col("score").between(0, 1) & F.col("relevance_score").between(0, 1)
    locatable = (F.col("source_version") >= 1) & (F.coalesce("source_position", F.lit("")) != "")
    n, ok, at = F.count("*"), F.count_if(valid), F.count_if(locatable)
    rates = evidence.agg(n.alias("items"), F.coalesce(F.try_divide(ok, n), F.lit(0.0)).alias("schema_validity_rate"), F.coalesce(F.try_divide(at, n), F.lit(0.0)).alias("source_locatability_rate"))
    both = rates.crossJoin(leaked.agg(F.count("*").alias("leakage_events")))  # one row each
    return both.withColumn("all_passed", (F.col("items") > 0) & (F.col("leakage_events") == 0) & (F.col("schema_validity_rate") == 1) & (F.col("source_locatability_rate") == 1))


def _subset(compared: DataFrame, name: str, *conditions) -> DataFrame:
    """One row of the conditions on the subset's row; all false where it has none."""
    return compared.filter(F.col("subset") == name).agg(*(F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in conditions))


def hybrid_gate(compared: DataFrame, hard: DataFrame, subset: str = "original") -> DataFrame:
    """One row: mrr_up, ndcg_up (strictly), recall_kept, hard_passed, and enters_default_path: all of them."""
    row = _subset(compared, subset, ("mrr_up", F.col("c_mrr") > F.col("b_mrr")), ("ndcg_up", F.col("c_ndcg") > F.col("b_ndcg")), ("recall_kept", F.col("recall_kept")))
    out = row.crossJoin(hard.select(F.col("all_passed").alias("hard_passed")))
    return out.withColumn("enters_default_path", F.col("mrr_up") & F.col("ndcg_up") & F.col("recall_kept") & F.col("hard_passed"))


def graph_gate(compared: DataFrame, hard: DataFrame, least_gain_pct: float = 3.0) -> DataFrame:
    """One row: structural (subset 'structural' gains enough in MRR or nDCG and keeps its recall), original and others (not worse), hard_passed, all_passed."""
    gains = (F.greatest("mrr_gain_pct", "ndcg_gain_pct") >= least_gain_pct) & F.col("recall_kept")
    sound = (F.col("lost_recall") == 0) & (F.col("regressed") == 0)
    out = _subset(compared, "structural", ("structural", gains)).crossJoin(_subset(compared, "original", ("original", sound))).crossJoin(_subset(compared, "other", ("others", sound)))
    out = out.crossJoin(hard.select(F.col("all_passed").alias("hard_passed")))  # one row each
    return out.withColumn("all_passed", F.col("structural") & F.col("original") & F.col("others") & F.col("hard_passed"))


def agentic_gate(compared: DataFrame, hard: DataFrame, least_gain_pct: float = 3.0) -> DataFrame:
    """One row: beneficiaries (subset 'beneficiary' gains enough and keeps its recall), original (no recall changed, nothing regressed), others (no recall lost, nothing regressed), hard_passed, all_passed."""
    gains = (F.greatest("mrr_gain_pct", "ndcg_gain_pct") >= least_gain_pct) & F.col("recall_kept")
    same, sound = (F.col("changed_recall") == 0) & (F.col("regressed") == 0), (F.col("lost_recall") == 0) & (F.col("regressed") == 0)
    out = _subset(compared, "beneficiary", ("beneficiaries", gains)).crossJoin(_subset(compared, "original", ("original", same))).crossJoin(_subset(compared, "other", ("others", sound)))
    out = out.crossJoin(hard.select(F.col("all_passed").alias("hard_passed")))  # one row each
    return out.withColumn("all_passed", F.col("beneficiaries") & F.col("original") & F.col("others") & F.col("hard_passed"))
