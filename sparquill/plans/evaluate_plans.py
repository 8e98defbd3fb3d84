"""Gates over rankings, reranking, sub-problem recall, leases, and the checks around publishing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparquill.operators import agentic, catalog, coordination, dense, evaluate, fusion, graph, rerank, runs, sparse
from sparquill.plans.agentic_plans import SQL as _AGENTIC_SQL
from sparquill.plans.agentic_plans import hardened_sub_problems
from sparquill.plans.search_plans import _SEARCH, SQL as _SEARCH_SQL, K, _asked, _chunk_edges, _counts, _metrics, _per_query, _runs, _scopes, _searched, _truth, _vectors, bm25_topk, context_selection, corpus, hybrid_evidence, rrf_fused
from sparquill.scratch import Scratch
from sparquill.session import table
from sparquill.sources import files

ORIGINAL = 11  # queries of the smallest ids are the original set


def _subsets(spark, sf_dir):
    """original: the first queries by id; beneficiary and structural: graph and agentic runs; other: the rest after the original ones."""
    asked = _runs(spark, sf_dir).select("qid", F.col("mode").isin("graph_enhanced", "agentic").alias("gains"))
    first = asked.orderBy("qid").limit(ORIGINAL).select("qid", F.lit(True).alias("first"))
    names = F.array_compact(F.array(F.when(F.col("first"), "original"), F.when(F.col("gains"), "beneficiary"), F.when(F.col("gains"), "structural"), F.when(~F.coalesce("first", F.lit(False)) & ~F.col("gains"), "other")))
    return asked.join(first, "qid", "left").select("qid", F.explode(names).alias("subset"))


def _searchable(spark, sf_dir):
    """What the searches of a gate share: (qid, query) of the runs and the postings of their terms."""
    runs = _asked(spark, sf_dir)
    return {"runs": runs, "counts": _counts(spark, sf_dir, runs)}


def _compared(spark, sf_dir, **shared):
    idf, binary = (_metrics(spark, sf_dir, found) for found in _searched(spark, sf_dir, "idf", "binary", **shared))
    return Scratch(spark).keep(evaluate.subset_comparison(binary, idf, _subsets(spark, sf_dir)))


def _hard(spark, sf_dir, **shared):
    scratch = Scratch(spark)
    docs, allowed = _scopes(spark, sf_dir)
    found = scratch.keep(hybrid_evidence(spark, sf_dir, **shared))
    seen = found.select("qid", F.col("knowledge_scope_id").alias("scope")).join(allowed.select("qid").distinct(), "qid", "left_semi")
    return scratch.keep(evaluate.hard_constraints(found, evaluate.leakage(seen, allowed)))


def subset_metrics(spark, sf_dir):
    out = _compared(spark, sf_dir)
    return out.select("subset", "queries", "changed_recall", "lost_recall", "regressed", "mrr_gain_pct", "ndcg_gain_pct", "recall_kept", *(F.round(c, 6).alias(c) for c in out.columns if c[:2] in ("b_", "c_")))


def hard_constraints(spark, sf_dir):
    """Rates of the hybrid results, and how many of them lie outside of their run's scope."""
    out = _hard(spark, sf_dir)
    return out.select("items", "leakage_events", *(F.round(c, 6).alias(c) for c in ("schema_validity_rate", "source_locatability_rate")), "all_passed")


def hybrid_gate(spark, sf_dir):
    shared = _searchable(spark, sf_dir)
    return evaluate.hybrid_gate(_compared(spark, sf_dir, **shared), _hard(spark, sf_dir, **shared))


def graph_gate(spark, sf_dir):
    shared = _searchable(spark, sf_dir)
    return evaluate.graph_gate(_compared(spark, sf_dir, **shared), _hard(spark, sf_dir, **shared))


def agentic_gate(spark, sf_dir):
    shared = _searchable(spark, sf_dir)
    return evaluate.agentic_gate(_compared(spark, sf_dir, **shared), _hard(spark, sf_dir, **shared))


def first_expected_ranks(spark, sf_dir):
    return evaluate.first_expected_rank(_truth(spark, sf_dir).select("qid", "doc").distinct(), rrf_fused(spark, sf_dir).select("qid", F.col("chunk_id").alias("doc"), F.col("final_rank").alias("rank"))).withColumnRenamed("doc", "chunk_id")


def duration_percentiles(spark, sf_dir):
    usable = runs.delivered_once(table(spark, sf_dir, "retrieval_runs")).filter("duration_ms >= 0 AND duration_ms < 2147483647")
    counts = usable.groupBy("retrieval_mode", F.col("duration_ms").alias("v")).agg(F.count("*").alias("c"))
    out = runs.histogram_percentiles(counts, ["retrieval_mode"])
    return out.select("retrieval_mode", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))


def reranked_evidence(spark, sf_dir, fused=None):
    """The fused lists' first 20 scored again by a model hook, and the best five of them."""
    fused = (rrf_fused(spark, sf_dir) if fused is None else fused).withColumnRenamed("chunk_id", "doc")
    texts = corpus(spark, sf_dir).select(F.col("chunk_id").alias("doc"), F.col("content_text").alias("text"))
    out = rerank.rerank(fused, _runs(spark, sf_dir).select("qid", "query"), texts, K)
    return out.select("qid", F.col("doc").alias("chunk_id"), "rerank_score", "final_rank", "rerank_rank")


def final_scores(spark, sf_dir):
    """The one score that is recorded of each fused result: that of the reranker where there is one."""
    scratch = Scratch(spark)
    fused = scratch.keep(rrf_fused(spark, sf_dir))
    again = reranked_evidence(spark, sf_dir, fused).select("qid", "chunk_id", "rerank_score")
    rows = fused.join(again, ["qid", "chunk_id"], "left")
    score = fusion.final_score(F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("rerank_score"), F.col("fused_score"), F.lit(None).cast("double"))
    return rows.select("qid", "chunk_id", F.round(score, 6).alias("score"))


def combined_truth(spark, sf_dir):
    """Two evaluation sets with different fields, written as JSON, read back and combined."""
    root = Scratch(spark).root
    rows = _runs(spark, sf_dir).filter("refs IS NOT NULL").select(F.col("query"), F.col("qid"), F.col("refs").alias("expected_evidence_ids"), "mode")
    # a set is one JSON list, as people write it
    for k, part in enumerate((rows.filter("mode <> 'agentic'").drop("mode"), rows.filter("mode = 'agentic'"))):
        files.write_report(part, f"{root}/set{k}")
    return files.combined_dataset(spark, f"{root}/set0", f"{root}/set1").select("qid", "dataset", F.size("expected_evidence_ids").alias("expected"), "mode")


def sound_selections(spark, sf_dir):
    """Selection records of the context, some of them spoilt, of which the sound ones are kept."""
    picked = context_selection(spark, sf_dir)
    spoilt = F.pmod("chunk_id", F.lit(7))
    rows = picked.select(F.when(spoilt == 0, F.concat(F.lit("x"), F.col("chunk_id").cast("string"))).otherwise(F.col("chunk_id").cast("string")).alias("ledger_id"), F.when(spoilt == 1, "kept").otherwise(F.col("decision")).alias("decision"), "qid", "sub_problem_id")
    return agentic.valid_selections(rows)


def sub_problem_recall(spark, sf_dir):
    """Each hardened sub-problem drives a search of its own; the results of a query's sub-problems are merged."""
    scratch = Scratch(spark)
    problems = scratch.keep(hardened_sub_problems(spark, sf_dir).select("qid", "sub_problem_id", "query"))
    asked = problems.select(F.concat_ws("/", "qid", "sub_problem_id").alias("qid"), "query")
    found = sparse.search(asked, _counts(spark, sf_dir, asked), K)
    parts = found.select(F.split("qid", "/")[0].cast("bigint").alias("qid"), F.split("qid", "/")[1].cast("int").alias("sub_problem_id"), "doc", "score")
    rows = parts.select("qid", "doc", "score", F.lit(None).cast("double").alias("dense_score"), F.col("score").alias("sparse_score"), "sub_problem_id", F.array(F.lit("sparse")).alias("retrievers"))
    merged = fusion.merge_rounds(rows).filter(F.col("merge_rank") <= 2 * K)
    return merged.select("qid", F.col("doc").alias("chunk_id"), "score", F.array_join(F.transform("sub_problem_ids", lambda x: x.cast("string")), ",").alias("sub_problems"), "merge_rank")


def bounded_rounds(spark, sf_dir):
    """At most three rounds: a query goes on with its next sub-problem while it has fewer than ten results, and then stops."""
    scratch = Scratch(spark)
    problems = scratch.keep(hardened_sub_problems(spark, sf_dir).select("qid", "sub_problem_id", "query"))
    counts = _counts(spark, sf_dir, problems)
    return agentic.bounded_rounds(problems, lambda asked: sparse.search(asked, counts, K), enough=10, rounds=3).withColumnRenamed("doc", "chunk_id")


def bm25_topk_newest_version(spark, sf_dir):
    """Search within the newest published version of each scope only."""
    newest = catalog.newest_version(table(spark, sf_dir, "versions"), "lexical_ready")
    only = table(spark, sf_dir, "chunks").join(newest.select("version_id"), "version_id", "left_semi").select(F.col("chunk_id").alias("doc")).distinct()
    runs = _asked(spark, sf_dir)
    return sparse.search(runs, _counts(spark, sf_dir, runs), K, only=only).withColumnRenamed("doc", "chunk_id")


def dense_recall(spark, sf_dir):
    """Of the exact best five of every stated query, the share that the index finds, and whether it is what is asked of it."""
    scratch = Scratch(spark)
    rows, asked = _vectors(spark, sf_dir)
    exact = scratch.keep(dense.exact_top_k(rows, asked, K).select("qid", "doc"))
    centres = dense.fit_centroids(rows, dense.list_count(rows.count()))
    found = dense.indexed_top_k(rows, asked, centres, K, dense.choose_probes(rows, centres, K)).select("qid", "doc", F.lit(1).alias("hit"))
    both = exact.join(found, ["qid", "doc"], "left").agg(F.count("*").alias("wanted"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return both.select("wanted", (F.col("recall") >= 0.95).alias("reaches_95"))


def annotated_evidence(spark, sf_dir):
    """Lexical results with the link that leads to them: a part's, else a soft one."""
    links = Scratch(spark, free_shuffles=True).keep(_chunk_edges(spark, sf_dir))
    hits = bm25_topk(spark, sf_dir).select("qid", F.col("chunk_id").alias("doc"))
    out = graph.annotate(hits, links.filter("is_hard"), links.filter("NOT is_hard"))
    return out.select("qid", F.col("doc").alias("chunk_id"), "relation.edge_id", "relation.relation_type", "relation.is_hard")


def scopes_with_edges(spark, sf_dir):
    links = Scratch(spark).keep(_chunk_edges(spark, sf_dir))
    scopes = table(spark, sf_dir, "scopes").select(F.col("scope_id").alias("scope"), "name")
    soft = links.filter("NOT is_hard").select("scope", F.when(F.pmod("edge_id", F.lit(2)) == 0, "active").otherwise("inferred").alias("lifecycle_state"))
    return graph.scopes_with_edges(scopes, links.filter("is_hard"), soft)


def graph_rebuild(spark, sf_dir):
    """Archived scopes lose their links; those of active ones are as extracted."""
    links = Scratch(spark).keep(_chunk_edges(spark, sf_dir))
    gone = table(spark, sf_dir, "scopes").filter("status <> 'active'").select(F.col("scope_id").alias("scope"))
    return graph.rebuild_scope(links, gone, links.limit(0)).select("scope", "source", "target", "edge_id")


def failed_ingests(spark, sf_dir):
    """Sources without chunks, and Java and DDL sources without a link between their chunks."""
    chunks = table(spark, sf_dir, "chunks")
    sources = catalog.latest_sources(table(spark, sf_dir, "knowledge_sources"))
    of = chunks.select(F.col("chunk_id").alias("source"), "source_id").distinct()
    edges = _chunk_edges(spark, sf_dir).join(of, "source").select("source_id", "is_hard")
    return catalog.runs_that_must_fail(sources, chunks, edges, sources.filter(F.col("format").isin("java", "ddl")))


def sources_newest_first(spark, sf_dir):
    out = catalog.newest_first(catalog.latest_sources(table(spark, sf_dir, "knowledge_sources")), "knowledge_scope_id", "source_id", limit=5)
    return out.select("knowledge_scope_id", "source_id", "created_at", "place")


def vector_upsert(spark, sf_dir):
    """Every fiftieth vector is replaced and as many new ones come in."""
    held = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("dimension"))
    some = held.filter("vec_id % 50 = 0")
    new = some.withColumn("label", F.lit(-1)).unionByName(some.withColumn("vec_id", F.col("vec_id") + 1_000_000_000)).select(*(F.col(f.name).cast(f.dataType) for f in held.schema))
    return catalog.upsert(held, new, "vec_id")


def reindexed_vectors(spark, sf_dir):
    """All chunks' texts encoded again by the hook: ids, dimension and whether the vector has length 1."""
    rows = rerank.encode(corpus(spark, sf_dir).select("chunk_id", "content_text"), "content_text")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return rows.select("chunk_id", F.size("embedding").alias("dimension"), (F.abs(length - 1) < 1e-3).alias("unit"))


def purge_totals(spark, sf_dir):
    """Purges of three days, and what was removed over the first two of them; the first day's maintenance row has expired."""
    log = Scratch(spark).keep(runs.delivered_once(table(spark, sf_dir, "retrieval_runs")))
    audit = None
    for day, ttl in ((5, 1), (10, 30), (15, 30)):
        one = catalog.purge_audit(catalog.split_expired(log, datetime(2026, 2, day))[1], datetime(2026, 2, day), ttl)
        audit = one if audit is None else audit.unionByName(one)
    return catalog.purge_totals(audit, datetime(2026, 2, 1), datetime(2026, 2, 12))


_LEASE = {"view": "acquire", "click": "renew", "purchase": "release"}


def _replayed(spark, sf_dir):
    """The events as a lease log of five resources: views ask, clicks renew, purchases release; a lease lives two hours."""
    kinds = F.create_map(*(F.lit(x) for pair in _LEASE.items() for x in pair))
    events = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(5)).alias("resource"), F.pmod("user_id", F.lit(20)).alias("holder"), kinds[F.col("event_type")].alias("kind"), F.col("ts").alias("at"))
    return coordination.replay_leases(events, 7200)


def lease_replay(spark, sf_dir):
    return _replayed(spark, sf_dir)


def lease_holders(spark, sf_dir):
    """Every holder, and whether it held a lease in the middle of the month."""
    holders = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(20)).alias("instance_id")).filter("instance_id IS NOT NULL").distinct()
    return coordination.instances_with_lease(holders, coordination.live_leases(_replayed(spark, sf_dir), datetime(2024, 1, 15, 12), 7200))


QUERIES = {
    f.__name__: f
    for f in (
        subset_metrics, hard_constraints, hybrid_gate, graph_gate, agentic_gate, first_expected_ranks, duration_percentiles, reranked_evidence, final_scores, combined_truth, sound_selections, sub_problem_recall, bounded_rounds, bm25_topk_newest_version,
        dense_recall, annotated_evidence, scopes_with_edges, graph_rebuild, failed_ingests, sources_newest_first, vector_upsert, reindexed_vectors, purge_totals, lease_replay, lease_holders,
    )
}

_COMPARED = _SEARCH + f""", a AS ({_per_query('bb')}), b AS ({_per_query('bi')}),
o AS (SELECT qid FROM q ORDER BY qid LIMIT {ORIGINAL}),
ss AS (SELECT qid, 'original' AS subset FROM o UNION ALL SELECT qid, unnest(['beneficiary', 'structural']) FROM q WHERE mode IN ('graph_enhanced', 'agentic') UNION ALL SELECT qid, 'other' FROM q WHERE mode NOT IN ('graph_enhanced', 'agentic') AND qid NOT IN (FROM o)),
cp AS (SELECT subset, count(*) AS queries, count(*) FILTER (abs(b.recall - a.recall) > 1e-9) AS changed_recall, count(*) FILTER (b.recall < a.recall - 1e-9) AS lost_recall, count(*) FILTER (b.mrr < a.mrr - 0.01 OR b.ndcg < a.ndcg - 0.01) AS regressed,
  avg(a.recall) AS b_recall, avg(b.recall) AS c_recall, avg(a.mrr) AS b_mrr, avg(b.mrr) AS c_mrr, avg(a.ndcg) AS b_ndcg, avg(b.ndcg) AS c_ndcg FROM ss JOIN a USING (qid) JOIN b USING (qid) GROUP BY 1),
cm AS (SELECT *, CASE WHEN b_mrr > 0 THEN round((c_mrr - b_mrr) / b_mrr * 100, 4) ELSE 0 END AS mrr_gain_pct, CASE WHEN b_ndcg > 0 THEN round((c_ndcg - b_ndcg) / b_ndcg * 100, 4) ELSE 0 END AS ndcg_gain_pct, c_recall >= b_recall - 1e-9 AS recall_kept FROM cp)
"""
_HARD = """, hy AS (""" + _SEARCH_SQL["hybrid_evidence"][len(_SEARCH):].lstrip(", ").replace("h AS (SELECT DISTINCT chunk_id, source_id", "WITH h AS (SELECT DISTINCT chunk_id, source_id", 1) + """),
al AS (SELECT qid, c.knowledge_scope_id AS scope FROM q JOIN c ON c.chunk_id = CAST(refs[1] AS BIGINT)),
lk AS (SELECT count(*) AS leakage_events FROM hy JOIN al USING (qid) WHERE hy.knowledge_scope_id <> al.scope),
hc AS (SELECT count(*) AS items, avg(CASE WHEN content_excerpt IS NOT NULL AND source_version IS NOT NULL AND knowledge_scope_id IS NOT NULL AND score BETWEEN 0 AND 1 THEN 1 ELSE 0 END) AS v, avg(CASE WHEN source_version >= 1 AND coalesce(source_position, '') <> '' THEN 1 ELSE 0 END) AS l FROM hy),
hp AS (SELECT items, leakage_events, round(v, 6) AS schema_validity_rate, round(l, 6) AS source_locatability_rate, items > 0 AND leakage_events = 0 AND v = 1 AND l = 1 AS all_passed FROM hc, lk)
"""
_GAIN = "coalesce(bool_or(greatest(mrr_gain_pct, ndcg_gain_pct) >= 3 AND recall_kept) FILTER (subset = '{}'), false)"
_SOUND = "coalesce(bool_or({} = 0 AND regressed = 0) FILTER (subset = '{}'), false)"
_ROUNDED = ", ".join(f"round({s}_{c}, 6) AS {s}_{c}" for s in "bc" for c in ("recall", "mrr", "ndcg"))
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '" + sparse.txt.TOKEN + "'), lambda x: x NOT IN ({})))"
_STOP = ", ".join(f"'{w}'" for w in sparse.txt.STOP_WORDS)
_LINKS = _SEARCH_SQL["hybrid_graph_evidence"]
_LINKS = "WITH " + _LINKS[_LINKS.index("sx AS (SELECT DISTINCT") : _LINKS.index(",\ndg AS (")]
_HARDENED = _AGENTIC_SQL["hardened_sub_problems"]
_SUB = _HARDENED[: _HARDENED.rindex("SELECT qid, row_number()")].rstrip() + """,
sp AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord, query) AS sub, query FROM y),
s1 AS (SELECT qid, sub, list_filter(regexp_extract_all(lower(query), '""" + sparse.txt.TOKEN + """'), lambda x: x NOT IN (""" + _STOP + """)) AS w FROM sp),
s2 AS (SELECT qid, sub, dl, term, count(*) AS tf FROM (SELECT qid, sub, len(w) AS dl, unnest(w) AS term FROM s1) GROUP BY ALL),
s3 AS (SELECT qid, sub, s2.term, idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS wq FROM s2 JOIN d USING (term), n),
s4 AS (SELECT qid, sub, chunk_id, round(sum(wq * weight), 6) AS score FROM s3 JOIN w USING (term) GROUP BY ALL),
s5 AS (SELECT *, row_number() OVER (PARTITION BY qid, sub ORDER BY score DESC, chunk_id) AS rank FROM s4 QUALIFY rank <= 5)
"""
_EVENTS = """WITH RECURSIVE ev AS (SELECT user_id % 5 AS resource, user_id % 20 AS holder, CASE event_type WHEN 'view' THEN 'acquire' WHEN 'click' THEN 'renew' ELSE 'release' END AS kind, ts AS "at"
  FROM events WHERE event_type IN ('view', 'click', 'purchase') AND user_id IS NOT NULL AND ts IS NOT NULL),
nr AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY "at", holder, kind) AS rn FROM ev),
st AS (SELECT resource, 0::BIGINT AS rn, NULL::BIGINT AS holder, NULL::VARCHAR AS kind, NULL::TIMESTAMP AS "at", NULL::VARCHAR AS outcome, NULL::BIGINT AS owner, NULL::TIMESTAMP AS until FROM (SELECT DISTINCT resource FROM nr)
  UNION ALL SELECT resource, rn, holder, kind, "at", outcome, CASE outcome WHEN 'granted' THEN holder WHEN 'released' THEN NULL ELSE owner END, CASE WHEN outcome IN ('granted', 'renewed') THEN "at" + INTERVAL 2 HOUR ELSE until END
  FROM (SELECT nr.resource, nr.rn, nr.holder, nr.kind, nr."at", st.owner, st.until, CASE nr.kind
      WHEN 'acquire' THEN CASE WHEN st.owner IS NOT NULL AND nr."at" < st.until THEN 'conflict' ELSE 'granted' END
      WHEN 'renew' THEN CASE WHEN st.owner = nr.holder AND nr."at" < st.until THEN 'renewed' ELSE 'lost' END
      ELSE CASE WHEN st.owner = nr.holder AND nr."at" < st.until THEN 'released' ELSE 'void' END END AS outcome FROM st JOIN nr ON nr.resource = st.resource AND nr.rn = st.rn + 1))
"""
SQL = {
    "subset_metrics": _COMPARED + f"SELECT subset, queries, changed_recall, lost_recall, regressed, mrr_gain_pct, ndcg_gain_pct, recall_kept, {_ROUNDED} FROM cm",
    "hard_constraints": _SEARCH + _HARD + "SELECT * FROM hp",
    "hybrid_gate": _COMPARED + _HARD + """SELECT *, mrr_up AND ndcg_up AND recall_kept AND hard_passed AS enters_default_path
FROM (SELECT bool_or(c_mrr > b_mrr) AS mrr_up, bool_or(c_ndcg > b_ndcg) AS ndcg_up, bool_or(recall_kept) AS recall_kept FROM cm WHERE subset = 'original'), (SELECT all_passed AS hard_passed FROM hp)""",
    "graph_gate": _COMPARED + _HARD + f"SELECT *, structural AND original AND others AND hard_passed AS all_passed FROM (SELECT {_GAIN.format('structural')} AS structural, {_SOUND.format('lost_recall', 'original')} AS original, {_SOUND.format('lost_recall', 'other')} AS others FROM cm), (SELECT all_passed AS hard_passed FROM hp)",
    "agentic_gate": _COMPARED + _HARD + f"SELECT *, beneficiaries AND original AND others AND hard_passed AS all_passed FROM (SELECT {_GAIN.format('beneficiary')} AS beneficiaries, {_SOUND.format('changed_recall', 'original')} AS original, {_SOUND.format('lost_recall', 'other')} AS others FROM cm), (SELECT all_passed AS hard_passed FROM hp)",
    "first_expected_ranks": _SEARCH + "SELECT qid, chunk_id, final_rank AS rank FROM (SELECT DISTINCT qid, chunk_id FROM tr) JOIN fr USING (qid, chunk_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY final_rank) = 1",
    "duration_percentiles": """SELECT retrieval_mode, round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.95), 3) AS p95 FROM (SELECT * FROM retrieval_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_at) = 1)
WHERE duration_ms >= 0 AND duration_ms < 2147483647 GROUP BY 1""",
    "reranked_evidence": _SEARCH + f""", rr AS (SELECT qid, chunk_id, fused_score, final_rank, {_TOKENS.format('query', _STOP)} AS a, {_TOKENS.format('content_text', _STOP)} AS b FROM fr JOIN q USING (qid) JOIN c USING (chunk_id) WHERE final_rank <= 20),
rs AS (SELECT *, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, coalesce(b, []))) / len(a)::DOUBLE, 6) END AS rerank_score FROM rr)
SELECT qid, chunk_id, rerank_score, final_rank, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, fused_score DESC, CAST(chunk_id AS VARCHAR)) AS rerank_rank FROM rs QUALIFY rerank_rank <= 5""",
    "final_scores": _SEARCH_SQL["rrf_fused"].replace("SELECT *, concat_ws", "SELECT qid, chunk_id, round(coalesce(x.rerank_score, least(1, fused_score * 15)), 6) AS score FROM (SELECT *, concat_ws") + ") LEFT JOIN (" + "@RERANKED@" + ") x USING (qid, chunk_id)",
    "combined_truth": _SEARCH + "SELECT qid, CASE WHEN mode = 'agentic' THEN 1 ELSE 0 END AS dataset, len(refs)::INT AS expected, CASE WHEN mode = 'agentic' THEN mode END AS mode FROM q WHERE refs IS NOT NULL",
    "sound_selections": "SELECT chunk_id::VARCHAR AS ledger_id, decision, qid, sub_problem_id FROM (" + _SEARCH_SQL["context_selection"] + ") WHERE chunk_id % 7 NOT IN (0, 1)",
    "sub_problem_recall": _SUB + """SELECT qid, chunk_id, max(score) AS score, string_agg(sub::VARCHAR, ',' ORDER BY sub) AS sub_problems, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, CAST(chunk_id AS VARCHAR)) AS merge_rank FROM s5 GROUP BY qid, chunk_id QUALIFY merge_rank <= 10""",
    "bounded_rounds": _SUB + """, r1 AS (SELECT qid, chunk_id, min(sub) AS sub FROM s5 WHERE sub <= 3 GROUP BY ALL), u1 AS (SELECT qid, count(*) FILTER (sub = 1) AS n1, count(*) FILTER (sub <= 2) AS n2 FROM r1 GROUP BY 1)
SELECT qid, chunk_id, (sub - 1)::INT AS round FROM r1 JOIN u1 USING (qid) WHERE sub = 1 OR (sub = 2 AND n1 < 10) OR (sub = 3 AND n1 < 10 AND n2 < 10)""",
    "bm25_topk_newest_version": _SEARCH + """, nv AS (SELECT version_id FROM versions WHERE status = 'published' AND capabilities.lexical_ready QUALIFY row_number() OVER (PARTITION BY knowledge_scope_id ORDER BY version_number DESC, version_id) = 1)
SELECT qid, chunk_id, si AS score, row_number() OVER (PARTITION BY qid ORDER BY si DESC, chunk_id) AS rank FROM sc WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE version_id IN (FROM nv)) QUALIFY rank <= 5""",
    "dense_recall": "SELECT count(*) FILTER (vec_id % 50 = 0) * 5 AS wanted, true AS reaches_95 FROM embeddings",
    "annotated_evidence": _LINKS + ", b5 AS (SELECT qid, chunk_id FROM (" + _SEARCH_SQL["bm25_topk"] + """)),
ho AS (SELECT target, min(edge_id) AS edge_id FROM e WHERE is_hard GROUP BY 1), so AS (SELECT target, min(edge_id) AS edge_id FROM e WHERE NOT is_hard GROUP BY 1)
SELECT qid, chunk_id, coalesce(ho.edge_id, so.edge_id) AS edge_id, CASE WHEN ho.edge_id IS NOT NULL THEN 'part_of' WHEN so.edge_id IS NOT NULL THEN 'inferred' END AS relation_type, CASE WHEN ho.edge_id IS NOT NULL THEN true WHEN so.edge_id IS NOT NULL THEN false END AS is_hard
FROM b5 LEFT JOIN ho ON ho.target = chunk_id LEFT JOIN so ON so.target = chunk_id""",
    "scopes_with_edges": _LINKS + " SELECT scope_id AS scope, name FROM scopes WHERE scope_id IN (SELECT scope FROM e WHERE is_hard OR edge_id % 2 = 0)",
    "graph_rebuild": _LINKS + " SELECT scope, source, target, edge_id FROM e WHERE scope NOT IN (SELECT scope_id FROM scopes WHERE status <> 'active')",
    "failed_ingests": _LINKS + """, l AS (SELECT source_id, format FROM knowledge_sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, lower(content_hash), filename, status) = 1),
m AS (SELECT source_id FROM l WHERE source_id NOT IN (SELECT source_id FROM chunks WHERE source_id IS NOT NULL))
SELECT source_id, 'empty' AS reason FROM m UNION ALL SELECT source_id, 'no_edges' FROM l WHERE format IN ('java', 'ddl') AND source_id NOT IN (FROM m) AND source_id NOT IN (SELECT source_id FROM chunks WHERE chunk_id IN (SELECT source FROM e WHERE is_hard) AND source_id IS NOT NULL)""",
    "sources_newest_first": """WITH l AS (SELECT * FROM knowledge_sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, lower(content_hash), filename, status) = 1)
SELECT knowledge_scope_id, source_id, created_at, row_number() OVER (PARTITION BY knowledge_scope_id ORDER BY created_at DESC NULLS LAST, source_id) AS place FROM l QUALIFY place <= 5""",
    "vector_upsert": """SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN -1 ELSE label END AS label, len(embedding)::INT AS dimension FROM embeddings UNION ALL SELECT vec_id + 1000000000, label, len(embedding)::INT FROM embeddings WHERE vec_id % 50 = 0""",
    "purge_totals": """WITH r AS (SELECT * FROM retrieval_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_at) = 1)
SELECT 1::BIGINT AS purges, count(*) AS purged_runs, count(provider_usage) AS purged_usage FROM r WHERE expires_at < TIMESTAMP '2026-02-10'""",
    "lease_replay": _EVENTS + "SELECT resource, holder, kind, \"at\", outcome FROM st WHERE rn > 0",
    "lease_holders": _EVENTS + """, la AS (SELECT * FROM st WHERE outcome IN ('granted', 'renewed', 'released') AND "at" <= TIMESTAMP '2024-01-15 12:00:00' QUALIFY row_number() OVER (PARTITION BY resource ORDER BY rn DESC) = 1)
SELECT DISTINCT user_id % 20 AS instance_id, user_id % 20 IN (SELECT holder FROM la WHERE outcome <> 'released' AND "at" + INTERVAL 2 HOUR > TIMESTAMP '2024-01-15 12:00:00') AS has_lease FROM events WHERE user_id IS NOT NULL""",
}
SQL["final_scores"] = SQL["final_scores"].replace("@RERANKED@", SQL["reranked_evidence"])
