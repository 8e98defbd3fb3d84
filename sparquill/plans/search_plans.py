"""Lexical and vector search, fusion and evaluation over chunks, the run log and embeddings.

Queries are the runs whose id is divisible by 50 (for vectors: the vectors
whose id is), each against all rows. Expected documents of a run are its
logged evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.functions import text as txt
from sparquill.operators import dense, evaluate, fusion, graph, sparse
from sparquill.scratch import Scratch, bounded
from sparquill.session import table

K = 5


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk once."""
    return table(spark, sf_dir, "chunks").select("chunk_id", "source_id", "knowledge_scope_id", "content_text").dropDuplicates(["chunk_id"])


def _counts(spark, sf_dir, queries=None):
    """The postings, written once: weights of documents and queries, df and lengths all come from them. With ``queries`` those of their terms only."""
    counts = sparse.term_counts(corpus(spark, sf_dir), "chunk_id", "content_text")
    return Scratch(spark, free_shuffles=True).keep(counts) if queries is None else sparse.kept_counts(counts, queries)


def _runs(spark, sf_dir):
    runs = table(spark, sf_dir, "retrieval_runs").filter("query_text IS NOT NULL AND run_id % 50 = 0")
    return runs.groupBy(F.col("run_id").alias("qid")).agg(F.min("query_text").alias("query"), F.min("evidence_ref_ids").alias("refs"), F.min("retrieval_mode").alias("mode"))


def _asked(spark, sf_dir):
    """(qid, query) of the runs, written once."""
    return Scratch(spark).keep(_runs(spark, sf_dir).select("qid", "query"))


def term_stats(spark, sf_dir):
    stats = sparse.term_stats(_counts(spark, sf_dir))
    return stats.select("term", txt.term_id(F.col("term")).alias("term_id"), "df", F.round("idf", 6).alias("idf"))


def term_stats_by_scope(spark, sf_dir):
    counts = sparse.term_counts(corpus(spark, sf_dir), "chunk_id", "content_text", ["knowledge_scope_id"])
    return sparse.term_stats(counts, ["knowledge_scope_id"]).withColumn("idf", F.round("idf", 6))


def term_stats_by_source(spark, sf_dir):
    counts = sparse.term_counts(corpus(spark, sf_dir), "chunk_id", "content_text", ["source_id"])
    return sparse.term_stats(counts, ["source_id"]).withColumn("idf", F.round("idf", 6))


def doc_weights(spark, sf_dir):
    return sparse.doc_weights(_counts(spark, sf_dir)).select(F.col("doc").alias("chunk_id"), "term", F.round("weight", 6).alias("weight"))


def _searched(spark, sf_dir, *weightings, runs=None, counts=None):
    """The best of each run with each of the weightings, from one pass over the chunks."""
    runs = _asked(spark, sf_dir) if runs is None else runs
    found = sparse.searches(runs, _counts(spark, sf_dir, runs) if counts is None else counts, K, weightings)
    return [found[w].withColumnRenamed("doc", "chunk_id") for w in weightings]


def bm25_topk(spark, sf_dir, weighting="idf"):
    return _searched(spark, sf_dir, weighting)[0]


def bm25_topk_binary(spark, sf_dir):
    return bm25_topk(spark, sf_dir, "binary")


def _scopes(spark, sf_dir):
    """(doc, scope) of the chunks and (qid, scope) of the runs: the scope of a run's first evidence."""
    docs = corpus(spark, sf_dir).select(F.col("chunk_id").alias("doc"), F.col("knowledge_scope_id").alias("scope"))
    first = _runs(spark, sf_dir).filter(F.size("refs") > 0).select("qid", F.col("refs")[0].cast("bigint").alias("doc"))
    return docs, first.join(docs, "doc").select("qid", "scope")


def bm25_topk_scoped(spark, sf_dir):
    docs, allowed = _scopes(spark, sf_dir)
    runs = _asked(spark, sf_dir)
    return sparse.search(runs, _counts(spark, sf_dir, runs), K, scopes=docs, allowed=allowed).withColumnRenamed("doc", "chunk_id")


def scope_leakage(spark, sf_dir):
    """What unscoped search finds outside of a run's scope, by scope."""
    docs, allowed = _scopes(spark, sf_dir)
    found = bm25_topk(spark, sf_dir).withColumnRenamed("chunk_id", "doc").join(docs, "doc").join(allowed.select("qid"), "qid", "left_semi")
    return evaluate.leakage(found, allowed).groupBy("scope").agg(F.count("*").alias("leaked"))


def _truth(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return runs.select("qid", "mode", F.posexplode_outer("refs").alias("pos", "ref")).select("qid", "mode", F.col("ref").cast("bigint").alias("doc"), (F.col("pos") + 1).alias("rank"))


def _lists(spark, sf_dir, found=None):
    """The logged ranking as the dense list and BM25, or what else was found, as the sparse one."""
    logged = _truth(spark, sf_dir).filter("doc IS NOT NULL").groupBy("qid", "doc").agg(F.min("rank").alias("rank")).withColumn("retriever", F.lit("dense"))
    found = bm25_topk(spark, sf_dir) if found is None else found
    lexical = found.select("qid", F.col("chunk_id").alias("doc"), "rank", F.lit("sparse").alias("retriever"))
    return logged.unionByName(lexical)


def rrf_fused(spark, sf_dir):
    fused = fusion.rrf(_lists(spark, sf_dir))
    return fused.select("qid", F.col("doc").alias("chunk_id"), "dense_rank", "sparse_rank", "fused_score", "final_rank", F.array_join("retrievers", "+").alias("retrievers"))


def per_source_cap(spark, sf_dir):
    sources = corpus(spark, sf_dir).select(F.col("chunk_id").alias("doc"), "source_id")
    capped = fusion.per_source_cap(fusion.rrf(_lists(spark, sf_dir)).join(sources, "doc"), 2, rank="final_rank")
    return capped.select("qid", F.col("doc").alias("chunk_id"), "source_id", "final_rank", "in_source")


def hybrid_evidence(spark, sf_dir, runs=None, counts=None):
    """The whole path: search among published versions only, twice k deep, fusion, a cap per source, top k, evidence rows."""
    versions = table(spark, sf_dir, "versions").filter("status = 'published'").select("version_id", "version_number").distinct()
    scopes = table(spark, sf_dir, "scopes").select(F.col("scope_id").alias("knowledge_scope_id"), "scope_type").distinct()
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("doc"), "source_id", "version_id", "knowledge_scope_id", "content_text", "position_path")
    published = chunks.join(versions, "version_id", "left_semi").select("doc")
    runs = _asked(spark, sf_dir) if runs is None else runs
    found = sparse.search(runs, _counts(spark, sf_dir, runs) if counts is None else counts, 2 * K, only=published).withColumnRenamed("doc", "chunk_id")
    fused = fusion.rrf(_lists(spark, sf_dir, found)).join(chunks, "doc").join(versions, "version_id").join(scopes, "knowledge_scope_id", "left")
    capped = fusion.per_source_cap(fused, 5, rank="final_rank")
    best = fusion.per_source_cap(capped, K, source="qid", rank="final_rank")
    return best.select(
        "qid", F.col("doc").cast("string").alias("evidence_id"), txt.excerpt(F.col("content_text")).alias("content_excerpt"), F.col("version_number").alias("source_version"),
        F.col("position_path").alias("source_position"), "knowledge_scope_id", "scope_type", F.round("fused_score", 4).alias("score"), txt.clamp01(F.round("fused_score", 4)).alias("relevance_score"),
    )


def _chunk_edges(spark, sf_dir):
    """Links between chunks: a part and its parent (hard), and neighbours in the evidence of one run (soft), each once."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "parent_chunk_id", "knowledge_scope_id")
    scope = bounded(Scratch(spark).keep(chunks.select(F.col("chunk_id").alias("source"), F.col("knowledge_scope_id").alias("scope")).distinct()))
    there = scope.select(F.col("source").alias("target"), F.col("scope").alias("of"))
    parents = chunks.filter("parent_chunk_id IS NOT NULL AND parent_chunk_id <> chunk_id").select(F.col("chunk_id").alias("source"), F.col("parent_chunk_id").alias("target"), F.lit(True).alias("is_hard"))
    refs = table(spark, sf_dir, "retrieval_runs").filter(F.size("evidence_ref_ids") > 1).select(F.transform("evidence_ref_ids", lambda x: x.cast("bigint")).alias("r"))
    beside = refs.select(F.explode(F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r")), lambda a, b: F.struct(a.alias("source"), b.alias("target")))).alias("p"))
    beside = beside.select("p.source", "p.target", F.lit(False).alias("is_hard")).filter("source <> target")
    both = parents.unionByName(beside).distinct().join(scope, "source").join(there, "target").filter(F.col("scope") == F.col("of"))
    kind = F.when(F.col("is_hard"), "part_of").otherwise("inferred")
    digest = F.substring(F.md5(F.concat_ws("-", "source", "target", "is_hard")), 1, 15)
    return both.select("scope", "source", "target", "is_hard", kind.alias("relation_type"), F.lit("out").alias("direction"), F.conv(digest, 16, 10).cast("bigint").alias("edge_id"))


def hybrid_graph_evidence(spark, sf_dir):
    """Three lists fused: logged and lexical results, and what two hops over chunk links, both ways, reach from them."""
    scratch = Scratch(spark, free_shuffles=True)
    lists = scratch.keep(_lists(spark, sf_dir))
    scope = corpus(spark, sf_dir).select(F.col("chunk_id").alias("doc"), F.col("knowledge_scope_id").alias("scope"))
    seeds = lists.select("qid", "doc").distinct().join(scope, "doc")
    reached = graph.reach(seeds, graph.directed_edges(scratch.keep(_chunk_edges(spark, sf_dir))), 2, 10)
    w = Window.partitionBy("qid").orderBy(F.col("weight").desc(), "hop", "doc")  # a query's scopes share one list
    ranked = reached.select("qid", "doc", F.row_number().over(w).alias("rank"), F.lit("graph").alias("retriever")).filter(F.col("rank") <= 10)
    fused = fusion.rrf(lists.unionByName(ranked))
    return fused.select("qid", F.col("doc").alias("chunk_id"), "dense_rank", "sparse_rank", "graph_rank", "fused_score", "final_rank")


def merged_rounds(spark, sf_dir):
    """Idf-weighted and binary search as two sub-problems of each query."""
    idf, binary = _searched(spark, sf_dir, "idf", "binary")
    one = idf.select("qid", F.col("chunk_id").alias("doc"), "score", F.lit(None).cast("double").alias("dense_score"), F.col("score").alias("sparse_score"), F.lit(1).alias("sub_problem_id"), F.array(F.lit("sparse")).alias("retrievers"))
    two = binary.select("qid", F.col("chunk_id").alias("doc"), "score", F.col("score").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score"), F.lit(2).alias("sub_problem_id"), F.array(F.lit("dense")).alias("retrievers"))
    merged = fusion.merge_rounds(one.unionByName(two))
    return merged.select("qid", F.col("doc").alias("chunk_id"), "score", F.array_join(F.transform("sub_problem_ids", lambda x: x.cast("string")), ",").alias("sub_problems"), F.array_join("retrievers", "+").alias("retrievers"), "merge_rank")


def context_selection(spark, sf_dir):
    one, two = (df.withColumn("sub_problem_id", F.lit(n)).withColumnRenamed("chunk_id", "doc") for n, df in enumerate(_searched(spark, sf_dir, "idf", "binary"), 1))
    picked = fusion.select_context(one.unionByName(two), 3)
    return picked.select("qid", F.col("doc").alias("chunk_id"), "sub_problem_id", "score", "decision")


def _metrics(spark, sf_dir, ranked=None):
    ranked = (bm25_topk(spark, sf_dir) if ranked is None else ranked).withColumnRenamed("chunk_id", "doc")
    return evaluate.per_query(_truth(spark, sf_dir), ranked, K)


def retrieval_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("qid", "first_rank", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


def metrics_by_mode(spark, sf_dir):
    out = evaluate.summarise_by(_metrics(spark, sf_dir).join(_runs(spark, sf_dir).select("qid", "mode"), "qid"), "mode")
    return out.select("mode", "queries", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


def rank_deltas(spark, sf_dir):
    a, b = (df.withColumnRenamed("chunk_id", "doc") for df in _searched(spark, sf_dir, "idf", "binary"))
    return evaluate.rank_deltas(a, b).withColumnRenamed("doc", "chunk_id")


def quality_gate(spark, sf_dir):
    out = evaluate.gate(*(_metrics(spark, sf_dir, found) for found in _searched(spark, sf_dir, "idf", "binary")))
    return out.select("metric", *(F.round(c, 6).alias(c) for c in ("baseline", "candidate", "change")), "non_inferior", "reproducible")


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding", F.col("label").alias("scope"))
    return rows, rows.filter("doc % 50 = 0").withColumnRenamed("doc", "qid")


def dense_topk(spark, sf_dir):
    return dense.exact_top_k(*_vectors(spark, sf_dir), K).withColumnRenamed("doc", "vec_id")


def dense_topk_scoped(spark, sf_dir):
    return dense.exact_top_k(*_vectors(spark, sf_dir), K, scoped=True).withColumnRenamed("doc", "vec_id")


def dense_topk_indexed(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    centres = dense.fit_centroids(rows, dense.list_count(rows.count()))
    return dense.indexed_top_k(rows, asked, centres, K, dense.choose_probes(rows, centres, K)).withColumnRenamed("doc", "vec_id")


def collection_dimension(spark, sf_dir):
    return dense.dimension(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        term_stats, term_stats_by_scope, term_stats_by_source, doc_weights, bm25_topk, bm25_topk_binary, bm25_topk_scoped, scope_leakage, rrf_fused, per_source_cap, hybrid_evidence, hybrid_graph_evidence, merged_rounds,
        context_selection, retrieval_metrics, metrics_by_mode, rank_deltas, quality_gate, dense_topk, dense_topk_scoped, dense_topk_indexed, collection_dimension,
    )
}

_STOP = ", ".join(f"'{w}'" for w in txt.STOP_WORDS)


def _bm25(name: str = "") -> str:
    """CTEs: c chunks, t tokens, n corpus, d (term, df, idf), w document weights, per column ``name`` where one is given."""
    by, on, using = (f"{name}, ", f" AND d.{name} = t.{name}", f"USING ({name})") if name else ("", "", "ON true")
    return f"""
WITH c AS (SELECT chunk_id, min(source_id) AS source_id, min(knowledge_scope_id) AS knowledge_scope_id, min(content_text) AS content_text FROM chunks GROUP BY 1),
l AS (SELECT chunk_id, {by}list_filter(regexp_extract_all(lower(content_text), '{txt.TOKEN}'), lambda x: x NOT IN ({_STOP})) AS w FROM c),
t AS (SELECT chunk_id, {by}dl, term, count(*) AS tf FROM (SELECT chunk_id, {by}len(w) AS dl, unnest(w) AS term FROM l) GROUP BY ALL),
n AS (SELECT {by}count(*) AS n_docs, avg(len(w)) AS avgdl FROM l {f'GROUP BY {name}' if name else ''}),
d AS (SELECT {by}term, df, ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT {by}term, count(*) AS df FROM t GROUP BY ALL) JOIN n {using}),
w AS (SELECT t.chunk_id, t.term, idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS weight FROM t JOIN d ON d.term = t.term{on} JOIN n {'USING (' + name + ')' if name else 'ON true'})
"""


_SEARCH = _bm25() + f""",
q AS (SELECT run_id AS qid, min(query_text) AS query, min(evidence_ref_ids) AS refs, min(retrieval_mode) AS mode FROM retrieval_runs WHERE query_text IS NOT NULL AND run_id % 50 = 0 GROUP BY 1),
ql AS (SELECT qid, list_filter(regexp_extract_all(lower(query), '{txt.TOKEN}'), lambda x: x NOT IN ({_STOP})) AS w FROM q),
qt AS (SELECT qid, dl, term, count(*) AS tf FROM (SELECT qid, len(w) AS dl, unnest(w) AS term FROM ql) GROUP BY ALL),
qw AS (SELECT qid, qt.term, idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS wq, 1.0::DOUBLE AS wb FROM qt JOIN d USING (term), n),
sc AS (SELECT qid, chunk_id, round(sum(wq * weight), 6) AS si, round(sum(wb * weight), 6) AS sb FROM qw JOIN w USING (term) GROUP BY ALL),
bi AS (SELECT qid, chunk_id, si AS score, row_number() OVER (PARTITION BY qid ORDER BY si DESC, chunk_id) AS rank FROM sc QUALIFY rank <= {K}),
bb AS (SELECT qid, chunk_id, sb AS score, row_number() OVER (PARTITION BY qid ORDER BY sb DESC, chunk_id) AS rank FROM sc QUALIFY rank <= {K}),
tr AS (SELECT qid, mode, CAST(r AS BIGINT) AS chunk_id, i AS rank FROM (SELECT qid, mode, unnest(refs) AS r, unnest(range(1, len(refs) + 1)) AS i FROM q)),
lg AS (SELECT qid, chunk_id, min(rank) AS rank FROM tr GROUP BY ALL),
f0 AS (SELECT qid, chunk_id, lg.rank AS dense_rank, bi.rank AS sparse_rank FROM lg FULL JOIN bi USING (qid, chunk_id)),
fu AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 9) AS fused_score FROM f0),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, CAST(chunk_id AS VARCHAR)) AS final_rank FROM fu)
"""


#: Fusion of the logged list and the best 2 * K published chunks: the published filter comes before the cut.
_PUBLISHED = f"""pb AS (SELECT DISTINCT chunk_id FROM chunks JOIN versions USING (version_id) WHERE versions.status = 'published'),
b2 AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY si DESC, chunk_id) AS rank FROM sc WHERE chunk_id IN (FROM pb) QUALIFY rank <= {2 * K}),
p0 AS (SELECT qid, chunk_id, lg.rank AS dense_rank, b2.rank AS sparse_rank FROM lg FULL JOIN b2 USING (qid, chunk_id)),
pf AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 9) AS fused_score FROM p0),
pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, CAST(chunk_id AS VARCHAR)) AS final_rank FROM pf)"""


def _per_query(ranked: str) -> str:
    return f"""
SELECT qid, mode, min(r.rank) AS first_rank, count(g.chunk_id) AS n,
  CASE WHEN count(g.chunk_id) = 0 THEN 1.0::DOUBLE ELSE count(r.rank) / count(g.chunk_id)::DOUBLE END AS recall,
  coalesce(1.0::DOUBLE / min(r.rank), 0) AS mrr,
  CASE WHEN count(g.chunk_id) = 0 THEN 0.0::DOUBLE ELSE coalesce(sum(ln(2) / ln(r.rank + 1)), 0)
    / list_sum(list_transform(range(1, greatest(1, least(count(g.chunk_id), {K})) + 1), lambda x: ln(2) / ln(x + 1))) END AS ndcg
FROM q LEFT JOIN (SELECT DISTINCT qid, chunk_id FROM tr) g USING (qid) LEFT JOIN {ranked} r USING (qid, chunk_id) GROUP BY ALL"""


_STATS = ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in ("recall", "mrr", "ndcg") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
_ROUNDS = """(SELECT qid, chunk_id, score, NULL::DOUBLE AS dense_score, score AS sparse_score, 1 AS sub, 'sparse' AS retriever FROM bi
  UNION ALL SELECT qid, chunk_id, score, score, NULL, 2, 'dense' FROM bb)"""
_COSINE = """
SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {scope} QUALIFY rank <= 5"""

SQL = {
    "term_stats": _bm25() + "SELECT term, ('0x' || substr(sha256(term), 1, 8))::BIGINT AS term_id, df, round(idf, 6) AS idf FROM d",
    "term_stats_by_scope": _bm25("knowledge_scope_id") + "SELECT knowledge_scope_id, term, df, round(idf, 6) AS idf FROM d",
    "term_stats_by_source": _bm25("source_id") + "SELECT source_id, term, df, round(idf, 6) AS idf FROM d",
    "doc_weights": _bm25() + "SELECT chunk_id, term, round(weight, 6) AS weight FROM w",
    "bm25_topk": _SEARCH + "SELECT * FROM bi",
    "bm25_topk_binary": _SEARCH + "SELECT * FROM bb",
    "bm25_topk_scoped": _SEARCH + """, a AS (SELECT qid, c.knowledge_scope_id AS scope FROM q JOIN c ON c.chunk_id = CAST(refs[1] AS BIGINT))
SELECT qid, sc.chunk_id, si AS score, row_number() OVER (PARTITION BY qid ORDER BY si DESC, sc.chunk_id) AS rank FROM sc JOIN c USING (chunk_id) JOIN a USING (qid) WHERE a.scope = c.knowledge_scope_id QUALIFY rank <= 5""",
    "scope_leakage": _SEARCH + """, a AS (SELECT qid, c.knowledge_scope_id AS scope FROM q JOIN c ON c.chunk_id = CAST(refs[1] AS BIGINT))
SELECT c.knowledge_scope_id AS scope, count(*) AS leaked FROM bi JOIN c USING (chunk_id) JOIN a USING (qid) WHERE a.scope <> c.knowledge_scope_id GROUP BY 1""",
    "rrf_fused": _SEARCH + "SELECT *, concat_ws('+', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN sparse_rank IS NOT NULL THEN 'sparse' END) AS retrievers FROM fr",
    "per_source_cap": _SEARCH + "SELECT qid, chunk_id, source_id, final_rank, row_number() OVER (PARTITION BY qid, source_id ORDER BY final_rank) AS in_source FROM fr JOIN c USING (chunk_id) QUALIFY in_source <= 2",
    "hybrid_evidence": _SEARCH + f""", h AS (SELECT DISTINCT chunk_id, source_id, version_id, knowledge_scope_id, content_text, position_path FROM chunks),
{_PUBLISHED},
e AS (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY final_rank) AS m FROM pr JOIN h USING (chunk_id) JOIN (SELECT DISTINCT version_id, version_number FROM versions WHERE status = 'published') USING (version_id)
  LEFT JOIN (SELECT DISTINCT scope_id AS knowledge_scope_id, scope_type FROM scopes) USING (knowledge_scope_id) QUALIFY m <= 5)
SELECT qid, CAST(chunk_id AS VARCHAR) AS evidence_id, substr(content_text, 1, 500) AS content_excerpt, version_number AS source_version, position_path AS source_position, knowledge_scope_id, scope_type,
  round(fused_score, 4) AS score, least(1, greatest(0, round(fused_score, 4))) AS relevance_score FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY final_rank) <= 5""",
    "hybrid_graph_evidence": _SEARCH.replace("WITH c AS", "WITH RECURSIVE c AS") + """, sx AS (SELECT DISTINCT chunk_id, knowledge_scope_id AS scope FROM chunks),
rr AS (SELECT list_transform(evidence_ref_ids, lambda x: CAST(x AS BIGINT)) AS r FROM retrieval_runs WHERE len(evidence_ref_ids) > 1),
e0 AS (SELECT chunk_id AS source, parent_chunk_id AS target, true AS is_hard FROM chunks WHERE parent_chunk_id <> chunk_id
  UNION SELECT * FROM (SELECT r[i] AS source, r[i + 1] AS target, false FROM (SELECT r, unnest(range(1, len(r))) AS i FROM rr)) WHERE source <> target),
e AS (SELECT x.scope, source, target, is_hard, CAST('0x' || substr(md5(source || '-' || target || '-' || is_hard), 1, 15) AS BIGINT) AS edge_id FROM e0 JOIN sx x ON x.chunk_id = source JOIN sx y ON y.chunk_id = target WHERE x.scope = y.scope),
dg AS (SELECT scope, source AS f, target AS t, is_hard, edge_id FROM e UNION ALL SELECT scope, target, source, is_hard, edge_id FROM e),
sd AS (SELECT DISTINCT qid, chunk_id, c.knowledge_scope_id AS scope FROM f0 JOIN c USING (chunk_id)),
x AS (SELECT qid, sd.scope, t AS doc, f AS start, 1 AS hop, CASE WHEN is_hard THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS weight, edge_id::VARCHAR AS edges, [f] AS visited FROM sd JOIN dg d ON f = chunk_id AND d.scope = sd.scope
  UNION ALL SELECT qid, x.scope, t, start, hop + 1, CASE WHEN d.is_hard THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * pow(0.5::DOUBLE, hop), edges || ',' || d.edge_id::VARCHAR, list_append(visited, f) FROM x JOIN dg d ON d.f = x.doc AND d.scope = x.scope WHERE hop < 2 AND NOT list_contains(visited, t)),
b AS (SELECT qid, scope, doc, weight, hop FROM x QUALIFY row_number() OVER (PARTITION BY qid, scope, doc ORDER BY weight DESC, hop, start, edges) = 1),
bg AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid, scope ORDER BY weight DESC, hop, doc) <= 10),
gr AS (SELECT qid, doc AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, hop, doc) AS graph_rank FROM bg QUALIFY graph_rank <= 10),
g0 AS (SELECT qid, chunk_id, dense_rank, sparse_rank, graph_rank FROM f0 FULL JOIN gr USING (qid, chunk_id)),
g1 AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) + coalesce(1.0::DOUBLE / (60 + graph_rank), 0), 9) AS fused_score FROM g0)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, graph_rank NULLS LAST, CAST(chunk_id AS VARCHAR)) AS final_rank FROM g1""",
    "merged_rounds": _SEARCH + f"""SELECT qid, chunk_id, b.score AS score, sub_problems, retrievers, row_number() OVER (PARTITION BY qid ORDER BY b.score DESC, b.dense_score DESC NULLS LAST, b.sparse_score DESC NULLS LAST, CAST(chunk_id AS VARCHAR)) AS merge_rank
FROM (SELECT qid, chunk_id, first({{'score': score, 'dense_score': dense_score, 'sparse_score': sparse_score}} ORDER BY score DESC, dense_score DESC NULLS LAST, sparse_score DESC NULLS LAST) AS b,
  string_agg(DISTINCT sub::VARCHAR, ',' ORDER BY sub::VARCHAR) AS sub_problems, string_agg(DISTINCT retriever, '+' ORDER BY retriever) AS retrievers FROM {_ROUNDS} GROUP BY ALL)""",
    "context_selection": _SEARCH + f""", x AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY score DESC, sub) AS nth FROM {_ROUNDS})
SELECT qid, chunk_id, sub AS sub_problem_id, score, CASE WHEN nth > 1 THEN 'deduped' WHEN row_number() OVER (PARTITION BY qid, nth = 1 ORDER BY score DESC, CAST(chunk_id AS VARCHAR)) <= 3 THEN 'selected' ELSE 'truncated' END AS decision FROM x""",
    "retrieval_metrics": _SEARCH + f"SELECT qid, first_rank, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM ({_per_query('bi')})",
    "metrics_by_mode": _SEARCH + f", m AS ({_per_query('bi')}) SELECT mode, count(*) AS queries, {_STATS} FROM m GROUP BY GROUPING SETS ((), (mode))",
    "rank_deltas": _SEARCH + "SELECT qid, chunk_id, bi.rank AS rank_a, bb.rank AS rank_b, bi.rank - bb.rank AS delta FROM bi FULL JOIN bb USING (qid, chunk_id)",
    "quality_gate": _SEARCH + f""", a AS ({_per_query('bi')}), b AS ({_per_query('bb')}),
p AS (SELECT unnest(['recall', 'mrr', 'ndcg']) AS metric, unnest([avg(recall), avg(mrr), avg(ndcg)]) AS baseline FROM a),
r AS (SELECT unnest(['recall', 'mrr', 'ndcg']) AS metric, unnest([avg(recall), avg(mrr), avg(ndcg)]) AS candidate FROM b)
SELECT metric, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round((candidate - baseline) / nullif(abs(baseline), 0), 6) AS change, candidate >= baseline * 0.99 AS non_inferior, abs(candidate - baseline) <= abs(baseline) * 0.01 AS reproducible FROM p JOIN r USING (metric)""",
    "dense_topk": _COSINE.format(scope=""),
    "dense_topk_scoped": _COSINE.format(scope="AND q.label = v.label"),
    "collection_dimension": "SELECT max(len(embedding))::INT AS dimension, min(len(embedding))::INT AS least FROM embeddings",
}
