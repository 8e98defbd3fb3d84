"""The deterministic steps around search, over logged and lexical evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import text as txt
from sparquill.operators import agentic, runs
from sparquill.plans.search_plans import _SEARCH, _runs, _searched, bm25_topk
from sparquill.scratch import Scratch
from sparquill.session import table


def evidence_lookup(spark, sf_dir):
    """Each logged reference of a searched run, looked up under the scope of the run's first chunk."""
    chunks = table(spark, sf_dir, "chunks")
    scope = chunks.select(F.col("chunk_id").cast("string").alias("first"), F.col("knowledge_scope_id").alias("scope")).distinct()
    runs = _runs(spark, sf_dir).filter(F.size("refs") > 0).withColumn("first", F.col("refs")[0]).join(scope, "first")
    refs = runs.select(F.explode("refs").alias("evidence_id"), "scope").distinct()
    return agentic.look_up_evidence(refs, chunks, table(spark, sf_dir, "versions"))


def parent_supplements(spark, sf_dir):
    chosen = bm25_topk(spark, sf_dir).withColumnRenamed("chunk_id", "doc")
    return agentic.supplement_parents(chosen, table(spark, sf_dir, "chunks"), 6).withColumnRenamed("doc", "chunk_id")


def evidence_views(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("doc"), "content_text").dropDuplicates(["doc"])
    view = agentic.evidence_view(bm25_topk(spark, sf_dir).withColumnRenamed("chunk_id", "doc").join(chunks, "doc"), head=3)
    return view.withColumnRenamed("doc", "chunk_id")


def search_status(spark, sf_dir):
    """Status and gaps of each lexical search that asked for five."""
    found = bm25_topk(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"))
    rows = _runs(spark, sf_dir).select("qid").join(found, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = agentic.completion_status(F.col("n"), F.lit(5), F.lit(False))
    missing = agentic.gaps(F.col("n"), F.lit(5), F.array().cast("array<string>"))
    return rows.select("qid", "n", status.alias("status"), F.array_join(F.transform(missing, lambda g: F.concat_ws(":", g["kind"], g["detail"])), ",").alias("gaps"))


def ledger_entries(spark, sf_dir, found=None):
    rows = lambda df, n: df.select("qid", F.lit(n).alias("round"), F.lit(n).alias("sub_problem_id"), F.col("chunk_id").alias("doc"), F.col("score") / 100, F.array(F.lit("sparse")).alias("retrievers"), F.lit(n == 3).alias("reranked")).toDF("qid", "round", "sub_problem_id", "doc", "score", "retrievers", "reranked")
    idf, binary = found or _searched(spark, sf_dir, "idf", "binary")
    return agentic.ledger(rows(idf, 1).unionByName(rows(binary, 3)))


def hardened_sub_problems(spark, sf_dir):
    """Every run's text as the query, its words as sub-problems with signals and directions that are partly unknown or missing."""
    runs = _runs(spark, sf_dir).select("qid", "query", "mode")
    words = runs.select("qid", "mode", F.posexplode(F.split("query", " ")).alias("ord", "query"))
    plans = words.select("qid", "ord", "query", F.when(F.col("mode") == "graph_enhanced", F.array(F.lit("graph"), F.lit("odd"))).otherwise(F.array(F.lit("odd"))).alias("signals"), F.when(F.col("ord") % 3 == 0, F.array(F.lit("calls"), F.lit("sideways"))).when(F.col("ord") % 3 == 1, F.array(F.lit("calls"))).alias("directions"), F.col("ord").alias("hop"))
    out = agentic.harden_sub_problems(plans, runs.select("qid", "query"))
    return out.select("qid", "sub_problem_id", "query", F.array_join("signals", "+").alias("signals"), F.array_join("directions", "+").alias("directions"), "hop")


def ledger_lookup(spark, sf_dir):
    """What the ledger holds of the first place of each lexical search."""
    found = _searched(spark, sf_dir, "idf", "binary")
    ledger = Scratch(spark).keep(ledger_entries(spark, sf_dir, found))
    first = found[0].filter("rank = 1").select("qid", F.col("chunk_id").cast("string").alias("evidence_id"))
    return agentic.entries_of(ledger, first)


def llm_costs(spark, sf_dir):
    """By mode, at 2.5 a million tokens, over each run once."""
    log = runs.delivered_once(table(spark, sf_dir, "retrieval_runs")).filter("provider_usage IS NOT NULL")
    calls = log.select("retrieval_mode", F.col("provider_usage.llm_prompt_chars").alias("prompt_chars"), F.col("provider_usage.llm_completion_chars").alias("completion_chars"))
    return agentic.llm_cost(calls, 2.5, by=("retrieval_mode",))


def recorded_traces(spark, sf_dir):
    """Each run's trace as it is kept when texts must not be."""
    log = runs.delivered_once(table(spark, sf_dir, "retrieval_runs"))
    return runs.without_body(log).select("run_id", "query_text", "trace_body_recorded", "completion_status")


def generated_queries(spark, sf_dir):
    return agentic.generated_queries(table(spark, sf_dir, "chunks").select("chunk_id", "position_path").distinct())


QUERIES = {f.__name__: f for f in (evidence_lookup, parent_supplements, evidence_views, search_status, ledger_entries, ledger_lookup, llm_costs, recorded_traces, hardened_sub_problems, generated_queries)}

_HIGH = " OR ".join(f"regexp_matches(content_text, '{p.replace(chr(39), chr(39) * 2)}')" for p in txt.HIGH_RISK.values())
SQL = {
    "evidence_lookup": _SEARCH + """, k AS (SELECT DISTINCT chunk_id::VARCHAR AS evidence_id, knowledge_scope_id, version_id, position_path FROM chunks),
x AS (SELECT DISTINCT unnest(refs) AS evidence_id, k.knowledge_scope_id AS scope FROM q JOIN k ON k.evidence_id = refs[1]),
lv AS (SELECT DISTINCT version_id FROM versions WHERE status = 'published'),
s AS (SELECT evidence_id, scope, position_path, CASE WHEN knowledge_scope_id IS NULL OR lv.version_id IS NULL THEN 'unavailable' WHEN knowledge_scope_id <> scope THEN 'scope_mismatch' ELSE 'available' END AS status
  FROM x LEFT JOIN k USING (evidence_id) LEFT JOIN lv ON lv.version_id = k.version_id)
SELECT evidence_id, scope, status, CASE WHEN status = 'available' THEN position_path END AS position_path FROM s""",
    "parent_supplements": _SEARCH + """, p AS (SELECT chunk_id, min(parent_chunk_id) AS parent FROM chunks WHERE parent_chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY 1),
m AS (SELECT qid, parent AS chunk_id, min(rank) AS r FROM bi JOIN p USING (chunk_id) GROUP BY ALL), n AS (SELECT m.* FROM m ANTI JOIN bi USING (qid, chunk_id)),
u AS (SELECT qid, count(*) AS used, max(rank) AS last FROM bi GROUP BY 1)
SELECT qid, chunk_id, rank, false AS supplement FROM bi UNION ALL
SELECT qid, chunk_id, last + n AS rank, true FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r, chunk_id) AS n FROM n) JOIN u USING (qid) WHERE used + n <= 6""".replace(", n AS (SELECT m.*", ", nn AS (SELECT m.*").replace("FROM n) JOIN u", "FROM nn) JOIN u"),
    "evidence_views": _SEARCH + f"""SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank, chunk_id) AS place, CASE WHEN {_HIGH} THEN '[withheld]' ELSE substr(content_text, 1, 400) END AS shown,
  length(content_text) > 400 AS truncated, ({_HIGH}) AS quarantined FROM bi JOIN c USING (chunk_id) QUALIFY place <= 3""",
    "search_status": _SEARCH + """SELECT qid, count(bi.chunk_id) AS n, CASE WHEN n = 0 THEN 'no_evidence' WHEN n < 5 THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN n = 0 THEN 'no_evidence:' WHEN n < 5 THEN 'too_few:' || n || '/5' ELSE '' END AS gaps FROM q LEFT JOIN bi USING (qid) GROUP BY qid""",
    "ledger_entries": _SEARCH + """SELECT qid, dense_rank() OVER (PARTITION BY qid ORDER BY r) - 1 AS round_index, r AS sub_problem_id, chunk_id::VARCHAR AS evidence_id, CASE WHEN r = 3 THEN 'rerank' ELSE 'sparse' END AS retriever, round(least(1, greatest(0, score / 100)), 4) AS score
FROM (SELECT qid, 1 AS r, chunk_id, score FROM bi UNION ALL SELECT qid, 3, chunk_id, score FROM bb)""",
    "ledger_lookup": _SEARCH + """, lg2 AS (SELECT qid, dense_rank() OVER (PARTITION BY qid ORDER BY r) - 1 AS round_index, r AS sub_problem_id, chunk_id::VARCHAR AS evidence_id, CASE WHEN r = 3 THEN 'rerank' ELSE 'sparse' END AS retriever, round(least(1, greatest(0, score / 100)), 4) AS score
FROM (SELECT qid, 1 AS r, chunk_id, score FROM bi UNION ALL SELECT qid, 3, chunk_id, score FROM bb)) SELECT lg2.* FROM lg2 JOIN bi ON bi.qid = lg2.qid AND bi.chunk_id::VARCHAR = evidence_id WHERE bi.rank = 1""",
    "llm_costs": """SELECT retrieval_mode, count(*) AS calls, coalesce(sum(coalesce(u.llm_prompt_chars, 0) + coalesce(u.llm_completion_chars, 0)), 0)::BIGINT AS chars, round(chars / 3.0::DOUBLE, 2) AS tokens, round(chars / 3.0::DOUBLE / 1e6 * 2.5::DOUBLE, 6) AS cost
FROM (SELECT retrieval_mode, provider_usage AS u FROM retrieval_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_at) = 1) WHERE u IS NOT NULL GROUP BY 1""",
    "recorded_traces": "SELECT run_id, NULL::VARCHAR AS query_text, false AS trace_body_recorded, completion_status FROM retrieval_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_at) = 1",
    "hardened_sub_problems": _SEARCH + """, x AS (SELECT qid, mode, query AS whole, unnest(string_split(query, ' ')) AS query, unnest(range(len(string_split(query, ' ')))) AS ord FROM q),
k AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM x WHERE trim(query) <> '' AND query <> whole),
z AS (SELECT qid, query, coalesce(n, 0) AS n FROM q LEFT JOIN (SELECT DISTINCT qid, n FROM k) USING (qid)),
y AS (SELECT qid, -1 AS ord, query, CASE WHEN n = 0 THEN 'dense' ELSE 'dense+sparse' END AS signals, CASE WHEN n = 0 THEN 'calls+called_by+fk_references+fk_referenced_by' ELSE '' END AS directions, 2 AS hop FROM z WHERE n <> 1 UNION ALL
SELECT qid, ord, CASE WHEN n = 1 THEN whole ELSE query END, CASE WHEN mode = 'graph_enhanced' THEN 'graph' ELSE 'dense' END,
  CASE WHEN ord % 3 = 0 THEN 'calls+called_by+fk_references+fk_referenced_by' WHEN ord % 3 = 1 THEN 'calls' WHEN mode = 'graph_enhanced' THEN 'calls+called_by+fk_references+fk_referenced_by' ELSE '' END, CASE WHEN ord BETWEEN 1 AND 3 THEN ord ELSE 2 END FROM k)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord, query) AS sub_problem_id, query, signals, directions, hop FROM y""",
    "generated_queries": r"""WITH p AS (SELECT DISTINCT chunk_id, position_path FROM chunks WHERE position_path <> ''), t AS (SELECT chunk_id, trim(regexp_replace(string_split(position_path, ' > ')[-1], '^#+ *', '')) AS topic FROM p)
SELECT chunk_id, replace(CASE WHEN regexp_matches(topic, '[一-鿿]') THEN ['%s 是什么？', '如何使用 %s？', '%s 在哪里说明？'][chunk_id % 3 + 1] ELSE ['How does %s work?', 'What is %s?', 'Where is %s described?'][chunk_id % 3 + 1] END, '%s', topic) AS query, chunk_id::VARCHAR AS expected_evidence_id FROM t""",
}
