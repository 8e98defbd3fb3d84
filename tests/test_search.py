import math

import numpy as np

from sparquill.operators import dense, evaluate, fusion, sparse

DOCS = [(1, "retry queue retry"), (2, "queue worker"), (3, "worker pool timeout"), (4, None), (5, "the of")]


def test_bm25_by_hand(spark):
    counts = sparse.term_counts(spark.createDataFrame(DOCS, "id bigint, text string"), "id", "text")
    size = sparse.corpus_size(counts).first()
    assert (size.n_docs, size.avgdl) == (5, 8 / 5)  # texts without tokens count
    idf = {r.term: r.idf for r in sparse.term_stats(counts).collect()}
    assert math.isclose(idf["retry"], math.log(1 + 4.5 / 1.5))
    assert idf["retry"] > idf["queue"]
    w = {(r.doc, r.term): r.weight for r in sparse.doc_weights(counts).collect()}
    assert math.isclose(w[1, "retry"], idf["retry"] * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 1.6)))


def test_search_ties_and_equal_queries(spark):
    docs = spark.createDataFrame([(i, "same words") for i in (3, 1, 2)], "id bigint, text string")
    counts = sparse.term_counts(docs, "id", "text")
    asked = spark.createDataFrame([(10, "words"), (20, "words"), (30, "unknown"), (40, "")], "qid bigint, query string")
    got = sorted((r.qid, r.doc, r["rank"]) for r in sparse.search(asked, counts, k=2).collect())
    assert got == [(10, 1, 1), (10, 2, 2), (20, 1, 1), (20, 2, 2)]


def test_exact_and_indexed_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(400)]
    v = spark.createDataFrame(rows, "doc bigint, embedding array<float>, scope int")
    q = v.filter("doc % 50 = 0").withColumnRenamed("doc", "qid")
    m = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    exact = {}
    for r in dense.exact_top_k(v, q, 5).collect():
        exact.setdefault(r.qid, set()).add(r.doc)
    for qid, docs in exact.items():
        assert docs == set(np.lexsort((np.arange(400), -np.round(m @ m[qid], 6)))[:5])
    scoped = dense.exact_top_k(v, q, 5, scoped=True).collect()
    assert all(r.qid % 3 == r.doc % 3 for r in scoped)
    centres = dense.fit_centroids(v, lists=8)
    found = dense.indexed_top_k(v, q, centres, 5, dense.choose_probes(v, centres, 5)).collect()
    assert sum(r.doc in exact[r.qid] for r in found) >= 0.9 * sum(map(len, exact.values()))


def test_rrf_ties(spark):
    rows = [(1, d, r, n) for r, ids in (("dense", [7, 8, 10]), ("sparse", [8, 7, 9]), ("graph", [9])) for n, d in enumerate(ids, 1)]
    got = fusion.rrf(spark.createDataFrame(rows, "qid int, doc bigint, retriever string, rank int")).orderBy("final_rank").collect()
    # 7 and 8 have the same ranks in turn; the dense rank decides
    assert [r.doc for r in got] == [7, 8, 9, 10]
    assert math.isclose(got[2].fused_score, 1 / 61 + 1 / 63, abs_tol=1e-9)
    assert got[2].retrievers == ["sparse", "graph"]


def test_merge_and_caps(spark):
    rows = [(1, 5, 0.4, None, 0.4, 1, ["sparse"]), (1, 5, 0.9, 0.9, None, 2, ["dense"]), (1, 6, 0.9, 0.9, 0.2, 1, ["dense"])]
    got = fusion.merge_rounds(spark.createDataFrame(rows, "qid int, doc bigint, score double, dense_score double, sparse_score double, sub_problem_id int, retrievers array<string>")).orderBy("merge_rank").collect()
    assert [(r.doc, r.sub_problem_ids, r.retrievers) for r in got] == [(6, [1], ["dense"]), (5, [1, 2], ["dense", "sparse"])]
    capped = fusion.per_source_cap(spark.createDataFrame([(1, 9, i) for i in range(1, 5)], "qid int, source_id int, rank int"), 2)
    assert sorted(r["rank"] for r in capped.collect()) == [1, 2]


def test_metrics(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, None)], "qid int, doc bigint")
    ranked = spark.createDataFrame([(1, 11, 1), (1, 99, 2), (1, 10, 3), (2, 12, 7)], "qid int, doc bigint, rank int")
    got = {r.qid: r for r in evaluate.per_query(truth, ranked, 5).collect()}
    assert (got[1].recall, got[1].mrr) == (1.0, 1.0)
    assert math.isclose(got[1].ndcg, (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert (got[2].recall, got[2].ndcg) == (0.0, 0.0) and math.isclose(got[2].mrr, 1 / 7)
    assert (got[3].recall, got[3].mrr) == (1.0, 0.0)
    assert evaluate.per_query(truth.limit(0), ranked).collect() == []


def test_unpublished_chunks_take_no_places(spark, tmp_path):
    from sparquill.plans import search_plans

    # 20 equal texts of four sources; the versions of the first twelve, which ties prefer, are not published
    chunks = [(i, i % 4, 1 if i < 6 else 2 if i < 12 else 3, 7, "queue worker", "p") for i in range(20)]
    spark.createDataFrame(chunks, "chunk_id bigint, source_id bigint, version_id bigint, knowledge_scope_id bigint, content_text string, position_path string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, 1, "draft"), (2, 2, "superseded"), (3, 3, "published")], "version_id bigint, version_number int, status string").write.parquet(f"{tmp_path}/versions.parquet")
    spark.createDataFrame([(7, "project")], "scope_id bigint, scope_type string").write.parquet(f"{tmp_path}/scopes.parquet")
    runs = [(50, "queue", ["3", "19"], "dense"), (100, "worker", [], "dense"), (150, "unknown", ["2", "18"], "dense")]
    spark.createDataFrame(runs, "run_id bigint, query_text string, evidence_ref_ids array<string>, retrieval_mode string").write.parquet(f"{tmp_path}/retrieval_runs.parquet")
    got = {}
    for r in search_plans.hybrid_evidence(spark, str(tmp_path)).collect():
        got.setdefault(r.qid, set()).add(r.evidence_id)
    # 19 is both logged and found at the eighth place
    assert got == {50: {"19", "12", "13", "14", "15"}, 100: {"12", "13", "14", "15", "16"}, 150: {"18"}}


def _brute_force(docs, asked, k, weighting):
    """{(qid, doc, rank)} of token lists by id, in plain Python."""
    from collections import Counter

    avgdl, df = sum(map(len, docs.values())) / len(docs), Counter(t for words in docs.values() for t in set(words))
    idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    weight = lambda t, words: idf[t] * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / avgdl))
    out = set()
    for qid, query in asked.items():
        score = {d: round(sum((weight(t, query) if weighting == "idf" else 1) * weight(t, words) for t in sorted(set(query)) if t in words), 6) for d, words in docs.items() if set(query) & set(words)}
        out |= {(qid, d, n) for n, d in enumerate(sorted(score, key=lambda d: (-score[d], d))[:k], 1)}
    return out


def test_postings_are_pruned_without_changing_the_best(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = {i: [words[min(59, int(x))] for x in rng.exponential(8, rng.integers(1, 12))] for i in range(600)}
    asked = {i: [words[min(59, int(x))] for x in rng.exponential(14, rng.integers(1, 6))] for i in range(60)}
    counts = sparse.term_counts(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "id bigint, text string"), "id", "text")
    queries = spark.createDataFrame([(i, " ".join(w)) for i, w in asked.items()], "qid bigint, query string")
    # only what the queries read is kept, and both weightings come from it in one pass
    kept = sparse.kept_counts(counts, queries)
    assert {r.term for r in kept.select("term").distinct().collect()} == {w for q in asked.values() for w in q if any(w in d for d in docs.values())} | {None}
    found = sparse.searches(queries, kept, 4)
    for weighting in ("idf", "binary"):
        assert {(r.qid, r.doc, r["rank"]) for r in found[weighting].collect()} == _brute_force(docs, asked, 4, weighting)


def test_a_part_sends_its_best_only(spark):
    # 300 documents have the common key 7, of which those with the rare key 8 are far better
    weights = spark.createDataFrame([(d, 7, 1.0 + d % 5 / 10) for d in range(300)] + [(d, 8, 9.0) for d in range(40, 50)], "doc bigint, key bigint, weight double").repartition(2, "doc")
    asked = spark.createDataFrame([(1, 7, 1.0, 1.4, 8.9, False), (1, 8, 1.0, 9.0, 8.9, True), (2, 7, 1.0, 1.4, 1.3, True)], "first bigint, key bigint, wq double, most double, enough double, leads boolean")
    got = [tuple(r) for r in sparse._scored(weights, asked, ["first"], 3).collect()]
    assert len(got) <= 2 * 2 * 3  # parts, queries, k
    assert {(d, q) for d, q, _ in got} >= {(44, 1), (49, 1), (43, 1), (4, 2), (9, 2), (14, 2)}
    assert {s for d, q, s in got if (d, q) == (49, 1)} == {10.4}
