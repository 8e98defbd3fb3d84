import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from sparquill.operators import agentic, catalog, coordination, dense, evaluate, graph, rerank, sparse

START = datetime(2026, 1, 1)


def metrics(spark, rows):
    return spark.createDataFrame(rows, "qid int, recall double, mrr double, ndcg double")


def test_gates(spark):
    subsets = spark.createDataFrame([(1, "original"), (2, "beneficiary"), (2, "structural"), (3, "other")], "qid int, subset string")
    hard = evaluate.hard_constraints(
        spark.createDataFrame([("1", "x", 2, "p", 7, 0.5, 0.5)], "evidence_id string, content_excerpt string, source_version int, source_position string, knowledge_scope_id int, score double, relevance_score double"),
        spark.createDataFrame([], "qid int"),
    )
    assert hard.first().all_passed
    a = metrics(spark, [(1, 1.0, 0.5, 0.6), (2, 0.5, 0.5, 0.5), (3, 1.0, 1.0, 1.0)])
    b = metrics(spark, [(1, 1.0, 0.6, 0.7), (2, 1.0, 0.6, 0.5), (3, 1.0, 0.995, 1.0)])
    compared = evaluate.subset_comparison(a, b, subsets)
    rows = {r.subset: r for r in compared.collect()}
    assert rows["beneficiary"].mrr_gain_pct == 20.0 and rows["other"].regressed == 0  # within the tolerance
    assert evaluate.hybrid_gate(compared, hard).first().enters_default_path
    assert evaluate.graph_gate(compared, hard).first().all_passed and evaluate.agentic_gate(compared, hard).first().all_passed
    worse = evaluate.subset_comparison(a, metrics(spark, [(1, 0.5, 0.6, 0.7), (2, 1.0, 0.51, 0.5), (3, 1.0, 0.9, 1.0)]), subsets)
    got = evaluate.agentic_gate(worse, hard).first()
    assert (got.beneficiaries, got.original, got.others, got.hard_passed, got.all_passed) == (False, False, False, True, False)
    assert not evaluate.hybrid_gate(worse, hard).first().recall_kept
    none = evaluate.hard_constraints(spark.createDataFrame([], "evidence_id string, content_excerpt string, source_version int, source_position string, knowledge_scope_id int, score double, relevance_score double"), spark.createDataFrame([(1,)], "qid int"))
    assert (none.first().schema_validity_rate, none.first().leakage_events, none.first().all_passed) == (0.0, 1, False)


def test_rerank_budget_and_ties(spark):
    fused = spark.createDataFrame([(1, d, 0.1 - d / 1000, d) for d in range(1, 6)], "qid int, doc bigint, fused_score double, final_rank int")
    texts = spark.createDataFrame([(1, "none of it"), (2, "queue"), (3, "retry queue"), (4, None), (5, "retry queue worker")], "doc bigint, text string")
    queries = spark.createDataFrame([(1, "Retry the queue")], "qid int, query string")
    got = rerank.rerank(fused, queries, texts, k=3, budget=4).orderBy("rerank_rank").collect()
    assert [(r.doc, r.rerank_score) for r in got] == [(3, 1.0), (2, 0.5), (1, 0.0)]  # 5 is beyond the budget
    own = rerank.rerank(fused, queries, texts, k=1, scorer=lambda q, t: np.array([len(x) for x in t], float)).first()
    assert own.doc == 5


def test_encoder(spark):
    rows = rerank.encode(spark.createDataFrame([(1, "queue worker"), (2, "Queue, worker!"), (3, None)], "id int, t string"), "t").collect()
    assert rows[0].embedding == rows[1].embedding and abs(np.linalg.norm(rows[0].embedding) - 1) < 1e-6 and not any(rows[2].embedding)


def test_leases(spark):
    at = lambda s: START + timedelta(seconds=s)
    log = [("r", "a", "acquire", 0), ("r", "b", "acquire", 10), ("r", "a", "renew", 20), ("r", "b", "renew", 25), ("r", "b", "acquire", 49), ("r", "b", "acquire", 50), ("r", "a", "renew", 51), ("r", "a", "release", 52), ("r", "b", "release", 60), ("s", "c", "acquire", 5), ("s", "c", "odd", 6), (None, "c", "acquire", 7)]
    df = spark.createDataFrame([(r, h, k, at(s)) for r, h, k, s in log], "resource string, holder string, kind string, at timestamp_ntz")
    replayed = coordination.replay_leases(df, 30)
    got = {(r.resource, r.holder, r.kind, (r["at"] - START).seconds): r.outcome for r in replayed.collect()}
    assert [got[x] for x in log[:10]] == ["granted", "conflict", "renewed", "lost", "conflict", "granted", "lost", "void", "released", "granted"] and len(got) == 10
    live = coordination.live_leases(replayed, at(30), 30)
    assert sorted((r.resource, r.holder) for r in live.collect()) == [("r", "a"), ("s", "c")]
    assert [(r.resource, r.holder) for r in coordination.live_leases(replayed, at(55), 30).collect()] == [("r", "b")]
    holders = coordination.instances_with_lease(spark.createDataFrame([("a",), ("b",)], "instance_id string"), live)
    assert {r.instance_id: r.has_lease for r in holders.collect()} == {"a": True, "b": False}


@pytest.mark.parametrize("direction, budget", [("bidirectional", None), ("bidirectional", 3), ("out", 3)])
def test_expansion_is_that_of_all_paths(spark, direction, budget):
    rng = random.Random(7)
    links = {(rng.randrange(14), rng.randrange(14), rng.random() < 0.6) for _ in range(40)}
    rows = [(k, a, b, "calls" if hard else "inferred", "out", hard) for k, (a, b, hard) in enumerate(sorted(links), 1)]
    edges = spark.createDataFrame(rows, "edge_id bigint, source bigint, target bigint, relation_type string, direction string, is_hard boolean")
    seeds = spark.createDataFrame([(q, 0, rng.randrange(14)) for q in range(5) for _ in range(2)], "qid int, scope int, doc bigint")
    directed = [(a, b, k, h) for k, a, b, _, _, h in rows] + ([(b, a, k, h) for k, a, b, _, _, h in rows] if direction != "out" else [])
    want = {}
    for q, _, start in {tuple(r) for r in seeds.collect()}:
        paths = [((start,), (k,), b, 1.0 if h else 0.3) for a, b, k, h in directed if a == start]
        for hop in range(1, 4):
            for _, ks, doc, weight in paths:
                key = (-weight, hop, start, ",".join(map(str, ks)))
                want[q, doc] = min(want.get((q, doc), key), key)
            paths = [(seen + (doc,), ks + (k,), b, (1.0 if h else 0.3) * 0.5**hop) for seen, ks, doc, _ in paths for a, b, k, h in directed if a == doc and b not in seen]
    out = graph.expand(seeds, graph.directed_edges(edges, direction), 3, budget)
    if budget is None:
        got = {(r.qid, r.doc): (-r.weight, r.hop, r.start, ",".join(str(e.edge_id) for e in r.path)) for r in out.collect()}
        assert got == want
    else:
        got = {(r.qid, r.doc, r.graph_rank) for r in graph.within_budget(out, budget).collect()}
        best = [(q, d, n) for q, rows in itertools.groupby(sorted((q, w, h, d) for (q, d), (w, h, _, _) in want.items()), key=lambda x: x[0]) for n, (_, _, _, d) in enumerate(rows, 1) if n <= budget]
        assert got == set(best)


def test_search_with_and_without_broadcast(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12)), i % 3) for i in range(60)], "doc bigint, text string, scope int")
    counts = sparse.term_counts(docs, "doc", "text")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(9)], "qid bigint, query string")
    allowed = spark.createDataFrame([(i, s) for i in range(9) for s in range(3) if rng.random() < 0.6], "qid bigint, scope int")
    for scoped in ({}, {"scopes": docs, "allowed": allowed}, {"only": docs.filter("doc % 2 = 0")}):
        few, many = ({tuple(r) for r in sparse.search(asked, counts, 4, broadcast_terms=n, **scoped).collect()} for n in (10_000, 0))
        assert few == many and few
    seen = {(r.qid, r.doc % 3) for r in sparse.search(asked, counts, 4, scopes=docs, allowed=allowed).collect()}
    assert seen <= {tuple(r) for r in allowed.collect()}


def test_vectors_with_and_without_broadcast(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, [float(round(x)) for x in rng.normal(size=4) * 2], i % 3) for i in range(300)], "doc bigint, embedding array<float>, scope int").repartition(4)
    q = v.filter("doc % 50 = 0").withColumnRenamed("doc", "qid")
    for scoped in (False, True):
        a, b = ({tuple(r) for r in dense.exact_top_k(v, q, 5, scoped, n).collect()} for n in (1_000_000, 0))
        assert a == b and len(a) == 30
    assert dense.exact_top_k(v, q.limit(0)).collect() == [] and dense.exact_top_k(v.limit(0), q).collect() == []


def test_rounds_end(spark):
    problems = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (2, 1, "a")], "qid int, sub_problem_id int, query string")
    found = {"a": [1, 2], "b": [2, 3], "c": [4], "d": [5]}
    search = lambda asked: spark.createDataFrame([(r.qid, d) for r in asked.collect() for d in found[r.query]], "qid int, doc bigint")
    got = {(r.qid, r.doc, r.round) for r in agentic.bounded_rounds(problems, search, enough=3, rounds=3).collect()}
    assert got == {(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 0)}  # three are enough, so c is not asked


def test_publishing_checks(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "source_id int")
    edges = spark.createDataFrame([(1, True), (2, False)], "source_id int, is_hard boolean")
    got = {tuple(r) for r in catalog.runs_that_must_fail(ids(1, 2, 3), ids(1, 2), edges, ids(1, 2, 3)).collect()}
    assert got == {(3, "empty"), (2, "no_edges")}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in catalog.upsert(rows, spark.createDataFrame([(2, "c"), (2, "c"), (3, "d")], "k int, v string"), "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_calls_are_cached_and_failures_told(spark, tmp_path):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [t.upper() for t in texts]

    def never(texts):
        raise AssertionError("asked again")

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "id int, request string")
    path = f"{tmp_path}/answers"
    got = {r.id: (r.response, r.error) for r in rerank.cached_calls(rows, model, path).collect()}
    assert got == {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, "refused"), 5: (None, None)}
    again = {r.id: (r.response, r.error) for r in rerank.cached_calls(rows, never, path).collect()}
    assert again == {**got, 4: (None, "asked again")}  # only what failed is asked again


@pytest.mark.parametrize(
    "name",
    ("agentic_gate", "bm25_topk_newest_version", "bounded_rounds", "context_selection", "graph_gate", "hybrid_graph_evidence", "annotated_evidence", "ledger_lookup", "subset_metrics", "final_scores", "merged_rounds", "parent_supplements", "quality_gate", "sound_selections", "sub_problem_recall"),
)
def test_a_querys_searches_share_the_postings_of_their_terms(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from sparquill.operators import sparse

    cut, kept = [], []
    found = spark.createDataFrame([(0, 1, 1.0, 1)], "qid bigint, doc bigint, score double, rank int")
    counts = spark.createDataFrame([(1, 1, "w", 1)], "doc bigint, dl int, term string, tf bigint")
    monkeypatch.setattr(sparse, "term_counts", lambda docs, id_col, *a, **k: cut.append(id_col) or counts)
    monkeypatch.setattr(sparse, "kept_counts", lambda counts, queries: kept.append(queries) or counts, raising=False)
    monkeypatch.setattr(sparse, "search", lambda queries, *a, **k: found.withColumn("qid", found["qid"].cast(queries.schema["qid"].dataType)))
    monkeypatch.setattr(sparse, "searches", lambda queries, counts, k=5, weightings=("idf", "binary"), **other: dict.fromkeys(weightings, found), raising=False)
    entry.queries()[name](spark, entry.SMOKE_DIR)
    # the texts are cut into words once, and only what the searches read is written
    assert (cut, len(kept)) == (["chunk_id"], 1)
