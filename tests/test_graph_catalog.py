from datetime import datetime

from pyspark.sql import functions as F

from sparquill.operators import catalog, graph, runs

EDGES = "edge_id bigint, scope int, source bigint, target bigint, relation_type string, direction string, is_hard boolean"


def test_expansion(spark):
    hub = [(100 + i, 1, 1, 10 + i, "calls", "out", True) for i in range(15)]
    chain = [(1, 1, 2, 3, "calls", "out", True), (2, 1, 3, 4, "calls", "out", True), (3, 1, 2, 4, "inferred", "out", False), (9, 2, 2, 50, "calls", "out", True)]
    edges = spark.createDataFrame(hub + chain, EDGES)
    seeds = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "qid int, scope int, doc bigint")
    out = graph.expand(seeds, graph.directed_edges(edges, "out"), 2).collect()
    of = {(r.qid, r.doc): (r.hop, r.weight) for r in out}
    assert of[2, 3] == (1, 1.0) and of[2, 4] == (2, 0.5)  # two hard hops beat one soft hop
    assert (2, 50) not in of  # another scope
    kept = graph.within_budget(graph.expand(seeds, graph.directed_edges(edges, "out"), 1), 10).filter("qid = 1").orderBy("graph_rank").collect()
    assert [r.doc for r in kept] == list(range(10, 20))
    back = graph.directed_edges(edges, "in").filter("edge_id = 1").first()
    assert (back["from"], back.to, back.relation_type, back.direction) == (3, 2, "called_by", "in")


def test_soft_relations(spark):
    rows = [(1, 1, 2, "inferred", 0.7, "active"), (2, 1, 2, "inferred", 0.9, "active"), (3, 1, 2, "inferred", 0.95, "inferred")]
    soft = spark.createDataFrame(rows, "edge_id bigint, source bigint, target bigint, relation_type string, confidence double, lifecycle_state string")
    got = {r.edge_id: (r.lifecycle_state, r.superseded_by) for r in graph.supersede(soft).collect()}
    assert got == {1: ("superseded", 2), 2: ("active", None), 3: ("inferred", None)}
    assert graph.retire(graph.supersede(soft)).filter("lifecycle_state = 'retired'").count() == 1
    state = spark.createDataFrame([(0.6, ["e"]), (0.6, []), (0.59, ["e"])], "c double, e array<string>").select(graph.soft_state(F.col("c"), F.col("e")).alias("s")).collect()
    assert [r.s for r in state] == ["active", "inferred", "inferred"]


def test_edges_are_inserted_once(spark):
    old = spark.createDataFrame([(1, 1, 2, "calls", "out")], "edge_id bigint, source bigint, target bigint, relation_type string, direction string")
    new = spark.createDataFrame([(5, 1, 2, "calls", "out"), (6, 2, 3, "calls", "out"), (7, 2, 3, "calls", "out")], old.schema)
    assert graph.add_edges(old, new).count() == 2


def test_references(spark):
    projects = spark.createDataFrame([(1, 11, "Alpha", "/srv/alpha"), (2, 12, None, "/srv/alpha-two"), (3, 13, "gamma", None)], "project_id bigint, knowledge_scope_id bigint, alias string, repo_path string")
    refs = spark.createDataFrame([("ALPHA",), ("11",), ("gamma",), ("nothing",), ("",), (None,)], "ref string")
    got = {(r.ref, r.project_id): r.outcome for r in catalog.resolve_refs(refs, projects).collect()}
    assert got == {("ALPHA", 1): "ambiguous", ("ALPHA", 2): "ambiguous", ("11", 1): "resolved", ("gamma", 3): "resolved", ("nothing", None): "missing"}
    assert {r.ref: r.outcome for r in catalog.resolve_refs(refs, projects, exact=True).collect()}["ALPHA"] == "resolved"


def test_publish_modes(spark):
    now = datetime(2026, 1, 1)
    versions = spark.createDataFrame([(1, 7, 1, "published", None), (2, 7, 2, "draft", None), (3, 8, 1, "published", None)], "version_id bigint, knowledge_scope_id bigint, version_number int, status string, published_at timestamp_ntz")
    draft = versions.filter("status = 'draft'")
    state = lambda df: {r.version_id: r.status for r in df.collect()}
    assert state(catalog.publish(versions, draft, now)) == {1: "superseded", 2: "published", 3: "published"}
    sources = spark.createDataFrame([(1, 100), (2, 200)], "version_id bigint, source_id bigint")
    assert state(catalog.publish(versions, draft, now, "source", sources)) == {1: "published", 2: "published", 3: "published"}


def test_expiry_is_strict(spark):
    now = datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, now), (2, datetime(2025, 12, 31)), (3, None)], "run_id bigint, expires_at timestamp_ntz")
    kept, gone = catalog.split_expired(rows, now)
    assert sorted(r.run_id for r in kept.collect()) == [1, 3] and [r.run_id for r in gone.collect()] == [2]


def test_timing_medians(spark):
    rows = [("a", {"dense_ms": float(v), "noise": 1.0}) for v in (5, 1, 9, 3)] + [("a", {"dense_recall_ms": None}), ("b", None)]
    got = runs.timing_medians(spark.createDataFrame(rows, "tool string, subpath_timings map<string,double>")).collect()
    assert [tuple(r) for r in got] == [("a", "dense", 5)]


def test_source_hashes_are_streamed(spark):
    import hashlib

    texts = {1: ["a", "b" * 5000, "ü"], 2: ["only"], 3: []}
    chunks = [(s, 10 * s + i, t) for s, ts in texts.items() for i, t in enumerate(ts)]
    sources = [(s, hashlib.sha256("\n\n".join(ts).encode()).hexdigest().upper(), "f", "ok", datetime(2026, 1, 1), datetime(2026, 1, 1)) for s, ts in texts.items()]
    got = catalog.source_integrity(
        spark.createDataFrame(sources, "source_id bigint, content_hash string, filename string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"),
        spark.createDataFrame(chunks + chunks[:2], "source_id bigint, chunk_id bigint, content_text string"),
    ).collect()
    assert {r.source_id: (r.chunks, r.hash_matches) for r in got} == {1: (3, True), 2: (1, True), 3: (0, None)}


def test_what_is_reached_without_paths_is_what_expansion_reaches(spark):
    import random

    from sparquill.operators import graph

    rng = random.Random(3)
    # two hubs of soft edges, hard edges between some nodes, loops and repeated edges, two scopes
    pairs = [(rng.randrange(60), rng.choice((0, 1, rng.randrange(60)))) for _ in range(260)]
    rows = [(i, a, b, "calls" if i % 3 == 0 else "inferred", "out", i % 3 == 0, a % 2) for i, (a, b) in enumerate(pairs)]
    edges = spark.createDataFrame(rows + rows[:20], "edge_id bigint, source bigint, target bigint, relation_type string, direction string, is_hard boolean, scope int")
    seeds = spark.createDataFrame([(q, q % 2, d) for q in range(12) for d in rng.sample(range(60), 1 + q % 3)] + [(1, 0, 5)], "qid bigint, scope int, doc bigint")
    directed = graph.directed_edges(edges)
    for hops, budget in ((1, 5), (2, 4), (3, 3), (3, 20)):
        wanted = graph.within_budget(graph.expand(seeds, directed, hops), budget)
        cols = ("qid", "scope", "doc", "hop", "weight", "graph_rank")
        assert {tuple(r) for r in graph.reach(seeds, directed, hops, budget).select(*cols).collect()} == {tuple(r) for r in wanted.select(*cols).collect()}
