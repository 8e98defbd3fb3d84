import random

from sparquill.operators.hierarchy import descendants, faulty_links, hierarchy

SCHEMA = "chunk_id bigint, parent_chunk_id bigint"


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            old = parent.get(i)
            parent[i] = p if old is None else old if p is None else min(old, p)
    out = {}
    for i in parent:
        chain, at = [], parent[i]
        while at is not None and at in parent and at not in chain:
            chain.append(at)
            at = parent[at]
        if at is None:
            out[i] = ("ok", tuple(chain))
        elif at not in parent:
            out[i] = ("orphan", tuple(chain))
        else:
            out[i] = ("cycle" if i in chain else "below_cycle", tuple(x for x in chain if x != i))
    return out


def run(spark, rows, **kw):
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return {r.id: (r.status, tuple(reversed(r.path[:-1]))) for r in tree}, tree


def test_random_forests_match_walking(spark):
    rng = random.Random(5)
    for every in (3,):
        rows = []
        for i in range(200):
            kind = rng.random()
            rows.append((i, None if kind < 0.05 else 9000 + i if kind < 0.08 else rng.randrange(200) if kind < 0.2 else max(i - 1, 0)))
        rows += rng.sample(rows, 20) + [(None, 3), (None, None)]
        got, tree = run(spark, rows, splitter_every=every)
        assert got == brute(rows)
        assert all(r.depth == len(r.path) - 1 for r in tree)
        assert all((r.root_id == r.path[0]) if r.status == "ok" else r.root_id is None for r in tree)


def test_long_chain_and_splitterless_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(120)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1002), (7000, 7000), (7001, 7000)]
    for every in (1_000_000,):
        got, _ = run(spark, rows, splitter_every=every)
        assert got == brute(rows)


def test_empty_and_clashing_names(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, None, "x", 5), (2, 1, "y", 6)], "chunk_id bigint, parent_chunk_id bigint, id string, at bigint")
    assert sorted((r.id, r.depth) for r in hierarchy(df).collect()) == [(1, 0), (2, 1)]


def test_descendants_and_faults(spark):
    tree = hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], SCHEMA))
    assert sorted(map(tuple, descendants(tree).collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert [tuple(r) for r in faulty_links(tree).collect()] == [(4, "orphan")]
