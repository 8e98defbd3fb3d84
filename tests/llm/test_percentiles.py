import math
import random
from datetime import datetime

from sparquill.llm.percentiles import merge_sketches, radix_percentiles, relative_error, sketch, sketch_percentiles, usable_runs

PS = (0.5, 0.95, 0.99)


def nearest(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(len(values) * p - 1e-9)) - 1]


def by_group(rows):
    out = {}
    for g, v in rows:
        if v is not None and v == v:
            out.setdefault(g, []).append(v)
    return out


def test_whole_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0, -5, 7, rng.randint(-(2**31), 2**31 - 1)])) for _ in range(400)] + [("only", 3), ("none", None)]
    df = spark.createDataFrame([(g, v, 9, "x") for g, v in rows], "g string, v int, u int, prefix string")
    got = {r.g: (r.n, r.p50, r.p95, r.p99) for r in radix_percentiles(df, ["g"], "v", PS).collect()}
    assert got == {g: (len(v), *(nearest(v, p) for p in PS)) for g, v in by_group(rows).items()}


def test_doubles_of_any_size(spark):
    rng = random.Random(2)
    pool = [0.0, -0.0, 1e-320, -1e308, 1e308, float("inf"), float("-inf"), float("nan"), None]
    rows = [(rng.randint(0, 1), rng.choice([*pool, rng.gauss(0, 1e6)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.p50, r.p95, r.p99) for r in radix_percentiles(df, ["g"], "v", PS, digit_bits=16).collect()}
    assert got == {g: tuple(nearest(v, p) for p in PS) for g, v in by_group(rows).items()}


def test_sketches_add_up(spark):
    rng = random.Random(3)
    rows = [(d, rng.lognormvariate(3, 2) * rng.choice([1, -1])) for d in range(4) for _ in range(150)]
    df = spark.createDataFrame([(d, "x", v) for d, v in rows], "day int, g string, v double")
    parts = [sketch(df.filter(f"day = {d}"), ["day", "g"], "v") for d in range(4)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    r = sketch_percentiles(merge_sketches(union, ["g"]), ["g"], PS).first()
    assert r.n == 600
    for p, low, high in ((0.5, r.p50_low, r.p50_high), (0.95, r.p95_low, r.p95_high), (0.99, r.p99_low, r.p99_high)):
        exact = nearest([v for _, v in rows], p)
        assert low <= exact <= high and high - low <= relative_error(7) * abs(exact) * 1.01


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert radix_percentiles(df, ["g"], "v").collect() == []
    assert sketch_percentiles(sketch(df, ["g"], "v"), ["g"]).collect() == []


def test_each_run_once(spark):
    at = datetime(2026, 1, 1)
    rows = [(1, "m", "s", 5, at, at), (1, "m", "s", 5, at, datetime(2026, 1, 3)), (2, "m", "s", -1, at, at), (3, "m", "s", 2147483647, at, at), (4, "m", None, None, at, at), (5, None, None, 0, None, None), (None, "m", "s", 5, at, at)]
    df = spark.createDataFrame(rows, "run_id bigint, retrieval_mode string, completion_status string, duration_ms int, created_at timestamp_ntz, logged_at timestamp_ntz")
    assert sorted(r.duration_ms for r in usable_runs(df).collect()) == [0, 5]
