from datetime import datetime, timedelta

from sparquill.operators.runs import histogram_percentiles
from sparquill.streaming import runs

START = datetime(2026, 1, 1)
SCHEMA = "run_id bigint, tool string, instance_id string, duration_ms int, created_at timestamp_ntz"


def write(spark, path, rows, name, mode="error"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/{name}")


def log(spark, tmp_path, **kw):
    return runs.read_log(spark, f"{tmp_path}/*", **kw)


def test_totals_and_duplicates(spark, tmp_path):
    rows = [(i // 2, "a", "x", 5, START + timedelta(hours=i)) for i in range(48)]
    rows = [(r[0], *r[1:4], START + timedelta(hours=r[0])) for r in rows]
    write(spark, tmp_path, rows, "one")
    stream = runs.read_log(spark, f"{tmp_path}/one")
    got = runs.drain(runs.tumbling_totals(stream, ["tool"]), "t").collect()
    assert [(r.tool, r.runs) for r in got] == [("a", 48)]
    assert runs.drain(runs.once(stream, ["run_id"]).select("run_id"), "o", "append").count() == 24


def test_sessions(spark, tmp_path):
    minutes = [0, 10, 20, 200, 210]
    write(spark, tmp_path, [(i, "a", "x", 5, START + timedelta(minutes=m)) for i, m in enumerate(minutes)], "one")
    got = runs.drain(runs.sessions(runs.read_log(spark, f"{tmp_path}/one"), "instance_id", "created_at"), "s").collect()
    assert sorted(r.rows for r in got) == [2, 3]


def test_ingest_is_incremental(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")
    write(spark, source, [(1, "a", "x", 5, START)], "one")
    publish = lambda df, i: df.write.mode("append").parquet(table)
    again = lambda: runs.ingest(spark.readStream.schema(SCHEMA).parquet(f"{source}/*"), publish, str(tmp_path / "state")).awaitTermination()
    again()
    write(spark, source, [(2, "a", "x", 5, START)], "two")
    again()
    assert sorted(r.run_id for r in spark.read.parquet(table).collect()) == [1, 2]


def test_updates_keep_the_last_row_of_a_key(spark, tmp_path):
    for k in range(3):
        write(spark, tmp_path, [(k, "a", "x", 5, START + timedelta(minutes=k)), (10 + k, "b", "x", k, START + timedelta(days=k))], "parts", "append")
    stream = runs.read_log(spark, f"{tmp_path}/parts", files_per_trigger=1)
    got = runs.drain(runs.tumbling_totals(stream, ["tool"]), "u", keys=["start", "end", "tool"]).collect()
    assert sorted((r.tool, r.runs) for r in got) == [("a", 3), ("b", 1), ("b", 1), ("b", 1)]
    counts = runs.drain(runs.sliding_histogram(stream, ["tool"], size="10 days", slide="10 days"), "h", keys=["start", "tool", "v"])
    assert sorted((r.tool, r.v, r.c) for r in counts.collect()) == [("a", 5, 3), ("b", 0, 1), ("b", 1, 1), ("b", 2, 1)]
    p = {r.tool: (r.p50, r.p95) for r in histogram_percentiles(counts, ["tool"]).collect()}
    assert p == {"a": (5.0, 5.0), "b": (1.0, 1.9)}


def test_the_end_of_the_log_ends_sessions(spark, tmp_path):
    write(spark, tmp_path, [(i, "a", "x", 5, START + timedelta(minutes=m)) for i, m in enumerate([0, 10, 200])], "one")
    marks = f"{tmp_path}/marks"
    stream = runs.read_log(spark, f"{tmp_path}/one", marks=marks)
    end = lambda: runs.end_log(spark, f"{tmp_path}/one", marks, "created_at", START + timedelta(days=99))
    got = runs.drain(runs.sessions(stream, "instance_id", "created_at"), "e", "append", then=end).collect()
    assert sorted(r.rows for r in got if r.instance_id) == [1, 2]


def test_an_instance_without_beats_expires(spark, tmp_path):
    rows = [(1, "a", "gone", 5, START), (2, "a", "gone", 5, START + timedelta(seconds=5)), (3, "a", "here", 5, START + timedelta(days=30))]
    write(spark, tmp_path, rows, "one")
    got = runs.drain(runs.liveness(runs.read_log(spark, f"{tmp_path}/one", delay="1 hour")), "l", "append").collect()
    assert sorted((r.instance_id, r.state, r.beats) for r in got) == [("gone", "alive", 2), ("gone", "expired", 2), ("here", "alive", 1)]
