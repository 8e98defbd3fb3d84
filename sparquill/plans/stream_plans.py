"""Streams over the run log and the events, run over all there is."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparquill.operators.runs import histogram_percentiles
from sparquill.scratch import Scratch
from sparquill.session import table
from sparquill.streaming import runs


def _ntz(df, *cols):
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c) for c in df.columns))


def stream_daily_totals(spark, sf_dir):
    log = runs.read_log(spark, f"{sf_dir}/retrieval_runs.parquet", "created_at", "30 days")
    return _ntz(runs.drain(runs.tumbling_totals(log, ["tool", "completion_status"]), "daily", keys=["start", "end", "tool", "completion_status"]), "start", "end")


def stream_deduplicated_runs(spark, sf_dir):
    log = runs.once(runs.read_log(spark, f"{sf_dir}/retrieval_runs.parquet", "created_at", "30 days"), ["run_id"])
    return runs.drain(log.select("run_id", "retrieval_mode"), "once", "append")


def stream_sliding_latency(spark, sf_dir):
    log = runs.read_log(spark, f"{sf_dir}/retrieval_runs.parquet", "created_at", "30 days")
    by = ["start", "retrieval_mode"]
    counts = _ntz(runs.drain(runs.sliding_histogram(log, ["retrieval_mode"]), "sliding", keys=[*by, "v"]), "start")
    totals = counts.groupBy(*by).agg(F.sum("c").alias("runs"))
    return histogram_percentiles(counts, by).join(totals, by).select(*by, "runs", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))


def stream_event_sessions(spark, sf_dir):
    """Sessions are given out once they are over; the end of the log ends the last ones."""
    marks = f"{Scratch(spark).root}/marks"
    path, end = f"{sf_dir}/events.parquet", datetime(2100, 1, 1)
    events = runs.read_log(spark, path, "ts", "1 day", marks=marks)
    found = runs.drain(runs.sessions(events, "user_id", "ts", "2 hours"), "sessions", "append", then=lambda: runs.end_log(spark, path, marks, "ts", end))
    return _ntz(found, "start", "end").filter(F.col("start") < F.lit(end))


def stream_liveness(spark, sf_dir):
    """The last that was seen of each instance: beats, and whether it had expired an hour behind the newest beat of all."""
    log = runs.read_log(spark, f"{sf_dir}/retrieval_runs.parquet", "created_at", "1 hour")
    states = runs.drain(runs.liveness(log), "liveness", "append")
    last = F.max_by(F.struct("state", "beats"), F.struct("beats", F.col("state") == "expired")).alias("l")
    return states.groupBy("instance_id").agg(last).select("instance_id", "l.beats", (F.col("l.state") == "expired").alias("expired"))


def event_sessions(spark, sf_dir):
    """The same sessions in a batch, by windows."""
    from pyspark.sql import Window

    mine = Window.partitionBy("user_id").orderBy("ts")
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    gap = F.coalesce(F.col("ts") >= F.lag("ts").over(mine) + F.expr("INTERVAL 2 HOURS"), F.lit(True)).cast("int")
    marked = events.withColumn("new", gap).withColumn("session", F.sum("new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("user_id", "session").agg(F.min("ts").alias("start"), (F.max("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"), F.count("*").alias("rows"))
    return out.drop("session")


QUERIES = {f.__name__: f for f in (stream_daily_totals, stream_deduplicated_runs, stream_sliding_latency, stream_event_sessions, stream_liveness, event_sessions)}

_SESSIONS = """WITH m AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS rows FROM m GROUP BY user_id, s"""
SQL = {
    "stream_daily_totals": "SELECT date_trunc('day', created_at)::TIMESTAMP AS \"start\", date_trunc('day', created_at)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", tool, completion_status, count(*) AS runs FROM retrieval_runs GROUP BY ALL",
    "stream_deduplicated_runs": "SELECT DISTINCT run_id, retrieval_mode FROM retrieval_runs",
    "stream_sliding_latency": """WITH w AS (SELECT retrieval_mode, duration_ms, time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS "start" FROM retrieval_runs, range(4) t(k) WHERE duration_ms >= 0 AND duration_ms < 2147483647)
SELECT "start", retrieval_mode, count(*) AS runs, round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.95), 3) AS p95 FROM w GROUP BY ALL""",
    "stream_event_sessions": _SESSIONS,
    "stream_liveness": """SELECT instance_id, count(*) AS beats, date_trunc('milliseconds', max(created_at)) + INTERVAL 30 SECOND <= (SELECT date_trunc('milliseconds', max(created_at)) FROM retrieval_runs) - INTERVAL 1 HOUR AS expired
FROM retrieval_runs WHERE instance_id IS NOT NULL GROUP BY 1""",
    "event_sessions": _SESSIONS,
}
