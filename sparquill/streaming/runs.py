"""The run log as a stream: deduplication, windows, sessions, liveness, and incremental ingest.

Event times without zone are read as UTC. A watermark bounds all state, as long
as a stream is drained in append or update mode; complete mode keeps everything
and is for results that are small whatever comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparquill.scratch import Scratch


def read_log(spark: SparkSession, path: str, time_col: str = "created_at", delay: str = "7 days", files_per_trigger: int = 100, marks: str | None = None) -> DataFrame:
    """The Parquet files of a folder (or one file) as a stream with a watermark on ``time_col``.

    Rows that ``end_log`` puts into the folder ``marks`` later on belong to the
    stream too, so that it can be told how far time has come.
    """
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream takes a plain path for a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    if marks:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(marks)
        rows = rows.unionByName(spark.readStream.schema(schema).parquet(marks))
    return rows.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)


def end_log(spark: SparkSession, path: str, marks: str, time_col: str, at) -> None:
    """Tells a stream of ``read_log`` with ``marks`` that time has come to ``at``, by a row without anything else."""
    schema = spark.read.parquet(path).schema
    spark.range(1).select(*((F.lit(at) if f.name == time_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(marks)


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, as long as the watermark remembers it."""
    return rows.dropDuplicatesWithinWatermark(keys)


def tumbling_totals(rows: DataFrame, by: list[str], time_col: str = "created_at", size: str = "1 day") -> DataFrame:
    out = rows.groupBy(F.window(time_col, size), *by).agg(F.count("*").alias("runs"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "runs")


def sliding_histogram(rows: DataFrame, by: list[str], value: str = "duration_ms", time_col: str = "created_at", size: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """(start, by.., v, c): how often each usable duration occurs in each sliding window.

    Such counts add up, so the state is a row per distinct value and window and
    never a list; ``operators.runs.histogram_percentiles`` reads any percentile
    from them.
    """
    usable = rows.filter((F.col(value) >= 0) & (F.col(value) < 2147483647))
    out = usable.groupBy(F.window(time_col, size, slide), *by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    return out.select(F.col("window.start").alias("start"), *by, "v", "c")


def sessions(rows: DataFrame, key: str, time_col: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of rows of one key with no gap of ``gap`` or more between them."""
    out = rows.groupBy(F.session_window(time_col, gap), key).agg(F.count("*").alias("rows"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "rows")


def liveness(beats: DataFrame, key: str = "instance_id", time_col: str = "created_at", expiry: str = "30 seconds") -> DataFrame:
    """(key, state, at, beats): 'alive' for each batch that brings beats of a key, 'expired' once none came for ``expiry`` of event time."""
    wait = int(pd.Timedelta(expiry).total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "state": ["expired"], "at": [pd.Timestamp(last + wait, unit="ms")], "beats": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf[time_col].max().timestamp() * 1000))
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "state": ["alive"], "at": [pd.Timestamp(last, unit="ms")], "beats": [n]})

    rows = beats.filter(F.col(key).isNotNull()).select(key, time_col)
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, at timestamp, beats bigint", "last bigint, beats bigint", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(files: DataFrame, publish: Any, checkpoint: str) -> Any:
    """Each micro-batch of files goes through ``publish(batch, batch_id)``, which must be idempotent per batch id."""
    return files.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "complete", keys: list[str] | None = None, then: Any = None) -> DataFrame:
    """Runs a stream over all there is and returns the table it wrote in the shared folder.

    With ``keys`` the stream runs in update mode: each micro-batch appends the
    rows that changed, and the table has the last row of each key; a batch that
    is written again after a failure replaces itself. ``then`` is called once
    all is read, after which the stream goes on with what is new, say the end of
    the log, which lets go of what append mode holds back.
    """
    spark = stream.sparkSession
    root = f"{Scratch(spark).root}/{name}"
    mode = "update" if keys else mode

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={batch}")

    write(spark.createDataFrame([], stream.schema), -1)  # a stream without rows has a table too
    for step in (None, then) if then else (None,):
        if step:
            step()
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return out.select(*stream.columns)
