"""Write leases as a log of events: what each request for a lease came to, and who holds one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay_leases(events: DataFrame, expiry_seconds: int = 30) -> DataFrame:
    """(resource, holder, kind, at, outcome) of events of the kinds acquire, renew and release.

    One holder at a time has a resource. An acquire is granted where nobody
    holds a live lease and otherwise a conflict (its own live lease included); a
    renewal extends the holder's live lease and is lost otherwise; a release
    ends it and is void otherwise. A lease lives ``expiry_seconds`` from its
    last grant or renewal. Events of one resource are taken in the order of
    time, holder and kind. Rows of a null resource, holder or time, and other
    kinds, are left out.

    A resource's events are streamed in order through one task, with a state of
    one holder; they are not gathered.
    """
    rows = events.filter(F.col("kind").isin("acquire", "renew", "release")).filter("resource IS NOT NULL AND holder IS NOT NULL AND at IS NOT NULL")
    rows = rows.select("resource", "holder", "kind", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "resource").sortWithinPartitions("resource", "us", "holder", "kind")
    wait = expiry_seconds * 1_000_000

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owner, until = None, None, 0
        for b in batches:
            out = []
            for resource, holder, kind, us in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if resource != now:
                    now, owner = resource, None
                live = owner is not None and us < until
                if kind == "acquire":
                    out.append("conflict" if live else "granted")
                    owner, until = (owner, until) if live else (holder, us + wait)
                elif kind == "renew":
                    mine = live and owner == holder
                    out.append("renewed" if mine else "lost")
                    until = us + wait if mine else until
                else:
                    mine = live and owner == holder
                    out.append("released" if mine else "void")
                    owner = None if mine else owner
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.string())], names=["resource", "holder", "kind", "at", "outcome"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(replay, ", ".join(f"{c} {kinds[c]}" for c in ("resource", "holder", "kind", "at")) + ", outcome string")


def live_leases(replayed: DataFrame, now, expiry_seconds: int = 30) -> DataFrame:
    """(resource, holder, since): the lease of each resource that is live at ``now``, from its grant or last renewal."""
    at = F.lit(now).cast(replayed.schema["at"].dataType)
    told = replayed.filter(F.col("outcome").isin("granted", "renewed", "released") & (F.col("at") <= at))
    w = Window.partitionBy("resource").orderBy(F.col("at").desc(), F.col("holder").desc(), F.col("kind").desc())
    last = told.withColumn("n", F.row_number().over(w)).filter("n = 1 AND outcome <> 'released'")
    return last.filter(F.col("at") + F.make_dt_interval(secs=F.lit(expiry_seconds)) > at).select("resource", "holder", F.col("at").alias("since"))


def instances_with_lease(instances: DataFrame, live: DataFrame) -> DataFrame:
    """The instances (instance_id, ..) with has_lease: whether a live lease is theirs."""
    held = live.select(F.col("holder").alias("instance_id"), F.lit(True).alias("has_lease")).distinct()
    return instances.join(held, "instance_id", "left").withColumn("has_lease", F.coalesce("has_lease", F.lit(False)))
