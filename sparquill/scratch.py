"""Where iterative operators cut their lineage.

A materialised step is a Parquet table in the folder that the cluster shares
(``spark.checkpoint.dir``), so a lost executor costs a re-read and not a
recomputation, and nothing is kept on one machine only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, SparkSession] = {}

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a fresh temporary one only where none is set (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='sparquill-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows of a narrow kept table (keys, 8 to 24 bytes each) that are sent to every executor at most.
BROADCAST_ROWS = 1_000_000


def bounded(kept: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The kept table with a broadcast hint if it has no more than ``rows`` rows; as it is, to be joined by shuffling, if it has."""
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


class Scratch:
    """Materialised steps of one operator run.

    ``keep(df)`` writes ``df`` once and returns it as read back; ``drop(df)``
    frees a step that nothing reads any more. What is left is removed when the
    Python process ends. With ``free_shuffles`` the shuffle files of a step go
    as soon as it is written, and not when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, free_shuffles: bool = False):
        self.spark = spark
        self.free_shuffles = free_shuffles
        self.root = f"{shared_dir(spark)}/sparquill-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        _OWN[self.root] = spark

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        conf, before = self.spark.conf, self.spark.conf.get(_FREE_SHUFFLES, "false")
        if self.free_shuffles:
            conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(_FREE_SHUFFLES, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, *steps: DataFrame) -> None:
        for df in steps:
            if path := self._paths.pop(id(df), None):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for root, spark in _OWN.items():
        try:
            _delete(spark, root)
        except Exception:  # the session has ended already
            pass
