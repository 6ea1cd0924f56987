"""Intermediate tables in the folder that all executors share.

Multi-step operators cut their lineage by writing a table below ``spark.checkpoint.dir`` and
reading it again, so a lost executor costs a re-read and not a recomputation of all steps.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only where it is unset and all tasks run in one process."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return there or tempfile.mkdtemp(prefix="corpusmill-")


@contextmanager
def _released_shuffles(spark: SparkSession):
    """Shuffle files of a finished write are dropped at once: its result is on disk already."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """A private folder of intermediate tables, removed when the driver ends (or by ``close``)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/corpusmill-{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Writes ``df`` and returns it as a plain table scan."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{label}"
        with _released_shuffles(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table made by ``keep`` that nothing reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.path)
        except Exception:  # the session has ended already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
