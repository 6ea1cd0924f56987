"""Incremental scoring: new files are scored once and appended; a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def score_stream(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "id"):
    """Reads parquet files as they come, drops repeated keys, scores and appends to parquet.

    Runs over what is there and ends; the checkpoint keeps which files are done.  Each micro-batch
    writes its own folder ``batch=<n>`` with overwrite, so a batch that is repeated after a failure is not doubled.
    A repeated key is found in the keys of the other batches' folders, and not in a state that grows for ever;
    ``score`` must keep the key.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, n: int) -> None:
        new, own = batch.dropDuplicates([key]), f"{sink}/batch={n}"
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(sink)
        there = path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration())
        others = [str(f.getPath()) for f in there.listStatus(path)] if there.exists(path) else []
        others = [p for p in others if p.rsplit("/", 1)[-1].startswith("batch=") and not p.endswith(f"/batch={n}")]
        if others:
            new = new.join(batch.sparkSession.read.parquet(*others).select(key), key, "left_anti")
        score(new).write.mode("overwrite").parquet(own)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
