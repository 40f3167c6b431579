"""Audit rows as a stream: an append-only log and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..sources.audit_log import append_batch


def audit_append_stream(rows: DataFrame, path: str, checkpoint: str,
                        default_actor: str) -> StreamingQuery:
    """Appends (event, data[, actor][, ts]) rows as log lines under day and epoch folders."""
    return (rows.writeStream.foreachBatch(lambda batch, n: append_batch(batch, path, default_actor, n))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


_COUNTS = "event string, entries bigint, batch bigint, slot int"


def audit_counts_stream(entries: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running count per event; the newest row per event in ``out`` is its current count.

    Each micro-batch merges its changed counts with the last snapshot into a new one. Snapshots take turns in
    two folders, so what is kept, and read for the current count, doesn't grow with the number of batches. A
    repeated attempt reads the same earlier snapshot and overwrites its own.
    """
    counts = (entries.groupBy(F.coalesce("event", F.lit("unknown")).alias("event"))
              .agg(F.count(F.lit(1)).alias("entries")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        slot = batch_id % 2
        whole = batch.select("event", "entries")
        try:
            last = batch.sparkSession.read.schema(_COUNTS).parquet(out).filter(
                (F.col("slot") == 1 - slot) & (F.col("batch") < batch_id))
            whole = whole.unionByName(last.select("event", "entries").join(batch.select("event"), "event", "left_anti"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        (whole.withColumn("batch", F.lit(batch_id).cast("bigint")).withColumn("slot", F.lit(slot)).coalesce(1)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(out))

    return (counts.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_counts(counts: DataFrame) -> DataFrame:
    """The latest count per event out of the sink of ``audit_counts_stream``."""
    return counts.groupBy("event").agg(F.max_by("entries", "batch").alias("entries"))
