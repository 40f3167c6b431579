"""Deliveries as a stream: gates, limiter, and two sinks (requests and audit lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as fx
from ..operators.webhooks import normalise_webhooks, outcome_audit
from ..sources.audit_log import append_batch
from .limiter import rate_limit_stream

_REQUEST = ["review_id", "vcs", "repo", "pr_number", "head_sha", "project_id", "comment_body",
            "comment_id", "received_at"]


def webhook_stream(deliveries: DataFrame, self_name: str, secrets: dict[str, str], out: str,
                   checkpoint: str, max_requests: int = fx.RATE_LIMIT_REQUESTS,
                   window_seconds: int = fx.RATE_LIMIT_WINDOW_SECONDS,
                   actor: str = "webhooks") -> StreamingQuery:
    """Starts the stream. Per micro-batch: accepted requests to ``out``/requests, every outcome to
    ``out``/outcomes, and audit lines to ``out``/audit.

    Deliveries are normalised and landed in ``out``/landed first, each with a key of its own. The limiter reads
    that table as a stream and takes key, repo and time alone; its decisions meet the landed fields again in
    the sink. Each batch owns a partition that a repeated attempt overwrites, so the sinks hold every batch
    exactly once, as the landed table's own log does.
    """
    spark = deliveries.sparkSession
    normal = normalise_webhooks(deliveries, self_name, secrets).select("delivery_id", "outcome", *_REQUEST)
    normal = normal.withColumn("row", F.expr("uuid()")).withColumn("hour", F.date_format("received_at", "yyyyMMddHH"))
    (normal.writeStream.format("parquet").partitionBy("hour").option("path", f"{out}/landed")
     .option("checkpointLocation", f"{checkpoint}/landed").trigger(availableNow=True).start().awaitTermination())
    landed = spark.readStream.schema(normal.schema).parquet(f"{out}/landed")
    asked = landed.filter("outcome = 'accepted'").select(
        F.concat_ws("/", "hour", "row").alias("request_id"), F.col("repo").alias("key"),
        F.unix_micros("received_at").alias("t"))
    decided = rate_limit_stream(asked, max_requests, window_seconds).select(
        "request_id", F.when(F.col("allowed"), "accepted").otherwise("rate_limited").alias("decision"))
    # What no limiter sees: rejected and ignored deliveries.
    dropped = landed.filter("outcome <> 'accepted'").select(
        F.concat_ws("/", "hour", "row").alias("request_id"), F.col("outcome").alias("decision"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(F.element_at(F.split("request_id", "/"), -1).alias("row"),
                             F.when(F.contains(F.col("request_id"), F.lit("/")), F.substring_index("request_id", "/", 1)).alias(
                                 "hour"), "decision").persist()
        fields = spark.read.schema(normal.schema).parquet(f"{out}/landed").drop("outcome")
        span = batch.agg(F.min("hour").alias("low"), F.max("hour").alias("high"), F.count_if(F.col("hour").isNull()).alias(
            "n")).first()
        # Only the landed hours that the batch is about are read.
        fields = fields.filter(F.col("hour").between(span["low"], span["high"]) | (
            F.col("hour").isNull() & F.lit(span["n"] > 0)))
        rows = batch.join(fields, batch["row"].eqNullSafe(fields["row"])).select(
            "delivery_id", F.col("decision").alias("outcome"), *_REQUEST).withColumn("batch", F.lit(batch_id)).persist()

        def write(found: DataFrame, name: str) -> None:
            (found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch").parquet(f"{out}/{name}"))

        write(rows.select("delivery_id", "vcs", "repo", "outcome", "batch"), "outcomes")
        write(rows.filter("outcome = 'accepted'").drop("outcome"), "requests")
        append_batch(outcome_audit(rows).withColumnRenamed("received_at", "ts"), f"{out}/audit", actor, batch_id)
        rows.unpersist()
        batch.unpersist()

    return (decided.unionByName(dropped).writeStream.foreachBatch(sink)
            .option("checkpointLocation", f"{checkpoint}/decided").trigger(availableNow=True).start())
