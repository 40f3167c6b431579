"""Webhook deliveries in, gated requests and their audit trail out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..operators.rate import rate_refusals
from ..operators.webhooks import delivery_outcome, normalise_webhooks
from ..session import materialise


def gate_deliveries(deliveries: DataFrame, self_name: str, secrets: dict[str, str],
                    max_requests: int = fx.RATE_LIMIT_REQUESTS,
                    window_seconds: int = fx.RATE_LIMIT_WINDOW_SECONDS) -> DataFrame:
    """All gates in order, the limiter last.

    The bodies are parsed and their signatures computed once: the normalised rows, without bodies,
    are written to the shared folder and the limiter's passes read those. Each row gets a key of its
    own as it is written, so repeated and missing delivery ids stay rows of their own.
    """
    spark = deliveries.sparkSession
    normal = materialise(spark, normalise_webhooks(deliveries, self_name, secrets).withColumn(
        "_row", F.monotonically_increasing_id().cast("string")), "deliveries")
    asked = normal.filter("outcome = 'accepted'").select(
        F.col("_row").alias("request_id"), F.col("repo").alias("key"),
        F.col("received_at").alias("ts"))
    return delivery_outcome(normal, rate_refusals(asked, max_requests, window_seconds), "_row").drop("_row")
