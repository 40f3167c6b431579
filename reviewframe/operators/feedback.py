"""Statistics over earlier review comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_review(service: str) -> Column:
    return F.lit(f"This is the first {service} review on this PR.")


def feedback_summary(service: str) -> Column:
    told = F.concat(
        F.lit(f"FEEDBACK CONTEXT: {service} previously posted "),
        F.col("total_previous").cast("string"), F.lit(" comments on this PR. "),
        F.col("resolved").cast("string"), F.lit(" were resolved by the developer (accepted), "),
        F.col("open").cast("string"), F.lit(" are still open. Previously flagged files: "),
        F.array_join("previously_flagged_files", ", "),
        F.lit(". Avoid re-posting the same issues on unchanged lines."))
    return F.when(F.col("total_previous") > 0, told).otherwise(first_review(service))


def feedback_stats(posted: DataFrame, marker: str, service: str = "the reviewer") -> DataFrame:
    """Per review, over comments carrying ``marker``: total, resolved, open, files, summary.

    Reviews without own comments appear with zeros. Counting per (review, path) first lets the map
    side combine, so only distinct paths travel to the review level.
    """
    own = F.coalesce(F.col("body").contains(marker), F.lit(False))
    replied = own & (F.coalesce("in_reply_to_id", F.lit(0)) != 0)
    per_path = posted.groupBy("review_id", "path").agg(
        F.count_if(own).alias("n"), F.count_if(replied).alias("r"))
    stats = per_path.groupBy("review_id").agg(
        F.sum("n").alias("total_previous"), F.sum("r").alias("resolved"),
        F.lit(0).cast("bigint").alias("dismissed"),
        F.sum(F.col("n") - F.col("r")).alias("open"),
        F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("path"))))
        .alias("previously_flagged_files"))
    return stats.withColumn("summary", feedback_summary(service))
