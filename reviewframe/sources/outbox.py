"""Comments as provider requests, ready for whatever posts them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import render_comment, render_fallback
from ..operators.comments import provider_payload


def review_outbox(comments: DataFrame, reviews: DataFrame, marker: str) -> DataFrame:
    """One request per comment: payload, general-comment fallback and whether it can be sent.

    ``reviews``: review_id, vcs, repo, pr_number, head_sha and optionally base_sha, start_sha. One
    provider takes no defaults: path, line, severity and body must all be there.
    """
    for name in ("base_sha", "start_sha"):
        if name not in reviews.columns:
            reviews = reviews.withColumn(name, F.lit(None).cast("string"))
    joined = comments.join(reviews.select("review_id", "vcs", "repo", "pr_number", "head_sha",
                                          "base_sha", "start_sha"), "review_id")
    vcs = F.col("vcs")
    complete = (F.col("file_path").isNotNull() & F.col("line").isNotNull()
                & F.col("severity").isNotNull() & F.col("body").isNotNull())
    text = render_comment(F.col("severity"), F.col("body"), marker)
    path, line = F.coalesce("file_path", F.lit("")), F.coalesce("line", F.lit(1))
    fallback = (F.when(vcs == "gitlab", render_fallback(path, line, text, bold=True))
                .when(vcs == "bitbucket", render_fallback(path, line, text)).otherwise(text))
    return joined.select("review_id", "seq", "vcs", "repo", "pr_number",
                         provider_payload(vcs, marker).alias("payload"),
                         fallback.alias("fallback"),
                         ((vcs != "github") | complete).alias("sendable"))


def write_outbox(outbox: DataFrame, path: str) -> None:
    outbox.hint("rebalance", "vcs").write.mode("append").partitionBy("vcs").json(path)
