"""Audit log: parsing, queries, statistics, retention and run pairing."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import is_broken, parse_record, record_of
from ..functions.once import computed
from ..functions.text import parse_ts

_ENTRY = "ts: STRING, event: STRING, actor: STRING, data: STRING"


def parse_audit(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Log lines to typed entries; blank lines vanish, unreadable ones stay with ``malformed``."""
    rest = [c for c in lines.columns if c != line_col]
    # A cheap test on the scan; the trimmed text is computed once, below.
    raw = F.regexp_replace(F.col(line_col), r"(?U)\A\s+|\s+\z", "")
    trimmed = computed(lines.filter(F.col(line_col).rlike(r"(?U)\S")), rest, raw=raw)
    parsed = computed(trimmed, [*rest, "raw"], p=parse_record(F.col("raw"), _ENTRY))
    ok = ~F.col("malformed")
    parsed = parsed.select(*rest, "raw", is_broken(F.col("p")).alias("malformed"),
                           record_of(F.col("p")).alias("e"))
    return parsed.select(*rest, F.when(ok, parse_ts(F.col("e.ts"))).alias("ts"),
                         F.when(ok, F.col("e.event")).alias("event"),
                         F.when(ok, F.col("e.actor")).alias("actor"),
                         F.when(ok, F.col("e.data")).alias("data"), "raw", "malformed")


def data_field(name: str) -> Column:
    return F.get_json_object("data", f"$.{name}")


def pr_number() -> Column:
    """The pull-request number, which one provider logs under another key."""
    return F.coalesce(data_field("pr_number"), data_field("mr_iid")).try_cast("bigint")


def _utc(moment: datetime) -> datetime:
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def audit_query(audit: DataFrame, event: str | None = None, repo: str | None = None,
                since: datetime | None = None, limit: int = 100) -> DataFrame:
    """First ``limit`` matching entries in log order (a per-task top-n, never a full sort)."""
    hits = audit.filter(~F.col("malformed"))
    if event:
        hits = hits.filter(F.col("event") == event)
    if repo:
        hits = hits.filter(data_field("repo") == repo)
    if since:
        hits = hits.filter(F.col("ts") >= F.lit(_utc(since)))
    return hits.orderBy("log_pos").limit(limit)


def audit_stats(audit: DataFrame) -> DataFrame:
    """Entries per event; the row with event null is the total."""
    counts = (audit.filter(~F.col("malformed"))
              .groupBy(F.coalesce("event", F.lit("unknown")).alias("event"))
              .agg(F.count(F.lit(1)).alias("entries")))
    return counts.rollup("event").agg(F.sum("entries").alias("entries"))


def _expired(now: datetime, days: int) -> Column:
    cutoff = _utc(now) - timedelta(days=days)
    return F.coalesce(F.col("ts") < F.lit(cutoff), F.lit(False))


def audit_retention(audit: DataFrame, now: datetime, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept entries, one-row purge count); entries without a readable time are kept."""
    expired = _expired(now, days)
    purged = audit.agg(F.count_if(expired).alias("purged"))
    return audit.filter(~expired), purged


def retention_summary(audit: DataFrame, manifest: DataFrame, now: datetime,
                      days: int) -> DataFrame:
    """One row per storage kind with the number of items that expire."""
    _, purged = audit_retention(audit, now, days)
    logs = purged.select(F.lit("audit_logs").alias("storage"), "purged")
    files = manifest.agg(F.count(F.lit(1)).alias("purged")).select(
        F.lit("cache_files").alias("storage"), "purged")
    return logs.unionByName(files).withColumn("status", F.lit("ok"))


def review_runs(audit: DataFrame) -> DataFrame:
    """Start, end and result of each review task.

    Everything is a per-task minimum or maximum, combined on the map side.
    """
    event = F.col("event")
    rows = audit.filter(event.isin("review_started", "review_completed", "review_task_failed",
                                   "review_task_succeeded"))
    rows = rows.withColumn("task_id", data_field("task_id")).filter("task_id IS NOT NULL")
    ended = F.col("ts")
    runs = rows.groupBy("task_id").agg(
        F.max(data_field("vcs")).alias("vcs"), F.max(data_field("repo")).alias("repo"),
        F.max(pr_number()).alias("pr_number"),
        F.min(F.when(event == "review_started", ended)).alias("started_at"),
        F.max(F.when(event != "review_started", ended)).alias("ended_at"),
        F.max(F.when(event == "review_task_failed", 1).otherwise(0)).alias("_failed"),
        F.max(F.when(event.isin("review_completed", "review_task_succeeded"), 1).otherwise(0))
        .alias("_done"),
        F.max(data_field("comments_posted").try_cast("bigint")).alias("comments_posted"),
        F.max(data_field("duration_ms").try_cast("bigint")).alias("logged_ms"))
    elapsed = F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000)
    return runs.select(
        "task_id", "vcs", "repo", "pr_number", "started_at", "ended_at",
        F.when(F.col("_done") == 1, "completed").when(F.col("_failed") == 1, "failed")
        .otherwise("running").alias("status"),
        F.coalesce("logged_ms", elapsed).alias("duration_ms"),
        F.coalesce("comments_posted", F.lit(0)).alias("comments_posted"))
