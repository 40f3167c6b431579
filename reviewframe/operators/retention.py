"""One retention run over audit log and cache listing."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.audit_log import audit_append, audit_read, enforce_retention, retain
from ..sources.cache import cache_manifest


def _result(storage: str, purge: Callable[[], int]) -> tuple[str, int | None, str, str | None]:
    """(storage, purged, status, error): one kind that fails doesn't keep the others from being purged."""
    try:
        return storage, purge(), "ok", None
    except (PySparkException, OSError, ValueError) as e:
        return storage, None, "error", str(e)


def retention_job(spark, audit_path: str, kept_path: str | None, cache_dirs: list[str], now: datetime,
                  audit_days: int = 90, cache_days: int = 30,
                  actor: str = "retention") -> tuple[DataFrame, DataFrame]:
    """(summary, cache manifest); the summary has storage, purged, status (ok or error) and error.

    Without ``kept_path`` the log is purged in place, by days; with it the kept entries are written there. The
    run is logged where the entries are. Running it again purges nothing more.
    """
    held: list[DataFrame] = []

    def stale() -> int:
        held.append(cache_manifest(spark, cache_dirs, now - timedelta(days=cache_days)))
        return held[0].count()

    def expired() -> int:
        return retain(spark, audit_path, now, audit_days) if kept_path is None else enforce_retention(
            spark, audit_path, kept_path, now, audit_days)

    results = [_result("audit_logs", expired), _result("cache_files", stale)]
    summary = spark.createDataFrame(results, "storage string, purged bigint, status string, error string")
    data = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "storage", F.struct("purged", "status", "error"))))))
    audit_append(summary.agg(data.alias("data")).select(
        F.lit("retention_policy_run").alias("event"), "data"), kept_path or audit_path, actor)
    return summary, held[0] if held else spark.createDataFrame([], "path string, modified_at timestamp")


def retention_preview(spark, audit_path: str, now: datetime, days: int) -> DataFrame:
    """How many entries per event would expire."""
    cutoff = now - timedelta(days=days)
    return (audit_read(spark, audit_path).filter(F.col("ts") < F.lit(cutoff))
            .groupBy("event").agg(F.count(F.lit(1)).alias("expiring")))
