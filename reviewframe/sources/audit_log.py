"""JSON-lines audit log on a file system.

Lines land under ``dt``/``epoch`` folders: the day of the entry (UTC) and the append or micro-batch that wrote
it. Each line is given its place in the order of arrival once, as it lands: the field ``seq`` (time of the
append, task, position). It stays part of the line, whoever writes the line anew. Files without a day, from
other writers, may lie beside the folders; their lines have no place and come first, by time and text.

Retention commits versions under ``_retention``, which readers of the log pass over: the first day that is
kept, the epochs of that day that were replaced, and the one that replaced them. Earlier days are gone for
readers with the commit, as folders; later days keep their files. Until the commit nothing has changed.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.audit import audit_retention, parse_audit

_VERSION = "version bigint, first_day string, replaced array<string>, live string, purged bigint"


def _or_none(read) -> DataFrame | None:
    """What ``read`` gives, or nothing where there are no such files."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def retained(spark: SparkSession, path: str):
    """The newest committed version of the log's retention, as a row; none before the first one."""
    held = _or_none(lambda: spark.read.schema(_VERSION).parquet(f"{path}/_retention/version=*"))
    return None if held is None else held.orderBy(F.desc("version")).first()


def _lines(spark: SparkSession, path: str, since: datetime | None) -> DataFrame:
    """(value, dt, epoch) of the lines that are kept; days and epochs are left out by their folders."""
    days = _or_none(lambda: spark.read.option("basePath", path).schema("value string, dt string, epoch string").text(
        f"{path}/dt=*"))
    flat = _or_none(lambda: spark.read.text(f"{path}/*.*"))
    none = spark.createDataFrame([], "value string, dt string, epoch string")
    flat = none if flat is None else flat.select("value", F.lit(None).cast("string").alias("dt"),
                                                 F.lit(None).cast("string").alias("epoch"))
    if days is None:
        return flat
    version = retained(spark, path)
    if version is None:
        days = days.filter(~F.col("epoch").startswith("r"))
    else:
        days = days.filter((F.col("dt") >= version["first_day"]) & (
            ~F.col("epoch").startswith("r") | (F.col("epoch") == F.lit(version["live"]))))
        if version["replaced"]:
            days = days.filter((F.col("dt") > version["first_day"]) | ~F.col("epoch").isin(version["replaced"]))
    if since is not None:
        days = days.filter(F.col("dt") >= f"{_utc(since):%Y-%m-%d}")
    return days.unionByName(flat)


def _utc(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc) if moment.tzinfo else moment


def audit_read(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """Log entries with ``log_pos``, a sortable position: place of arrival, then time and text.

    With ``since`` earlier days are left out by their folders; entries of that day may be earlier. Lines
    without a day, or in files without one, are always read.
    """
    found = parse_audit(_lines(spark, path, since).drop("dt", "epoch"))
    place = F.when(~F.col("malformed"), F.get_json_object("raw", "$.seq"))
    return found.withColumn("log_pos", F.struct(place.alias("seq"), F.col("ts"), F.col("raw")))


def audit_lines(rows: DataFrame, default_actor: str, enabled: bool = True) -> DataFrame:
    """(dt, value) log lines out of rows (event, data JSON or null[, actor][, ts]).

    Time defaults to now; a disabled log takes nothing.
    """
    ts = F.coalesce("ts", F.current_timestamp()) if "ts" in rows.columns else F.current_timestamp()
    actor = F.lit(default_actor)
    if "actor" in rows.columns:
        actor = F.coalesce(F.nullif("actor", F.lit("")), actor)
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    stamp = F.regexp_replace(stamp, "Z$", "+00:00")
    head = F.to_json(F.struct(stamp.alias("ts"), F.col("event"), actor.alias("actor")))
    # The data column already is JSON text, so it is spliced in rather than quoted again.
    value = F.concat(F.left(head, F.length(head) - 1), F.lit(',"data":'),
                     F.coalesce(F.nullif("data", F.lit("")), F.lit("{}")), F.lit("}"))
    lines = rows.select(F.date_format(ts, "yyyy-MM-dd").alias("dt"), value.alias("value"))
    return lines if enabled else lines.filter(F.lit(False))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their place of arrival as the last field."""
    place = F.concat(F.lpad(F.unix_micros(F.current_timestamp()).cast("string"), 17, "0"), F.lit("-"),
                     F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0"))
    return lines.withColumn("value", F.concat(F.expr("left(value, length(value) - 1)"), F.lit(',"seq":"'), place,
                                              F.lit('"}')))


def audit_append(rows: DataFrame, path: str, default_actor: str, enabled: bool = True) -> None:
    """Appends log lines under day and epoch folders; a busy day is written by several tasks."""
    epoch = F.concat(F.lit("a"), F.unix_micros(F.current_timestamp()).cast("string"))
    (_placed(audit_lines(rows, default_actor, enabled)).withColumn("epoch", epoch).hint("rebalance", "dt")
     .write.mode("append").partitionBy("dt", "epoch").text(path))


def append_batch(rows: DataFrame, path: str, default_actor: str, batch_id: int) -> None:
    """Appends a micro-batch; a repeated attempt overwrites its own folders."""
    (_placed(audit_lines(rows, default_actor)).withColumn("epoch", F.lit(f"s{batch_id:012d}"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "epoch").text(path))


def retain(spark: SparkSession, path: str, now: datetime, days: int) -> int:
    """Drops the entries older than ``days`` in place; returns their number.

    Only the day of the cut is written anew, into an epoch of its own, and read for its times; of earlier
    days the lines are counted. The version that is written last makes it so, and repeating a run that broke
    before changes nothing else. Lines in files without a day stay. ``dead_folders`` names what may be removed.
    """
    cutoff = (_utc(now) if now.tzinfo else now) - timedelta(days=days)
    day = f"{cutoff:%Y-%m-%d}"
    before = retained(spark, path)
    if before is not None and before["first_day"] > day:
        return 0
    number = 1 if before is None else before["version"] + 1
    dated = _lines(spark, path, None).filter("dt IS NOT NULL")
    if dated.isEmpty():
        return 0
    edge = dated.filter(F.col("dt") == day)
    replaced = [r["epoch"] for r in edge.select("epoch").distinct().collect()]
    kept, purged = audit_retention(parse_audit(edge.select("value")), cutoff, 0)
    gone = dated.filter((F.col("dt") < day) & F.col("value").rlike(r"(?U)\S")).count() + purged.first()["purged"]
    live = f"r{number:012d}"
    (kept.select(F.lit(day).alias("dt"), F.lit(live).alias("epoch"), F.col("raw").alias("value")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("dt", "epoch").text(path))
    if before is not None and before["first_day"] == day:
        replaced += before["replaced"]
    version = spark.createDataFrame([(number, day, replaced, live, gone)], _VERSION)
    version.coalesce(1).write.mode("overwrite").parquet(f"{path}/_retention/version={number:012d}")
    return gone


def dead_folders(spark: SparkSession, path: str) -> DataFrame:
    """(dt, epoch) of folders that no reader sees any more, for whoever removes files."""
    folders = spark.read.option("basePath", path).schema("value string, dt string, epoch string").text(
        f"{path}/dt=*").select("dt", "epoch").distinct()
    return folders.join(_lines(spark, path, None).select("dt", "epoch").distinct(), ["dt", "epoch"], "left_anti")


def enforce_retention(spark: SparkSession, path: str, kept_path: str, now: datetime,
                      days: int) -> int:
    """Writes the entries that stay to ``kept_path`` (never the folder being read); returns the
    number purged. Swapping the folders is the caller's step."""
    audit = audit_read(spark, path)
    kept, purged = audit_retention(audit, now, days)
    (kept.select(F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown")).alias("dt"),
                 F.col("raw").alias("value"), "log_pos", F.lit("kept").alias("epoch"))
     .hint("rebalance", "dt").sortWithinPartitions("dt", "log_pos").select("dt", "epoch", "value")
     .write.mode("overwrite").partitionBy("dt", "epoch").text(kept_path))
    return purged.first()["purged"]
