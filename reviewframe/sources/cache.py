"""Listing of stale cache files."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(text: str) -> str:
    return re.sub(r"([\\{}\[\]*?,^])", r"\\\1", text)


def _patterns(folders: list[str]) -> list[str]:
    """One path pattern for each parent folder, matching the named ones in it that exist."""
    alone, named = [], {}
    for folder in folders:
        parent, _, name = folder.rpartition("/")
        if not parent or parent.endswith("/"):  # a relative name, or the root of a store
            alone.append(_literal(folder))
        else:
            named.setdefault(parent, []).append(_literal(name))
    return alone + [f"{_literal(parent)}/{{{','.join(names)}}}" for parent, names in named.items()]


def _files(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Files below the matches of ``paths``; None where one of the patterns matches nothing."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.select("path", "modificationTime")


def cache_manifest(spark: SparkSession, dirs: list[str], cutoff: datetime) -> DataFrame:
    """(path, modified_at) of files under the distinct ``dirs`` last written before ``cutoff``.

    A folder that doesn't exist holds no file; names are taken literally, also where they hold wildcards.
    All folders are one read: a parent folder is listed once to see which of them exist, and Spark lists
    below many folders in tasks, through the store's own interface. No file is opened, as the content
    column is never selected.
    """
    if cutoff.tzinfo is None:
        cutoff = cutoff.replace(tzinfo=timezone.utc)
    patterns = _patterns(sorted({d.rstrip("/") for d in dirs if d.rstrip("/")}))
    files = _files(spark, patterns) if patterns else None
    if files is None:
        # Some parent holds none of its folders; leave such parents out.
        present = [p for p in patterns if _files(spark, [p]) is not None]
        files = _files(spark, present) if present else spark.createDataFrame([], "path string, modificationTime timestamp")
    # Folders may lie in each other.
    return files.filter(F.col("modificationTime") < F.lit(cutoff)).distinct().select(
        "path", F.col("modificationTime").alias("modified_at"))
