"""Chunk index as snapshots: immutable Parquet folders and a committed manifest of what is live.

Every replacement writes the chunks of its repos to a ``snapshot=`` folder of its own, then a manifest (repo,
snapshot, chunks) of the whole index, which becomes the next version by one rename under ``_versions``. Readers
take the newest version, and nothing that it names is ever written again: a run that breaks at any step leaves
the index as it was, and a reader sees one version from start to end. Repos that end up empty just leave the
manifest. The manifest is a table with a row for each repo and never passes through the driver.

One writer at a time is meant: of two that start from the same version the later one fails without effect.
The rename has to be atomic, as it is on HDFS and local disks. ``dead_snapshots`` names what may be removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

_MANIFEST = "repo string, snapshot string, chunks bigint"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, as Hadoop knows them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def index_version(spark: SparkSession, path: str) -> int:
    """Number of the newest committed version; 0 where there is no index yet."""
    fs, pattern = _folder(spark, f"{path}/_versions/version=*")
    return max((int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(pattern) or []), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(repo, snapshot, chunks) of a version, the newest if none is named."""
    version = index_version(spark, path) if version is None else version
    if version == 0:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/_versions/version={version:012d}")


def _stored(spark: SparkSession, path: str, snapshot: str = "*") -> DataFrame:
    """Chunks with their ``snapshot``; both partition columns are part of the schema."""
    return spark.read.option("basePath", path).schema(f"{schemas.CHUNK}, snapshot string").parquet(
        f"{path}/snapshot={snapshot}")


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks of a version, the newest if none is named; no rows where there is no index yet."""
    version = index_version(spark, path) if version is None else version
    if version == 0:
        return spark.createDataFrame([], schemas.CHUNK)
    chunks = _stored(spark, path)
    live = manifest(spark, path, version).filter("chunks > 0").withColumnsRenamed(
        {"repo": "_repo", "snapshot": "_snapshot"})
    # Snapshots are partitions, so the planner prunes those that the manifest doesn't name.
    return chunks.join(live, (F.col("snapshot") == F.col("_snapshot")) & F.col("repo").eqNullSafe(F.col("_repo")),
                       "left_semi").drop("snapshot")


def _commit(spark: SparkSession, path: str, live: DataFrame, version: int) -> None:
    """Makes ``live`` the manifest of ``version``, unless somebody else was first."""
    draft = f"{path}/_drafts/{uuid.uuid4().hex}"
    live.coalesce(1).write.parquet(draft)
    fs, made = _folder(spark, draft)
    _, target = _folder(spark, f"{path}/_versions/version={version:012d}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(made, target):
        raise RuntimeError(f"version {version} of the index was committed by another writer")


def index_replace(chunks: DataFrame, path: str, repos: DataFrame | None = None) -> DataFrame:
    """Replaces the index of every repo in ``chunks`` and returns (repo, deleted): the chunks it held before.

    ``repos`` (repo) names all repos that were indexed; those without a chunk left end up empty. A repeated
    run gives the same index. The rebalance hint lets a repo of any size be written by several tasks. Chunks,
    which are costly, are computed once and counted from where they lie; old ones are counted by the manifest.
    """
    spark = chunks.sparkSession
    version = index_version(spark, path)
    snapshot = f"{version + 1:012d}-{uuid.uuid4().hex}"
    chunks.hint("rebalance", "repo").write.partitionBy("repo").parquet(f"{path}/snapshot={snapshot}")
    filled = _stored(spark, path, snapshot).groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"))
    touched = filled.select("repo")
    if repos is not None:
        touched = touched.union(repos.select("repo")).distinct()
    touched = touched.withColumnRenamed("repo", "_repo")
    old = manifest(spark, path, version)
    same = F.col("repo").eqNullSafe(F.col("_repo"))
    untouched = old.join(touched, same, "left_anti")
    _commit(spark, path, untouched.unionByName(filled.select("repo", F.lit(snapshot).alias("snapshot"), "chunks")),
            version + 1)
    return old.join(touched, same, "left_semi").select("repo", F.col("chunks").alias("deleted"))


def clear_repo(spark: SparkSession, path: str, repo: str) -> int:
    """Takes a repo out of the index; returns the number of chunks it held."""
    version = index_version(spark, path)
    old = manifest(spark, path, version)
    gone = F.col("repo").eqNullSafe(F.lit(repo))
    held = old.filter(gone).agg(F.sum("chunks")).first()[0]
    if held:
        _commit(spark, path, old.filter(~gone), version + 1)
    return held or 0


def dead_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot) of folders that the newest version doesn't name, for whoever removes files."""
    return _stored(spark, path).select("snapshot").distinct().join(
        manifest(spark, path), "snapshot", "left_anti")
