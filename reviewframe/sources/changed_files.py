"""Landed provider responses to changed files (review_id, filename, status, patch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.diffs import split_multifile_diff
from ..operators.files import (attach_patches, normalise_status_flags, normalise_status_word,
                               pick_filename)

_COLUMNS = ["review_id", "filename", "status", "patch"]


def _github(raw: DataFrame) -> DataFrame:
    items = raw.select("review_id", F.inline(F.from_json("payload", schemas.GITHUB_FILES)))
    return items.select(*_COLUMNS)


def _gitlab(raw: DataFrame) -> DataFrame:
    body = F.from_json("payload", schemas.GITLAB_CHANGES)
    items = raw.select("review_id", F.inline(body["changes"]))
    return items.select(
        "review_id", pick_filename(F.col("new_path"), F.col("old_path")).alias("filename"),
        normalise_status_flags(F.col("new_file"), F.col("deleted_file")).alias("status"),
        F.coalesce("diff", F.lit("")).alias("patch"))


def _bitbucket(raw: DataFrame) -> DataFrame:
    body = F.from_json("payload", schemas.BITBUCKET_DIFFSTAT)
    items = raw.select("review_id", F.inline(body["values"]))
    stat = items.select(
        "review_id", pick_filename(F.col("new.path"), F.col("old.path")).alias("filename"),
        normalise_status_word(F.col("status")).alias("status"))
    patches = split_multifile_diff(raw.select("review_id", "diff"))
    return attach_patches(stat, patches).select(*_COLUMNS)


_READERS = {"github": _github, "gitlab": _gitlab, "bitbucket": _bitbucket}


def changed_files(raw: DataFrame, vcs: str) -> DataFrame:
    """``raw``: review_id, payload JSON and, for the provider that sends one diff per review, diff."""
    return _READERS[vcs](raw)


def all_changed_files(raw: DataFrame) -> DataFrame:
    """Responses of all providers in one table with a ``vcs`` column."""
    parts = [changed_files(raw.filter(F.col("vcs") == vcs), vcs) for vcs in _READERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
