"""Changed files: which of them are reviewed, and which source files are indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.text import extension, globs_to_regex
from ..functions.windows import first_n


def normalise_status_flags(new_file: Column, deleted_file: Column) -> Column:
    """added / deleted / modified from two flags; the new flag wins."""
    return (F.when(F.coalesce(new_file, F.lit(False)), "added")
            .when(F.coalesce(deleted_file, F.lit(False)), "deleted").otherwise("modified"))


def normalise_status_word(word: Column) -> Column:
    """added / deleted / modified from a provider word; unknown words count as modified."""
    status = F.lit("modified")
    for name, value in fx.STATUS_BY_PROVIDER_WORD.items():
        status = F.when(word == name, F.lit(value)).otherwise(status)
    return status


def pick_filename(new_path: Column, old_path: Column) -> Column:
    return F.coalesce(F.nullif(new_path, F.lit("")), old_path, F.lit(""))


def attach_patches(diffstat: DataFrame, patches: DataFrame) -> DataFrame:
    """Left join of the file list with its patches; a file without one gets ''."""
    patch = patches.select("review_id", "filename", F.col("patch").alias("_patch"))
    return (diffstat.join(patch, ["review_id", "filename"], "left")
            .withColumn("patch", F.coalesce("_patch", F.lit(""))).drop("_patch"))


def ends_with_any(path: Column, suffixes: list[str]) -> Column:
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | path.endswith(suffix)
    return hit


def scannable_files(files: DataFrame, skip_ext: list[str] = fx.SKIP_EXTENSIONS) -> DataFrame:
    """The part of ``reviewable_files`` that needs no policy."""
    return files.filter(F.col("status").isin(fx.REVIEWED_STATUSES) & (F.length("patch") > 0)
                        & ~ends_with_any(F.col("filename"), skip_ext))


def reviewable_files(files: DataFrame, policies: DataFrame | None = None,
                     skip_ext: list[str] = fx.SKIP_EXTENSIONS) -> DataFrame:
    """Added or modified files with a patch that neither the policy nor the suffix list excludes.

    The cheap tests run on the scan, before the join with the policies (one row per review, with
    its globs already folded into one pattern).
    """
    kept = scannable_files(files, skip_ext)
    if policies is None:
        globs = F.array(*[F.lit(g) for g in fx.DEFAULT_POLICY["ignore_paths"]])
        return kept.filter(~F.rlike(F.col("filename"), globs_to_regex(globs)))
    rules = policies.select("review_id", "ignore_regex")
    return (kept.join(rules, "review_id", "left")
            .filter(~F.rlike(F.col("filename"), F.coalesce("ignore_regex", F.lit("(?!)"))))
            .drop("ignore_regex"))


def code_files(tree: DataFrame, exts: list[str] = fx.INDEX_EXTENSIONS_MEMORY,
               max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Supported source files; with ``max_files`` the first ones per (repo, ref) in tree order."""
    kept = tree.filter((F.col("kind") == "blob") & extension(F.col("file_path")).isin(exts))
    if max_bytes is not None:
        kept = kept.filter(F.col("size") < max_bytes)
    if max_files is None:
        return kept
    return first_n(kept, ["repo", "ref"], [F.col("tree_pos")], max_files, "_rn").drop("_rn")
