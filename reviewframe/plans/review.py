"""Changed files in, final findings out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..operators.comments import ground_comments, noise_control, parse_findings, review_summary, suppress_repeats
from ..operators.diffs import added_lines_json, hunk_table, hunks_nested, lines_in_hunks, shared_files, touched_lines
from ..operators.feedback import feedback_stats
from ..operators.files import reviewable_files, scannable_files
from ..operators.graph import file_contexts
from ..operators.infer import review_inputs
from ..operators.nodes import changed_code, extract_nodes, modified_nodes, placed_files
from ..operators.policy import policy_text
from ..operators.rules import gate, scan_hunks, scan_nodes, with_apis
from ..sources.outbox import review_outbox
from ..session import materialise


def raw_findings(files: DataFrame, policies: DataFrame, code: DataFrame | None = None,
                 reviews: DataFrame | None = None) -> DataFrame:
    """Rule findings on the added lines, and on changed definitions when ``code`` is given.

    Each review's forbidden names come along with its files; path globs and rule switches are applied
    to the hits. Only the code of changed files is parsed. A finding on
    a definition stays only if its line is part of the diff; line findings always are.
    """
    found = scan_hunks(hunk_table(with_apis(scannable_files(files), policies), ["forbidden_apis", "api_index"]))
    if code is not None:
        lines = touched_lines(scannable_files(files))
        changed = modified_nodes(extract_nodes(changed_code(code, files, reviews)), lines, reviews)
        found = found.unionByName(scan_nodes(changed.filter("start_added")))
    return gate(found, policies, paths=True)


def final_findings(raw: DataFrame, policies: DataFrame, posted: DataFrame | None = None,
                   marker: str = "Review") -> DataFrame:
    """Noise control over raw findings, after dropping what is posted and open already."""
    fresh = raw if posted is None else suppress_repeats(raw, posted, marker)
    return noise_control(fresh, policies)


def review_changes(files: DataFrame, policies: DataFrame, code: DataFrame | None = None,
                   reviews: DataFrame | None = None, posted: DataFrame | None = None,
                   marker: str = "Review", spool: bool = False) -> tuple[DataFrame, DataFrame]:
    """(final findings, summary per review).

    With ``spool`` the raw findings, far smaller than the patches, are written to the shared
    folder first, so the two results do not scan the patches twice.
    """
    raw = raw_findings(files, policies, code, reviews)
    if spool:
        raw = materialise(files.sparkSession, raw, "findings")
    final = final_findings(raw, policies, posted, marker)
    return final, review_summary(raw, final, policies)


def review_context(code: DataFrame, lines: DataFrame, reviews: DataFrame,
                   max_depth: int = fx.BLAST_DEPTH) -> DataFrame:
    """(review_id, filename, name, part): definitions near the changed ones of each changed file.

    A call graph is one file's: a name that many files define, such as ``main``, is resolved in the
    file that calls it. Only the code of changed files is parsed, once, and nothing runs while the plan is made.
    """
    # Lines meet by file once and become files once; these are dealt by place, where both uses share them.
    touched = placed_files(shared_files(lines), reviews)
    return file_contexts(extract_nodes(changed_code(code, touched)), touched, max_depth)


def context_texts(parts: DataFrame) -> DataFrame:
    """(review_id, filename, context): a file's parts in name order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("name", "part")))
    return parts.groupBy("review_id", "filename").agg(F.array_join(
        F.transform(ordered, lambda p: p["part"]), fx.BLOCK_SEPARATOR).alias("context"))


def composed_inputs(lines: DataFrame, code: DataFrame, reviews: DataFrame, policies: DataFrame,
                    posted: DataFrame, marker: str, service: str,
                    of_review: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """What a model is asked about each changed file: its added lines, the definitions near them, the
    review's rules and what became of earlier comments. ``reviews``: review_id, repo, ref; ``of_review`` as
    in ``review_inputs``."""
    nested = hunks_nested(lines)
    return review_inputs(
        added_lines_json(nested), context_texts(review_context(code, lines_in_hunks(nested), reviews)),
        policies.select("review_id", policy_text().alias("policy_text")),
        feedback_stats(posted, marker, service), service, of_review)


def answered_requests(answers: DataFrame, files: DataFrame, policies: DataFrame, posted: DataFrame,
                      reviews: DataFrame, marker: str, fence: str = "last") -> DataFrame:
    """Model answers (review_id, seq, content) to the requests that post their findings.

    A finding must stand on an added line of a reviewed file and not be posted and open already;
    noise control takes the rest in the order of answers.
    """
    found = parse_findings(answers, fence=fence).withColumn("seq", F.struct("seq", "pos")).drop("pos")
    grounded = ground_comments(found, touched_lines(reviewable_files(files, policies)))
    final = final_findings(grounded.filter("grounded").drop("grounded", "reason"), policies, posted, marker)
    return review_outbox(final, reviews, marker)
